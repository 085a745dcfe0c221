"""Secrets in whole texts: known formats, keyword assignments, high-entropy tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.functions.text import let, mask, mentions, numbered_lines, shannon_entropy
from codeaudit.model import emit, finding

# --- fixed values: name, severity, title, CWE, pattern (group 1 is the secret) ---
KNOWN_FORMATS = [
    ("aws", "critical", "Hardcoded AWS Access Key", r"\b(AKIA[0-9A-Z]{16})\b"),
    ("github", "high", "GitHub Token in Config", r"\b(gh[pousr]_[A-Za-z0-9]{26,})"),
    ("private_key", "high", "Private Key in Source", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
    ("jwt", "high", "JSON Web Token in Source",
     r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
]
KEYWORD = (r"(?i)\b(?:token|secret|password|passwd|api_?key)[\"']?\s*[:=]\s*"
           r"[\"']([^\"'\s]{8,})[\"']")
KEYWORD_NAMES = ["token", "secret", "password", "passwd", "apikey", "api_key"]
FORMAT_ANCHORS = ["AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "PRIVATE KEY-----", "eyJ"]
QUOTED_TOKEN = r"[\"']([A-Za-z0-9+/=_-]{20,})[\"']"
MIN_ENTROPY_HEX = 3.0
MIN_ENTROPY_MIXED = 4.5
# ---------------------------------------------------------------------------------

ANY_FORMAT = "|".join(p for *_, p in KNOWN_FORMATS)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _per_line(pattern: str, of_line: Callable[[Column, Column], Column],
              gate: Column | None = None) -> Column:
    """Concatenated arrays of the lines that match; a text without a match is not cut up, one
    outside the gate not even searched."""
    content = F.col("content")
    gate = F.lit(True) if gate is None else gate
    lines = F.filter(numbered_lines(content), lambda n: n["text"].rlike(pattern))
    return F.when(gate & content.rlike(pattern), F.flatten(F.transform(
        lines, lambda n: of_line(n["line_no"], n["text"]))))


def known_formats() -> Column:
    """Array of (line_no, rule, severity, title, secret)."""
    def hits(line_no: Column, text: Column, rule: tuple[str, str, str, str]) -> Column:
        name, severity, title, pattern = rule
        return F.transform(_all(text, pattern), lambda s: F.struct(
            line_no.alias("line_no"), F.lit(name).alias("rule"),
            F.lit(severity).alias("severity"), F.lit(title).alias("title"), s.alias("secret")))

    return _per_line(ANY_FORMAT, lambda n, t: F.flatten(F.array(
        *[hits(n, t, rule) for rule in KNOWN_FORMATS])), mentions(F.col("content"), FORMAT_ANCHORS))


def keyword_assignments() -> Column:
    """Array of (line_no, secret): string literals assigned to a telling name."""
    return _per_line(KEYWORD, lambda n, t: F.transform(_all(t, KEYWORD), lambda s: F.struct(
        n.alias("line_no"), s.alias("secret"))),
        let(F.lower("content"), lambda text: mentions(text, KEYWORD_NAMES)))


def random_tokens(min_hex: float = MIN_ENTROPY_HEX, min_mixed: float = MIN_ENTROPY_MIXED,
                  unreported: bool = False) -> Column:
    """Array of (line_no, secret, entropy): quoted tokens with more bits per character than the
    bound for their alphabet; ``unreported`` leaves out what the other detectors report."""
    def tokens(line_no: Column, text: Column) -> Column:
        found = _all(text, QUOTED_TOKEN)
        if unreported:
            known = F.flatten(F.array(*[_all(text, p) for *_, p in KNOWN_FORMATS],
                                      _all(text, KEYWORD)))
            found = let(known, lambda k: F.filter(
                _all(text, QUOTED_TOKEN), lambda s: ~F.array_contains(k, s)))
        scored = F.transform(found, lambda s: F.struct(
            line_no.alias("line_no"), s.alias("secret"), shannon_entropy(s).alias("entropy")))
        return F.filter(scored, lambda x: x["entropy"] > F.when(
            x["secret"].rlike(r"^[0-9a-fA-F]+$"), min_hex).otherwise(min_mixed))

    return _per_line(QUOTED_TOKEN, tokens)


def known_secrets(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "path", F.inline(known_formats()))


def keyword_secrets(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "path", F.inline(keyword_assignments()))


def entropy_secrets(files: DataFrame, min_hex: float = MIN_ENTROPY_HEX,
                    min_mixed: float = MIN_ENTROPY_MIXED) -> DataFrame:
    return files.select("repo_id", "path", F.inline(random_tokens(min_hex, min_mixed)))


def secret_checks() -> list[Column]:
    """All three detectors as per-file checks, evidence masked."""
    path = F.col("path")

    def found(hit: Column, ord_no: int, title: Column | str, severity: Column | str, what: str,
              remediation: str, confidence: float = 1.0) -> Column:
        masked = mask(hit["secret"])
        return finding(
            analyzer="secrets", category="secret", tool="secret-scanner", file=path,
            line=hit["line_no"], cwe="CWE-798", ord=ord_no, title=title, severity=severity,
            description=F.concat(F.lit(what), masked), remediation=remediation, evidence=masked,
            ai_prompt=F.concat(F.lit("Take the secret on line "), hit["line_no"], F.lit(" of "),
                               path, F.lit(" out of the source.")), confidence=confidence)

    return [
        F.transform(known_formats(), lambda h: found(
            h, 1, h["title"], h["severity"], "Credential of a known format found in source: ",
            "Revoke the credential and read it from an environment variable.")),
        F.transform(keyword_assignments(), lambda h: found(
            h, 2, "Hardcoded Secret", "high", "A string literal is assigned to a secret's name: ",
            "Move the value to an environment variable or a secrets manager.")),
        F.transform(random_tokens(unreported=True), lambda h: found(
            h, 3, "High-Entropy String", "medium",
            "A random-looking string literal may be a secret: ",
            "Verify the value; move it out of the source if it is a secret.", 0.7)),
    ]


def secret_findings(files: DataFrame) -> DataFrame:
    return emit(files, secret_checks())
