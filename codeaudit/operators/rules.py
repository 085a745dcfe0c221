"""Pattern rules over code: sast, GDPR, SOC 2 and prompt-injection families, scanner merge.

Each rule is a literal expression over lines or over whole texts, so a family runs in one pass
over the files and nothing is joined. A structural pattern of the scanner is stated as a regular
expression here; positives and near misses of each are part of the tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeaudit.functions.calls import calls_named, computed, with_plain_heads
from codeaudit.functions.text import (
    let, line_array, matches, mentions, merged, numbered_lines,
)
from codeaudit.model import emit, finding, lookup
from codeaudit.sources.files import with_language


@dataclass(frozen=True)
class LineRule:
    id: str
    family: str
    level: str
    languages: tuple[str, ...]
    cwe: str
    anchors: tuple[str, ...]  # every match of the pattern contains one of them
    message: str
    pattern: str
    names: str = ""  # of the calls the rule is about, which then decide instead of lines


PY, JS = ("python",), ("javascript", "typescript")
CODE = PY + JS
ANY: tuple[str, ...] = ()
ARGUMENTS = r"\(((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)\)"  # of plain heads
ARG = r"[A-Za-z_][\w.\[\]]*"
FIELDS = r"(?:email|password|phone|ssn)"
PLAIN_HTTP_HOST = r"[a-zA-Z][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}"
NOT_REMOTE = (r"(?!localhost)(?!127\.)(?!0\.0\.0\.0)(?!\[::1\])(?!example\.)(?!schemas)"
              r"(?!www\.w3\.org)(?!testserver)(?!test[:/])(?!mock[:/])(?!fake[:/])(?!dummy[:/])")

# --- fixed values: rule ids, levels, weakness numbers and messages ---------------------
LINE_RULES = [
    LineRule("va-eval-usage", "sast", "ERROR", CODE, "CWE-95",
             ("eval", "exec"),
             "Avoid eval()/exec() — they execute arbitrary code and are a common source of remote "
             "code execution (RCE) vulnerabilities.",
             r"(?:^|[^\w.])(?:eval|exec)\s*\("),
    LineRule("va-broad-cors", "sast", "WARNING", PY, "CWE-942",
             ("CORS", "allow_origins"),
             "CORS configured with origins=\"*\" allows any website to make authenticated "
             "requests to your API. Restrict to trusted domains.",
             "", r"(?:^|\.)CORS$"),
    LineRule("va-hardcoded-jwt", "sast", "ERROR", CODE, "CWE-798",
             ("jwt.",),
             "JWT secret is hard-coded as a string literal. Move it to an environment variable or "
             "secrets manager.",
             "", r"(?:^|\.)jwt\.(?:encode|sign|decode)$"),
    LineRule("va-client-side-auth", "sast", "WARNING", JS, "CWE-603",
             ("Storage.getItem",),
             "Relying on localStorage/sessionStorage tokens for auth checks is insecure — tokens "
             "can be tampered with. Validate on the server side.",
             r"\bif\s*\(\s*(?:localStorage\.getItem\(\s*[\"'](?:token|auth)[\"']\s*\)"
             r"|sessionStorage\.getItem\(\s*[\"']token[\"']\s*\))\s*\)"),
    LineRule("va-pii-in-logs", "gdpr", "WARNING", CODE, "CWE-532",
             ("logging.", "print", "console.log"),
             "PII field (email, password, phone, ssn) is being logged or printed. This violates "
             "GDPR data minimisation. Mask or redact PII before logging.",
             "", r"^(?:logging\.\w+|print|console\.log)$"),
    LineRule("va-password-in-url", "gdpr", "WARNING", ANY, "CWE-598",
             ("password=", "token=", "secret=", "api_key="),
             "Sensitive data (password/token) is passed as a URL query parameter. Query strings "
             "are logged in server access logs, browser history, and referrer headers. Use POST "
             "body or headers instead.",
             r"[?&](password|token|secret|api_key)="),
    LineRule("va-no-https", "gdpr", "INFO", ANY, "CWE-319",
             ("http://",),
             "Plain HTTP URL to an external host detected. Use HTTPS to prevent man-in-the-middle "
             "attacks and comply with data-in-transit encryption requirements under GDPR. "
             "(Localhost and test URLs are excluded.)",
             "http://" + NOT_REMOTE + PLAIN_HTTP_HOST),
    LineRule("va-hardcoded-secret-key", "soc2", "ERROR", PY, "CWE-798",
             ("SECRET_KEY", "secret_key"),
             "SECRET_KEY is hard-coded as a string literal. Move it to an environment variable or "
             "a secrets manager to comply with SOC 2 credential management controls.",
             r"^\s*(?:SECRET_KEY|secret_key)\s*=\s*[\"'][^\"'\n]*[\"']"
             r"|\w\.secret_key\s*=\s*[\"'][^\"'\n]*[\"']"
             r"|\w\.config\[[\"']SECRET_KEY[\"']\]\s*=\s*[\"'][^\"'\n]*[\"']"),
    LineRule("va-debug-in-prod", "soc2", "WARNING", PY, "CWE-215",
             ("DEBUG", "debug"),
             "DEBUG mode is enabled. Running with DEBUG=True in production exposes detailed error "
             "pages, stack traces, and potentially sensitive config. Set DEBUG=False for "
             "production deployments.",
             r"^\s*(?:DEBUG|debug)\s*=\s*True\b|\w\.debug\s*=\s*True\b"
             r"|\w\.run\([^)\n]*\bdebug\s*=\s*True\b|\w\.config\[[\"']DEBUG[\"']\]\s*=\s*True\b"),
    LineRule("va-llm-output-to-eval", "injection", "ERROR", PY, "CWE-95",
             ("eval", "exec"),
             "LLM output is passed to eval()/exec(). An attacker who controls the prompt can "
             "achieve arbitrary code execution. Parse structured output instead (JSON, AST, etc.).",
             "", r"^(?:eval|exec)$"),
    LineRule("va-llm-output-to-subprocess", "injection", "ERROR", PY, "CWE-78",
             ("subprocess.", "os.system"),
             "A command derived from LLM output is executed via subprocess or os.system with "
             "shell=True. This can lead to command injection. Validate and sanitize all "
             "LLM-generated commands.",
             "", r"(?:^|\.)subprocess\.(?:run|call|Popen)$|^os\.system$"),
    LineRule("va-missing-output-validation", "injection", "ERROR", JS, "CWE-79",
             ("InnerHTML", "innerHTML", "document.write"),
             "LLM output is rendered in the DOM without sanitization, enabling XSS if the model "
             "returns malicious HTML/JS. Sanitize with DOMPurify or escape before rendering.",
             "", r"(?:^|\.)document\.write$"),
]

SQL_CONCAT = LineRule(
    "va-sql-string-concat", "sast", "ERROR", CODE, "CWE-89",
    (".execute", ".query"),
    "SQL query built with string concatenation or f-strings is vulnerable to SQL injection. Use "
    "parameterized queries instead.",
    r"\w\.execute\s*\(\s*(?:f[\"']|(?:\"[^\"\n]*\"|'[^'\n]*')\s*(?:\+|%|\.format\s*\())"
    r"|\w\.query\s*\(\s*(?:f[\"']|(?:\"[^\"\n]*\"|'[^'\n]*')\s*\+)")
INNER_HTML = LineRule(
    "va-dangerous-inner-html", "sast", "WARNING", JS, "CWE-79",
    ("dangerouslySetInnerHTML",),
    "dangerouslySetInnerHTML can lead to Cross-Site Scripting (XSS). Sanitize input with "
    "DOMPurify or use safe rendering methods.",
    r"<[A-Za-z][^<>]*\bdangerouslySetInnerHTML\s*=\s*\{")
ERROR_LEAK = LineRule(
    "va-error-leak", "gdpr", "WARNING", PY, "CWE-209",
    ("format_exc",),
    "Full stack trace is returned in an HTTP response. This leaks internal implementation details "
    "to attackers. Log the trace server-side and return a generic error to the client.",
    r"(?m)^([ \t]*)except\b[^\n:]*:[^\n]*(?:\n(?:\1[ \t]+\S[^\n]*|[ \t]*(?=\n)))*+")
LEAKED_RETURN = (r"\breturn\s+(?:[\w.]+\(\s*traceback\.format_exc\(\)\s*[,)]"
                 r"|jsonify\(\s*\{\s*[\"']error[\"']\s*:\s*traceback\.format_exc\(\)\s*\}\s*\))")
OPEN_ROUTE = LineRule(
    "va-no-auth-middleware", "soc2", "WARNING", PY, "CWE-306",
    (".route(", ".get(", ".post("),
    "API route is missing authentication middleware (login_required / Depends(auth)). All "
    "non-public endpoints must enforce authentication per SOC 2 access-control requirements.",
    r"(?m)^[ \t]*@\w+\.(route|get|post)\([^\n]*\)[ \t]*\n((?:[ \t]*@[^\n]*\n)*+)"
    r"[ \t]*def[ \t]+\w+[ \t]*" + ARGUMENTS)
USER_INPUT = LineRule(
    "va-user-input-to-llm", "injection", "ERROR", PY, "CWE-77",
    (".create",),
    "User-controlled input is interpolated directly into an LLM prompt via f-string. This enables "
    "prompt injection attacks. Sanitize or template the input before sending to the model.",
    "", r"\.chat\.completions\.create$|\.messages\.create$|(?:^|\.)openai\.ChatCompletion\.create$")
USER_F_STRING = r"[\"']role[\"']\s*:\s*[\"']user[\"']\s*,\s*[\"']content[\"']\s*:\s*f[\"']"

LEVELS = {
    "sast": {"INFO": "info", "WARNING": "medium", "ERROR": "high"},
    "gdpr": {"INFO": "low", "WARNING": "medium", "ERROR": "high"},
    "soc2": {"INFO": "low", "WARNING": "medium", "ERROR": "high"},
    "injection": {"INFO": "high", "WARNING": "high", "ERROR": "high"},
}
CATEGORY = {"sast": "sast", "gdpr": "compliance_gdpr", "soc2": "compliance_soc2",
            "injection": "prompt_injection"}
ANALYZER = {"sast": "sast", "gdpr": "compliance", "soc2": "compliance",
            "injection": "prompt_injection"}
REMEDIATION = {
    "gdpr": "Review and fix the flagged compliance issue.",
    "soc2": "Review and fix the flagged compliance issue.",
    "injection": "Sanitize user input before passing to LLM API. Use allowlists or template-based "
                 "prompts instead of string concatenation.",
}
CONTEXT_LINES = 15
# ---------------------------------------------------------------------------------------

#: Patterns beside the calls: what a rule is about without being a call, under the rule's id.
MARKS = {
    "va-broad-cors": r"\ballow_origins\s*=\s*\[\s*[\"']\*[\"']\s*\]",
    "va-missing-output-validation": r"<[A-Za-z][^<>]*\bdangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:"
                                    r"|\w\s*\.\s*innerHTML\s*=(?!=)",
}
ALL_RULES = [*LINE_RULES, SQL_CONCAT, INNER_HTML, ERROR_LEAK, OPEN_ROUTE, USER_INPUT]
COMMENT = r"^\s*(?:#|//|\*)"


def _gate(rule: LineRule) -> Column:
    return F.col("lang").isin(*rule.languages) if rule.languages else F.lit(True)


def line_rule_hits(family: str) -> Column:
    """Array of (line_no, line, rule_id) of the family's line rules.

    A text or line that holds none of a rule's anchor words is out by a plain search; patterns
    see only what is left.
    """
    rules = [r for r in LINE_RULES if r.family == family and not r.names]
    if not rules:
        return F.array().cast("array<struct<line_no:int,line:string,rule_id:string>>")
    content = F.col("content")
    anchors = {a for r in rules for a in r.anchors}
    possible = F.lit(False)
    for r in rules:
        possible = possible | (_gate(r) & mentions(content, r.anchors))

    def of_line(n: Column) -> Column:
        text = n["text"]
        tests = [F.when(_gate(r) & mentions(text, r.anchors) & text.rlike(r.pattern)
                        & (~text.rlike(COMMENT) if r.languages else F.lit(True)),
                        F.struct(n["line_no"].alias("line_no"), text.alias("line"),
                                 F.lit(r.id).alias("rule_id"))) for r in rules]
        return F.array_compact(F.array(*tests))

    lines = F.filter(numbered_lines(content), lambda n: mentions(n["text"], sorted(anchors)))
    return F.when(possible, F.flatten(F.transform(lines, of_line)))


CALL_RULES = [r for r in ALL_RULES if r.names]


def with_calls(files: DataFrame, *families: str) -> DataFrame:
    """Files with ``calls``, what the call rules are about, and ``heads``, the text with plain argument
    lists; only texts that hold a word of a rule (of ``families``, if given) are read for them. One pass."""
    content, possible = F.col("content"), F.lit(False)
    asked = [r for r in CALL_RULES if not families or r.family in families]
    for r in asked:
        possible = possible | (_gate(r) & mentions(content, r.anchors))
    names = "|".join(r.names for r in asked) or r"(?!)"
    marks = {r.id: MARKS[r.id] for r in asked if r.id in MARKS}
    if families and OPEN_ROUTE.family not in families:
        return computed(files.select("*", calls_named(F.when(possible, content), F.col("lang"), names, marks).alias("calls")))
    return computed(files.select("*", calls_named(
        F.when(possible, content), F.col("lang"), names, marks).alias("calls"),
        with_plain_heads(F.when(_gate(OPEN_ROUTE) & mentions(content, OPEN_ROUTE.anchors), content)).alias("heads")))


def _call_matters(rule: LineRule, c: Column) -> Column:
    """Whether a call (or mark) of the rule's names is a hit."""
    field, short = r"^%s\.%s$" % (ARG, FIELDS), r"^%s\.(?:email|password)$" % ARG
    args, first = c["args"], F.get(c["args"], F.lit(0))
    plain = lambda a, pattern: a["key"].isNull() & a["value"].rlike(pattern)
    if rule.id == "va-broad-cors":
        return F.exists(args, lambda a: (a["key"].eqNullSafe("origins") & a["value"].rlike(r"^[\"']\*[\"']$"))
                        | a["value"].rlike(r"[\"']origins[\"']\s*:\s*[\"']\*[\"']"))
    if rule.id == "va-hardcoded-jwt":
        return F.coalesce(plain(F.get(args, F.lit(1)), r"^[\"'][^\"'\n]*[\"']"), F.lit(False))
    if rule.id == "va-pii-in-logs":
        told = F.coalesce(plain(first, r"(?s)^f[\"'].*\{%s\.%s\}" % (ARG, FIELDS)), F.lit(False))
        return (F.when(c["name"].isin("logging.info", "print", "console.log"), F.exists(args, lambda a: plain(a, field)))
                .when(c["name"] == "logging.debug", F.exists(args, lambda a: plain(a, short))).otherwise(False)
                | (c["name"].startswith("logging.") & told))
    if rule.id == "va-llm-output-to-eval":
        return (F.size(args) == 1) & plain(first, r"^[A-Za-z_]")
    if rule.id == "va-llm-output-to-subprocess":
        return (c["name"] == "os.system") | F.exists(
            args, lambda a: a["key"].eqNullSafe("shell") & (a["value"] == "True"))
    if rule.id == "va-user-input-to-llm":
        return F.exists(args, lambda a: a["value"].rlike(USER_F_STRING))
    return F.lit(True)


def call_rule_hits(family: str) -> Column:
    """Array of (line_no, line, rule_id) of the family's call rules; a line counts once for a rule."""
    def of_call(c: Column) -> Column:
        return F.array_compact(F.array(*[F.when(
            _gate(r) & ((c["name"] == r.id) | (c["name"].rlike(r.names) & _call_matters(r, c))),
            F.struct(c["line_no"].alias("line_no"), c["line"].alias("line"), F.lit(r.id).alias("rule_id")))
            for r in CALL_RULES if r.family == family]))
    return F.array_distinct(F.flatten(F.transform("calls", of_call)))


def _text_rule_hits(rule: LineRule, groups: int = 0,
                    condition: Callable[[Column], Column] | None = None, text: str = "content") -> Column:
    found = matches(F.col(text), rule.pattern, groups)
    if condition is not None:
        found = F.filter(found, condition)
    return F.when(_gate(rule) & mentions(F.col("content"), rule.anchors), F.transform(found, lambda m: F.struct(
        m["line"].alias("line_no"), F.get(F.split(m["match"], "\n"), 0).alias("line"),
        F.lit(rule.id).alias("rule_id"))))


def _open_route(m: Column) -> Column:
    verb, more, args = (m["groups"][i] for i in range(3))
    by_decorator = (verb == "route") & more.rlike(r"(?m)^[ \t]*@login_required\b")
    by_argument = (verb != "route") & args.rlike(r"=\s*Depends\(")
    return ~(by_decorator | by_argument)


def rule_hits(family: str) -> Column:
    """Array of (line_no, line, rule_id) of all rules of a family over one file's row, which
    carries ``content``, ``lang``, ``calls`` and ``heads``."""
    hits = [line_rule_hits(family)]
    if any(r.family == family for r in CALL_RULES):
        hits.append(call_rule_hits(family))
    if family == "sast":
        hits += [_text_rule_hits(SQL_CONCAT), _text_rule_hits(INNER_HTML)]
    elif family == "gdpr":
        hits += [_text_rule_hits(ERROR_LEAK, 1, lambda m: m["match"].rlike(LEAKED_RETURN))]
    elif family == "soc2":
        hits += [_text_rule_hits(OPEN_ROUTE, 3, _open_route, "heads")]
    return merged(*hits)


def rule_check(family: str) -> Column:
    """The family's rules as one per-file check, with its severities and texts."""
    of = {r.id: r for r in ALL_RULES if r.family == family}
    positions = {k: i + (100 if family == "soc2" else 0) for i, k in enumerate(of, 1)}
    path = F.col("path")

    def found(hit: Column, lines: Column | None = None) -> Column:
        rule, line_no = hit["rule_id"], hit["line_no"]
        message = lookup({k: r.message for k, r in of.items()}, rule)
        if family == "sast":
            remediation = F.concat(
                F.lit("Review the matched pattern and refactor according to secure coding "
                      "guidelines. Rule: "), rule, F.lit("."))
            prompt = F.concat(F.lit("Review "), path, F.lit(":"), line_no,
                              F.lit(" — Semgrep rule '"), rule,
                              F.lit("' matched. Suggest a fix."))
        elif family == "injection":
            remediation, prompt = F.lit(REMEDIATION[family]), F.concat(
                F.lit("In "), path, F.lit(" at line "), line_no,
                F.lit(", user input flows into an LLM API call without sanitization. Refactor to "
                      "use a template-based prompt with input validation."))
        else:
            remediation = F.lit(REMEDIATION[family])
            prompt = F.concat(F.lit("Fix the compliance issue in "), path, F.lit(" at line "),
                              line_no, F.lit(": "), message)
        evidence = hit["line"]
        if family == "injection":
            evidence = F.left(_around(lines, line_no)["code_segment"], F.lit(500))
        return finding(
            analyzer=ANALYZER[family], category=CATEGORY[family], tool="semgrep", title=rule,
            file=path, line=line_no, description=message, remediation=remediation,
            severity=lookup({k: LEVELS[family][r.level] for k, r in of.items()}, rule),
            cwe=lookup({k: r.cwe for k, r in of.items()}, rule) if family == "sast" else None,
            ord=lookup(positions, rule), ai_prompt=prompt, evidence=evidence,
            confidence=0.6 if family == "injection" else 1.0)

    if family == "injection":  # a text with hits is cut into lines once, for all of them
        return let(rule_hits(family), lambda hits: F.when(F.size(hits) > 0, let(
            line_array(F.col("content")), lambda lines: F.transform(hits, lambda h: found(h, lines)))))
    return F.transform(rule_hits(family), lambda h: found(h))


def rule_findings(files: DataFrame, *families: str) -> DataFrame:
    """Findings of rule families in one pass over the files."""
    return emit(with_calls(with_language(files, keep_others=True), *families), [rule_check(f) for f in families])


def injection_segments(files: DataFrame) -> DataFrame:
    """(repo_id, path, line_no, rule_id, message, start_line, end_line, code_segment): injection
    hits with the lines around them, cut out of the text in the same row, so that no text is
    joined or shuffled."""
    messages = {r.id: r.message for r in ALL_RULES if r.family == "injection"}
    cut = F.transform(rule_hits("injection"), lambda h: F.struct(
        h["line_no"].alias("line_no"), h["rule_id"].alias("rule_id"),
        lookup(messages, h["rule_id"]).alias("message"),
        segment(F.col("content"), h["line_no"]).alias("around")))
    return (with_calls(with_language(files), "injection").select("repo_id", "path", F.inline(cut))
            .select("repo_id", "path", "line_no", "rule_id", "message", "around.*"))


def insecure_urls(pages: DataFrame) -> DataFrame:
    """Rows whose ``url`` is plain HTTP to a remote host."""
    return pages.filter(F.col("url").rlike("http://" + NOT_REMOTE + PLAIN_HTTP_HOST))


def hit_segments(files: DataFrame, hits: DataFrame) -> DataFrame:
    """The lines around each hit, 15 either way, clipped to the file.

    For hits of an outside report, which are joined to the files by (repo_id, path); a hit whose
    file is unknown yields nothing. Hits of the own rules carry their segment already, see
    ``injection_segments``. Bucket the files table by (repo_id, path) where reports are so
    large that Spark would shuffle the texts.
    """
    located = hits.select("repo_id", "path", "line_no", "rule_id", "message")
    rows = files.select("repo_id", "path", "content").join(located, ["repo_id", "path"])
    around = segment(F.col("content"), F.col("line_no")).alias("around")
    return (rows.select("repo_id", "path", "line_no", "rule_id", "message", around)
            .select("repo_id", "path", "line_no", "rule_id", "message", "around.*"))


def segment(content: Column, line_no: Column) -> Column:
    """(start_line, end_line, code_segment): 15 lines either way, clipped to the text."""
    return let(line_array(content), lambda lines: _around(lines, line_no))


def _around(lines: Column, line_no: Column) -> Column:
    """``segment`` of a text that is cut into lines."""
    start = F.greatest(F.lit(1), line_no - CONTEXT_LINES)
    end = F.least(F.size(lines), line_no + CONTEXT_LINES)
    code = F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"),
                    code.alias("code_segment"))


def merge_scanners(preferred: DataFrame, other: DataFrame) -> DataFrame:
    """One finding per (repo, file, line): the last of ``preferred``, else the first of ``other``.

    The rank filter is pushed below the shuffle as a group limit, so at most one row per place
    and task is exchanged.
    """
    both = (preferred.withColumn("side", F.lit(0))
            .unionByName(other.withColumn("side", F.lit(1))))
    place = Window.partitionBy("repo_id", F.coalesce("file", F.lit("")),
                               F.coalesce("line", F.lit(0)))
    order = F.when(F.col("side") == 0, -F.col("ord")).otherwise(F.col("ord"))
    first = F.row_number().over(place.orderBy("side", order, "id"))
    return both.withColumn("_pos", first).filter("_pos = 1").drop("_pos", "side")
