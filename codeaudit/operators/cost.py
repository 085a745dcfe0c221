"""Cost checks: expensive models, over-provisioned resources, repeated calls, heavy packages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.functions.text import let, matches, mentions, merged, newlines, numbered_lines
from codeaudit.model import emit, finding, lookup
from codeaudit.sources.files import SKIP_COST, only_tracked, outside, without_prefix

# --- fixed values -----------------------------------------------------------
MODELS = {
    "gpt-4o": "gpt-4o-mini (10× cheaper, similar quality for most tasks)",
    "gpt-4-turbo": "gpt-4o-mini (10× cheaper, similar quality for most tasks)",
    "gpt-4": "gpt-4o-mini (10× cheaper, similar quality for most tasks)",
    "o1-preview": "o1-mini or gpt-4o-mini (significantly cheaper for most tasks)",
    "o1": "o1-mini or gpt-4o-mini (significantly cheaper for most tasks)",
    "claude-3-opus": "claude-3-haiku or claude-3.5-sonnet (2-60× cheaper)",
    "claude-3-5-sonnet": "claude-3-haiku (10× cheaper for simple tasks)",
    "claude-sonnet-4": "claude-3-haiku (10× cheaper for simple tasks)",
    "gemini-2.5-pro": "gemini-2.0-flash (much cheaper for simple tasks)",
    "gemini-1.5-pro": "gemini-1.5-flash or gemini-2.0-flash (10× cheaper)",
}
HEAVY_PACKAGES = {
    "moment": "dayjs (2KB vs 72KB, same API)",
    "lodash": "lodash-es or native JS (tree-shakeable, 70% smaller)",
    "underscore": "native JS Array/Object methods",
    "request": "node-fetch or native fetch (request is deprecated)",
    "axios": "native fetch API (built-in, zero dependencies)",
    "jquery": "native DOM APIs (no dependency needed in modern browsers)",
    "left-pad": "String.prototype.padStart (built-in)",
    "is-even": "n % 2 === 0 (built-in)",
    "is-odd": "n % 2 !== 0 (built-in)",
    "pandas": "csv module or polars (pandas is 30MB+ for simple CSV tasks)",
    "tensorflow": "tensorflow-lite or onnxruntime (if only doing inference)",
    "boto3": "specific service SDK (e.g., s3fs) if only using one AWS service",
}
CODE_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx"]
CPU = r"(?i)cpu:\s*[\"']?(\d+)(?:m)?[\"']?"
MEMORY = r"(?i)memory:\s*[\"']?(\d+)(Mi|Gi)[\"']?"
SERVERLESS_MEMORY = r"(?i)memorySize:\s*(\d+)"
VERBS = r"\.(?:get|post|put|delete)"
CALL = (r"(?:fetch|requests" + VERBS + r"|axios" + VERBS + r"|httpx" + VERBS + r"|aiohttp" + VERBS
        + r")\s*\(\s*['\"`]([^'\"`]{10,})['\"`]")
MODEL_ASSIGNMENT = r"(?i)model\s*[=:]\s*[\"']?(?=([a-z0-9.-]+))"
CALLERS = ["fetch", "requests.", "axios.", "httpx.", "aiohttp."]
MAX_CPU, MAX_MILLICORES, MAX_MEMORY_MI, MAX_SERVERLESS_MB = 2, 2000, 4096, 512
# ----------------------------------------------------------------------------

ANALYZER = {"analyzer": "cost_efficiency", "category": "cost_efficiency",
            "tool": "cost-analyzer"}


def _place(line: Column) -> Column:
    return F.concat(F.col("path"), F.lit(":"), line)


def _is_code() -> Column:
    return F.col("ext").isin(CODE_EXTENSIONS)


def _literal(name: str) -> str:
    return re.escape(name).replace(r"\-", "-")


def expensive_models() -> Column:
    """One finding per table entry and match; an entry that is a prefix of another matches both.

    The assignments are found once, with what follows them; entries are then told apart by it.
    """
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(alt).alias("cheaper"))
                        for m, alt in MODELS.items()])

    def found(entry: Column, m: Column) -> Column:
        model, cheaper = entry["model"], entry["cheaper"]
        return finding(
            **ANALYZER, severity="medium", ord=1, file=F.col("path"), line=m["line"],
            title=F.concat(F.lit("Expensive LLM model: "), model),
            description=F.concat(F.lit("Using expensive model '"), model, F.lit("'. Consider "),
                                 cheaper, F.lit(" for cost savings.")),
            remediation=F.concat(
                F.lit("Replace with a cheaper model. Alternative: "), cheaper,
                F.lit(". Only use expensive models for tasks that require superior reasoning "
                      "(complex analysis, code generation).")),
            ai_prompt=F.concat(
                F.lit("Review the use of '"), model, F.lit("' in "), _place(m["line"]),
                F.lit(". Determine if "), cheaper,
                F.lit(" would be sufficient for this use case.")),
            confidence=0.8)

    content = F.col("content")
    hits = F.transform(matches(content, MODEL_ASSIGNMENT, 1), lambda m: F.transform(
        F.filter(entries, lambda e: F.startswith(F.lower(m["groups"][0]), e["model"])),
        lambda e: found(e, m)))
    return F.when(_is_code() & F.lower("content").contains("model"), F.flatten(hits))


def oversized_resources() -> list[Column]:
    content = F.col("content")
    config = F.col("base").rlike(r"\.(?:yml|yaml)$|^Dockerfile$|^docker-compose")
    amount = lambda m: m["groups"][0].cast("bigint")
    size = lambda m: F.concat(m["groups"][0].cast("bigint").cast("string"), m["groups"][1])
    common = {**ANALYZER, "file": F.col("path")}

    def cpu(m: Column) -> Column:
        return finding(
            **common, severity="medium", ord=2, line=m["line"],
            title=F.concat(F.lit("Over-provisioned CPU: "), amount(m), F.lit(" cores")),
            description=F.concat(F.lit("Container requests "), amount(m), F.lit(
                " CPU cores. Most application containers run fine on 0.5-1 cores.")),
            remediation="Review actual CPU usage and right-size the resource request. Start with "
                        "500m (0.5 cores) and scale up based on metrics.",
            ai_prompt=F.concat(
                F.lit("Review CPU allocation of "), amount(m), F.lit(" cores in "),
                _place(m["line"]), F.lit(". Right-size based on actual usage.")),
            confidence=0.7)

    def memory(m: Column) -> Column:
        return finding(
            **common, severity="medium", ord=3, line=m["line"],
            title=F.concat(F.lit("Over-provisioned memory: "), size(m)),
            description=F.concat(F.lit("Container requests "), size(m), F.lit(
                " memory. Most web applications run under 512Mi-1Gi.")),
            remediation="Review actual memory usage and right-size. Start with 256Mi-512Mi and "
                        "scale up based on OOM metrics.",
            ai_prompt=F.concat(
                F.lit("Review memory allocation of "), size(m), F.lit(" in "), _place(m["line"]),
                F.lit(". Right-size based on actual usage.")),
            confidence=0.7)

    def serverless(m: Column) -> Column:
        return finding(
            **common, severity="low", ord=4, line=m["line"],
            title=F.concat(F.lit("Over-provisioned Lambda: "), amount(m), F.lit("MB")),
            description=F.concat(F.lit("Lambda function configured with "), amount(m), F.lit(
                "MB memory. Most functions run under 256-512MB.")),
            remediation="Use AWS Lambda Power Tuning to find the optimal memory size for "
                        "cost/performance balance.",
            ai_prompt=F.concat(F.lit("Review Lambda memory allocation of "), amount(m),
                               F.lit("MB in "), _place(m["line"]), F.lit(".")),
            confidence=0.6)

    too_many = lambda m: (amount(m) > MAX_CPU) & ~(
        F.lower(m["match"]).contains("m") & (amount(m) <= MAX_MILLICORES))
    mebibytes = lambda m: F.when(m["groups"][1] == "Gi", amount(m) * 1024).otherwise(amount(m))
    kinds = [(CPU, 1, too_many, cpu), (MEMORY, 2, lambda m: mebibytes(m) > MAX_MEMORY_MI, memory),
             (SERVERLESS_MEMORY, 1, lambda m: amount(m) > MAX_SERVERLESS_MB, serverless)]
    return [F.when(config, F.transform(F.filter(matches(content, p, g), test), make))
            for p, g, test, make in kinds]


def repeated_calls() -> Column:
    """Literal URLs called twice or more in one file: calls sorted by URL, cut into runs."""
    def runs(calls: Column) -> Column:
        starts = F.filter(
            F.transform(calls, lambda c, i: F.when(
                (i == 0) | (F.get(calls, i - 1)["url"] != c["url"]), i)),
            lambda i: i.isNotNull())
        return let(starts, lambda heads: F.transform(heads, lambda h, k: F.slice(
            calls, h + 1, F.coalesce(F.get(heads, k + 1), F.size(calls)) - h)))

    def found(run: Column) -> Column:
        short, line = F.left(run[0]["url"], F.lit(60)), run[0]["line"]
        first = F.transform(F.slice(run, 1, 5), lambda c: c["line"].cast("string"))
        return finding(
            **ANALYZER, severity="medium", ord=5, file=F.col("path"), line=line,
            title="Redundant API calls to same URL",
            description=F.concat(
                F.lit("The URL '"), short, F.lit("...' is called "), F.size(run),
                F.lit(" times in this file (lines "), F.array_join(first, ", "),
                F.lit("). Each call incurs network latency and potential API costs.")),
            remediation="Cache the response or extract the call into a shared function. Use "
                        "memoization, React Query, SWR, or a simple variable.",
            ai_prompt=F.concat(F.lit("Refactor "), F.col("path"),
                               F.lit(" to deduplicate API calls to '"), short,
                               F.lit("'. Add caching or extract into a shared utility.")),
            confidence=0.7)

    calls = F.array_sort(F.transform(matches(F.col("content"), CALL, 1), lambda m: F.struct(
        m["groups"][0].alias("url"), m["line"].alias("line"))))
    repeated = F.filter(let(calls, runs), lambda run: F.size(run) >= 2)
    return F.when(_is_code() & mentions(F.col("content"), CALLERS), F.transform(repeated, found))


def heavy_packages() -> list[Column]:
    """Heavy packages named in package.json, requirements files and pyproject."""
    content, path, base = F.col("content"), F.col("path"), F.col("base")

    def shape(dep: Column, line: Column, ord_no: int, confidence: float, gain: str,
              tail: str) -> Column:
        instead = lookup(HEAVY_PACKAGES, dep)
        return finding(
            **ANALYZER, severity="low", ord=ord_no, file=path, line=line,
            title=F.concat(F.lit("Bloated dependency: "), dep),
            description=F.concat(F.lit("'"), dep, F.lit("' is a heavy dependency. Consider: "),
                                 instead, F.lit(".")),
            remediation=F.concat(F.lit("Replace '"), dep, F.lit("' with "), instead,
                                 F.lit(" to reduce "), F.lit(gain)),
            ai_prompt=F.concat(F.lit("Replace the '"), dep, F.lit("' dependency in "), path,
                               F.lit(" with "), instead, F.lit(tail)),
            confidence=confidence)

    keys = F.transform(F.array(*[F.lit(d) for d in HEAVY_PACKAGES]), lambda d: F.struct(
        d.alias("dep"), F.instr(content, F.concat(F.lit('"'), d, F.lit('"'))).alias("at")))
    in_json = F.transform(F.filter(keys, lambda k: k["at"] > 0), lambda k: shape(
        k["dep"], newlines(F.left(content, k["at"] - 1)) + 1, 6, 0.8,
        "bundle size and improve load times.", ". Ensure all usage is migrated."))
    named = F.array_compact(F.array(*[
        F.when(content.rlike(r"(?:^|\n|\")\s*" + _literal(d) + r"\s*(?:[=<>!\n\"])"), F.lit(d))
        for d in HEAVY_PACKAGES]))
    line_of = lambda d: F.coalesce(F.get(F.filter(
        numbered_lines(content), lambda n: F.contains(n["text"], d)), F.lit(0))["line_no"],
        F.lit(1))
    in_text = F.transform(named, lambda d: shape(
        d, line_of(d), 7, 0.7, "install size and build times.", "."))
    return [F.when(base == "package.json", in_json),
            F.when(base.rlike(r"^requirements.*\.txt$|^pyproject\.toml$"), in_text)]


def cost_checks() -> list[Column]:
    return [expensive_models(), *oversized_resources(), repeated_calls(), *heavy_packages()]


def in_cost_scope(findings: DataFrame, tracked: DataFrame | None = None,
                  git_repos: DataFrame | None = None,
                  own_prefix: str | None = None) -> DataFrame:
    """Findings in scope: the directory, tracked and own-tool filters apply to narrow rows."""
    rows = findings.withColumn("path", F.col("file"))
    if own_prefix:
        rows = without_prefix(rows, own_prefix)
    return only_tracked(rows, tracked, git_repos, outside(F.col("path"), SKIP_COST)).drop("path")


def cost_findings(files: DataFrame, tracked: DataFrame | None = None,
                  git_repos: DataFrame | None = None, own_prefix: str | None = None) -> DataFrame:
    return in_cost_scope(emit(files, cost_checks()), tracked, git_repos, own_prefix)
