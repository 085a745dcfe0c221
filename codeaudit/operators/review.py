"""Review data: prompts, verdicts, compliance and summary replies, digests, token budgets.

Replies of reviewers are input tables; nothing here calls a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeaudit.functions.text import json_block, location
from codeaudit.model import as_findings, emission_order, finding_key, lookup, severity_rank
from codeaudit.operators.rules import REMEDIATION

# --- fixed values -----------------------------------------------------------
CONFIDENCE_THRESHOLD = 0.3
UNREVIEWED_CONFIDENCE = 0.6
MAX_COMPLIANCE_FINDINGS = 5
DIGEST_FINDINGS = 15
PROMPT_CHARS, EVIDENCE_CHARS, DIGEST_CHARS = 800, 500, 120
TOKEN_PRICE = 0.000003
TOKEN_BUDGET = 5000
COMPLIANCE_CATEGORIES = {"compliance_gdpr": "compliance_gdpr",
                         "compliance_soc2": "compliance_soc2"}
CAPPED_SEVERITY = {"critical": "high", "high": "high", "medium": "medium", "low": "low",
                   "info": "info"}
# ----------------------------------------------------------------------------


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def segment_findings(segments: DataFrame) -> DataFrame:
    """Injection findings of segments, before any review."""
    path, line_no = F.col("path"), F.col("line_no")
    return as_findings(
        segments, analyzer="prompt_injection", category="prompt_injection", severity="high",
        tool="semgrep", title=F.col("rule_id"), file=path, line=line_no,
        description=F.col("message"), remediation=REMEDIATION["injection"],
        ai_prompt=F.concat(
            F.lit("In "), path, F.lit(" at line "), line_no,
            F.lit(", user input flows into an LLM API call without sanitization. Refactor to use "
                  "a template-based prompt with input validation.")),
        evidence=F.left("code_segment", F.lit(EVIDENCE_CHARS)), confidence=UNREVIEWED_CONFIDENCE)


def render_prompts(segments: DataFrame, template: str) -> DataFrame:
    """Fill {file_path}, {start_line}, {end_line}, {code_segment} of a template, in that order."""
    text = F.lit(template)
    for name, value in (("file_path", F.col("path")),
                        ("start_line", F.col("start_line").cast("string")),
                        ("end_line", F.col("end_line").cast("string")),
                        ("code_segment", F.left("code_segment", F.lit(PROMPT_CHARS)))):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return segments.withColumn("prompt", text)


def apply_verdicts(findings: DataFrame, replies: DataFrame) -> DataFrame:
    """Findings after review: ``replies(key, body)``, keyed by ``finding_key``, or ``replies(id,
    body)``; an id that different findings share decides none of them.

    Of several readable replies to one finding the smallest text decides. Without a readable verdict a finding stays as it is; one that is judged harmless or below the
    threshold is dropped; otherwise confidence, description and reference are the reviewer's.
    """
    verdict = F.try_parse_json(json_block(F.col("body"), "{", "}"))
    keyed = findings.withColumn("_key", finding_key())
    if "key" in replies.columns:
        replies = replies.withColumnRenamed("key", "_key")
    else:
        ids = keyed.groupBy("id").agg(F.min("_key").alias("_key"), F.max("_key").alias("other"))
        replies = replies.join(ids.filter(F.col("_key") == F.col("other")), "id")
    readable = replies.filter(F.schema_of_variant(verdict).startswith("OBJECT"))
    first = readable.groupBy("_key").agg(F.min("body").alias("body"))  # one reply decides
    rows = keyed.join(first.select("_key", verdict.alias("v")), "_key", "left")
    v = F.col("v")
    confidence = F.coalesce(_get(v, "$.confidence", "double"), F.lit(0.5))
    vulnerable = F.coalesce(_get(v, "$.is_vulnerable", "boolean"), F.lit(False))
    owasp = F.nullif(_get(v, "$.owasp_ref"), F.lit(""))
    kept = rows.filter(v.isNull() | (vulnerable & (confidence >= CONFIDENCE_THRESHOLD)))
    return (kept.withColumn("confidence", F.when(v.isNull(), F.col("confidence"))
                            .otherwise(confidence))
            .withColumn("description", F.coalesce(_get(v, "$.explanation"), F.col("description")))
            .withColumn("cwe", F.coalesce(F.concat(F.lit("OWASP LLM "), owasp), F.col("cwe")))
            .select(*findings.columns))


def compliance_replies(replies: DataFrame) -> DataFrame:
    """Findings of ``replies(repo_id, body)``: the five most severe items of each reply, ties in
    order; critical counts as high. All of it happens inside the reply's row."""
    items = _get(F.try_parse_json(json_block(F.col("body"), "[", "]")), "$", "array<variant>")
    objects = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))

    def item(x: Column, pos: Column) -> Column:
        severity = lookup(CAPPED_SEVERITY, _get(x, "$.severity"), "medium")
        return F.struct((-severity_rank(severity)).alias("rank"), pos.alias("pos"),
                        severity.alias("severity"), x.alias("x"))

    def sooner(a: Column, b: Column) -> Column:
        first = (a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["pos"] < b["pos"]))
        return F.when(first, -1).otherwise(1)

    ranked = F.slice(F.array_sort(F.transform(objects, item), sooner), 1, MAX_COMPLIANCE_FINDINGS)
    rows = replies.select("repo_id", F.posexplode(ranked).alias("place", "item"))
    x = F.col("item.x")
    title, remedy = _get(x, "$.title"), F.coalesce(_get(x, "$.remediation"), F.lit(""))
    return as_findings(
        rows, analyzer="compliance", tool="llm-compliance", ord=F.col("place") + 1000,
        title=F.coalesce(title, F.lit("Compliance gap")), severity=F.col("item.severity"),
        category=lookup(COMPLIANCE_CATEGORIES, _get(x, "$.category"), "compliance_gdpr"),
        file=_get(x, "$.file"), description=F.coalesce(_get(x, "$.description"), F.lit("")),
        remediation=remedy,
        ai_prompt=F.concat(F.lit("Fix compliance issue: "), F.coalesce(title, F.lit("")),
                           F.lit(". "), remedy),
        compliance_ref=_get(x, "$.compliance_ref"), confidence=0.7)


def digests(findings: DataFrame) -> DataFrame:
    """(repo_id, digest): totals, counts by severity and category, the fifteen most severe.

    Reads the findings three times, so hand in a stored table. Counts are combined before the
    shuffle; the ranking keeps fifteen rows per repository and task.
    """
    cells = findings.groupBy("repo_id", "severity", "category").agg(F.count("*").alias("n"))

    def counted(name: str) -> DataFrame:
        per = cells.groupBy("repo_id", name).agg(F.sum("n").alias("n"))
        text = F.concat(F.col(name), F.lit("="), F.col("n"))
        return per.groupBy("repo_id").agg(
            F.array_join(F.array_sort(F.collect_list(text)), ", ").alias(f"by_{name}"),
            F.sum("n").alias(f"total_{name}"))

    order = Window.partitionBy("repo_id").orderBy(
        (-severity_rank(F.col("severity"))), *emission_order())
    top = findings.withColumn("pos", F.row_number().over(order)).filter(
        F.col("pos") <= DIGEST_FINDINGS)
    line = F.concat(
        F.lit("- ["), F.upper("severity"), F.lit("] "), F.col("title"), F.lit(" @ "),
        location(F.col("file"), F.col("line"), "?"), F.lit(": "),
        F.left("description", F.lit(DIGEST_CHARS)))
    lines = top.groupBy("repo_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", line.alias("text")))),
        lambda x: x["text"]), "\n").alias("lines"))
    rows = counted("severity").join(counted("category"), "repo_id").join(lines, "repo_id")
    return rows.select("repo_id", F.concat_ws(
        "\n", F.concat(F.lit("Total: "), F.col("total_severity"), F.lit(" findings")),
        F.concat(F.lit("By severity: "), "by_severity"),
        F.concat(F.lit("By category: "), "by_category"), F.lit(""),
        F.lit("All issues (by severity):"), "lines").alias("digest"))


def summary_replies(replies: DataFrame) -> DataFrame:
    """Info findings of ``replies(repo_id, body)``: the summary and one per remediation prompt."""
    doc = F.try_parse_json(json_block(F.col("body"), "{", "}"))
    rows = replies.select("repo_id", doc.alias("doc"))
    summary = F.nullif(_get(F.col("doc"), "$.executive_summary"), F.lit(""))
    first = F.when(summary.isNotNull(), F.array(F.struct(
        F.lit(0).alias("ord"), F.lit("Executive Summary").alias("title"),
        summary.alias("description"),
        F.lit("See individual findings for specific fixes.").alias("remediation"),
        F.lit("").alias("ai_prompt"), F.lit(1.0).alias("confidence"))))

    def remedy(x: Column, i: Column) -> Column:
        title = _get(x, "$.title")
        prompt = F.coalesce(_get(x, "$.prompt"), F.lit(""))
        return F.struct(
            (i + 1).alias("ord"),
            F.concat(F.lit("Remediation: "), F.coalesce(title, F.lit("Fix"))).alias("title"),
            F.concat(F.lit("AI-generated remediation for: "), F.coalesce(title, F.lit("")))
             .alias("description"),
            prompt.alias("remediation"), prompt.alias("ai_prompt"), F.lit(0.9).alias("confidence"))

    prompts = F.filter(_get(F.col("doc"), "$.remediation_prompts", "array<variant>"),
                       lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    both = F.flatten(F.array_compact(F.array(first, F.transform(prompts, remedy))))
    rows = rows.select("repo_id", F.inline(both))
    return as_findings(
        rows, analyzer="llm_summarizer", category="llm_review", severity="info",
        tool="llm-summarizer", **{c: F.col(c) for c in (
            "ord", "title", "description", "remediation", "ai_prompt", "confidence")})


def token_budget(calls: DataFrame, budget: int = TOKEN_BUDGET,
                 width: int = 100_000) -> DataFrame:
    """``calls(client, seq, tokens)`` with ``used_before`` and ``admitted``.

    A call is admitted while the tokens of the client's earlier calls are below the budget, so the
    last one may overshoot; refused calls add nothing, but by then the plain running sum is at the
    budget as well. The running sum is taken in two steps, over blocks of ``width`` sequence
    numbers and within a block, so that one busy client is spread over many tasks.
    """
    blocks = calls.withColumn("block", F.floor(F.col("seq") / F.lit(width)))
    sums = blocks.groupBy("client", "block").agg(F.sum("tokens").alias("in_block"))
    earlier = Window.partitionBy("client").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    lead = sums.select("client", "block",
                       F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("lead"))
    within = Window.partitionBy("client", "block").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1)
    used = F.col("lead") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return (blocks.join(lead, ["client", "block"]).withColumn("used_before", used)
            .select("client", "seq", "tokens", "used_before",
                    (F.col("used_before") < budget).alias("admitted")))


def token_totals(calls: DataFrame, price: float = TOKEN_PRICE) -> DataFrame:
    """(repo_id, tokens, cost) of admitted ``calls(repo_id, client, tokens)``."""
    return calls.groupBy("repo_id").agg(F.sum("tokens").alias("tokens")).withColumn(
        "cost", F.round(F.col("tokens") * F.lit(price), 6))
