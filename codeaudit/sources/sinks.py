"""Exports: findings as JSON rows, scan results and Markdown reports as ordered text fragments.

A repository may own a third of all findings, so no document is assembled in one row. A document
is a set of rows (repo_id, section, place, text); its text is the fragments in that order, joined
by newlines. ``write_documents`` writes them that way, large documents over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.functions.text import location
from codeaudit.model import FINDING_SCHEMA, emission_order, severity_rank

# --- fixed values -----------------------------------------------------------
SEVERITY_SIGN = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
FINDING_FIELDS = ["title", "severity", "category", "description", "remediation", "tool", "id",
                  "file", "line", "ai_prompt", "evidence", "cwe", "compliance_ref", "confidence"]
# ----------------------------------------------------------------------------


def findings_json(findings: DataFrame) -> DataFrame:
    """(repo_id, analyzer, ord, json): a finding per row with all fields, nulls included."""
    text = F.to_json(F.struct(*FINDING_FIELDS), {"ignoreNullFields": "false"})
    return findings.select("repo_id", "analyzer", "ord", text.alias("json"))


def findings_from_json(rows: DataFrame) -> DataFrame:
    """The reverse of ``findings_json``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FINDING_SCHEMA
                       if f.name in FINDING_FIELDS)
    return rows.select("repo_id", "analyzer", "ord", F.from_json("json", schema).alias("f")).select(
        "repo_id", "analyzer", "ord", "f.*").select(*FINDING_SCHEMA.names)


def _place() -> Column:
    return F.struct(*[c.cast("string" if i in (2, 4) else "double").alias(f"k{i}")
                      for i, c in enumerate(emission_order())])


def _nowhere() -> Column:
    return F.struct(*[F.lit("" if i in (2, 4) else 0).cast("string" if i in (2, 4) else "double")
                      .alias(f"k{i}") for i in range(len(emission_order()))])


def json_documents(scorecards: DataFrame, findings: DataFrame) -> DataFrame:
    """Fragments of one JSON document per repository: the result's fields, then each finding."""
    one = lambda c: F.round(c, 1)
    head = F.to_json(F.struct(
        one("score").alias("score"), "grade", "verdict",
        F.round("scan_time", 2).alias("scan_time"), F.col("repo_id").alias("repo_path"),
        F.col("languages").alias("languages_detected"), "files_scanned", "tokens_used",
        F.transform_values("category_scores", lambda k, v: one(v)).alias("category_scores"),
        "findings_count"), {"ignoreNullFields": "false"})
    head = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"findings":['))
    top = scorecards.select("repo_id", F.lit(0).alias("section"), _nowhere().alias("place"),
                            head.alias("text"))
    rows = findings.withColumn("place", _place())
    # what stands first has no comma in front of it: the few findings at a repository's least place
    # (as a rule one) are one fragment, all others follow with a comma each
    least = rows.groupBy("repo_id").agg(F.min("place").alias("least"))
    told = (findings_json(rows.withColumn("ord", F.col("place"))).withColumnRenamed("ord", "place")
            .join(least, "repo_id"))
    first = (told.filter(F.col("place") == F.col("least")).groupBy("repo_id", "place")
             .agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("text"))
             .select("repo_id", F.lit(1).alias("section"), "place", "text"))
    others = told.filter(F.col("place") != F.col("least")).select(
        "repo_id", F.lit(1).alias("section"), "place",
        F.concat(F.lit(","), "json").alias("text"))
    body = first.unionByName(others)
    end = scorecards.select("repo_id", F.lit(2).alias("section"), _nowhere().alias("place"),
                            F.lit("]}").alias("text"))
    return top.unionByName(body).unionByName(end)


def markdown_documents(scorecards: DataFrame, findings: DataFrame) -> DataFrame:
    """Fragments of one Markdown report per repository: metrics, category scores from low to high
    with a bar of ten cells, each critical and high finding, counts by severity."""
    s = scorecards
    sign = lambda sev: F.element_at(F.create_map(
        *[F.lit(x) for kv in SEVERITY_SIGN.items() for x in kv]), sev)
    title = F.concat_ws(
        "\n", F.lit("## 🔍 Audit Report"), F.lit(""),
        F.concat(F.lit("**Score:** "), F.format_string("%.0f", F.bround("score", 0)),
                 F.lit("/100 ("), "grade", F.lit(") — "), "verdict"), F.lit(""),
        F.lit("| Metric | Value |"), F.lit("|--------|-------|"),
        F.concat(F.lit("| Files Scanned | "), "files_scanned", F.lit(" |")),
        F.concat(F.lit("| Languages | "), F.when(F.size("languages") > 0, F.array_join(
            "languages", ", ")).otherwise("N/A"), F.lit(" |")),
        F.concat(F.lit("| Scan Time | "), F.format_string("%.1f", "scan_time"), F.lit("s |")),
        F.concat(F.lit("| Findings | "), "findings_count", F.lit(" |")),
        F.concat(F.lit("| LLM Tokens | "), "tokens_used", F.lit(" |")), F.lit(""))
    ordered = F.array_sort(F.transform(F.map_entries("category_scores"), lambda e: F.struct(
        e["value"].alias("score"), e["key"].alias("grp"))))
    cell = lambda x: F.concat(
        F.lit("| "), F.initcap(F.replace(x["grp"], F.lit("_"), F.lit(" "))), F.lit(" | "),
        F.format_string("%.0f", F.bround(x["score"], 0)), F.lit(" "),
        F.repeat(F.lit("🟩"), F.floor(x["score"] / 10).cast("int")),
        F.repeat(F.lit("⬜"), 10 - F.floor(x["score"] / 10).cast("int")), F.lit(" |"))
    table = F.concat_ws("\n", F.lit("### Category Scores"), F.lit(""),
                        F.lit("| Category | Score |"), F.lit("|----------|-------|"),
                        F.array_join(F.transform(ordered, cell), "\n"), F.lit(""))
    has_groups = F.col("category_scores").isNotNull() & (F.size("category_scores") > 0)
    head = s.select("repo_id", F.lit(0).alias("section"), _nowhere().alias("place"), F.concat(
        title, F.when(has_groups, F.concat(F.lit("\n"), table)).otherwise("")).alias("text"))
    rows = findings.filter(F.col("severity").isin("critical", "high")).withColumn(
        "place", _place())
    heading = rows.select("repo_id").distinct().select(
        "repo_id", F.lit(1).alias("section"), _nowhere().alias("place"),
        F.lit("### 🚨 Critical & High Findings\n").alias("text"))
    prompt = F.when(F.col("ai_prompt") != "", F.concat_ws(
        "\n", F.lit(""), F.lit("**Cursor/Copilot Prompt:**"), F.lit("```"), "ai_prompt",
        F.lit("```")))
    details = rows.select("repo_id", F.lit(2).alias("section"), "place", F.concat_ws(
        "\n", F.lit("<details>"),
        F.concat(F.lit("<summary>"), sign(F.col("severity")), F.lit(" <b>"), "title",
                 F.lit("</b> — <code>"), location(F.col("file"), F.col("line"), "—"),
                 F.lit("</code></summary>")), F.lit(""),
        F.concat(F.lit("**Severity:** "), F.upper("severity"), F.lit("  ")),
        F.concat(F.lit("**Description:** "), "description", F.lit("  ")),
        F.concat(F.lit("**Remediation:** "), "remediation", F.lit("  ")), prompt,
        F.lit("</details>"), F.lit("")).alias("text"))
    counts = findings.groupBy("repo_id", "severity").agg(F.count("*").alias("n"))
    line = F.struct((-severity_rank(F.col("severity"))).alias("pos"), F.concat(
        F.lit("- "), sign(F.col("severity")), F.lit(" **"), F.upper("severity"), F.lit("**: "),
        "n").alias("text"))
    summary = counts.groupBy("repo_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n").alias("lines"))
    summary = summary.select("repo_id", F.lit(3).alias("section"), _nowhere().alias("place"),
                             F.concat(F.lit("### Summary\n\n"), "lines", F.lit("\n"))
                             .alias("text"))
    end = s.select("repo_id", F.lit(4).alias("section"), _nowhere().alias("place"),
                   F.lit("---\n*Generated by codeaudit*").alias("text"))
    out = head
    for part in (heading, details, summary, end):
        out = out.unionByName(part)
    return out


def write_documents(fragments: DataFrame, path: str) -> None:
    """Text files per repository whose lines, in name order, are the document. Rows are
    range-partitioned by their place, so a large document is written by several tasks."""
    (fragments.repartitionByRange("repo_id", "section", "place")
     .sortWithinPartitions("repo_id", "section", "place")
     .select("repo_id", F.col("text").alias("value"))
     .write.partitionBy("repo_id").option("lineSep", "\n").text(path))
