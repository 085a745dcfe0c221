"""The findings table: schema, ordered severities, categories and scoring dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

FINDING_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("analyzer", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("remediation", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("ai_prompt", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("compliance_ref", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

# --- fixed values -----------------------------------------------------------
SEVERITIES = ["info", "low", "medium", "high", "critical"]

PENALTIES = {"critical": 30, "high": 15, "medium": 7, "low": 3, "info": 0}

CATEGORIES = [
    "secret", "hallucinated_dependency", "hallucinated_import", "vulnerable_dependency",
    "sast", "compliance_gdpr", "compliance_soc2", "prompt_injection", "code_quality",
    "iac_security", "llm_review", "vibe_fingerprint", "framework_specific", "cost_efficiency",
]

GROUP_OF_CATEGORY = {
    "secret": "secrets",
    "hallucinated_dependency": "dependencies",
    "vulnerable_dependency": "dependencies",
    "sast": "sast",
    "compliance_gdpr": "compliance",
    "compliance_soc2": "compliance",
    "prompt_injection": "prompt_injection",
    "code_quality": "code_quality",
    "iac_security": "iac_security",
    "llm_review": "llm_review",
    "vibe_fingerprint": "code_quality",
    "cost_efficiency": "cost_efficiency",
}

GROUP_OF_ANALYZER = {
    "secrets": "secrets",
    "dependencies": "dependencies",
    "sast": "sast",
    "compliance": "compliance",
    "prompt_injection": "prompt_injection",
    "cost_efficiency": "cost_efficiency",
    "code_quality": "code_quality",
    "iac_security": "iac_security",
    "hallucination": "dependencies",
    "nextjs": "sast",
}

WEIGHTS = {
    "secrets": "0.200",
    "dependencies": "0.200",
    "sast": "0.150",
    "compliance": "0.150",
    "prompt_injection": "0.100",
    "cost_efficiency": "0.100",
    "code_quality": "0.050",
    "iac_security": "0.025",
    "llm_review": "0.025",
}
DEFAULT_GROUP = "code_quality"
DEFAULT_WEIGHT = "0.050"

ANALYZERS = [
    "secrets", "sast", "dependencies", "hallucination", "nextjs",
    "cost_efficiency", "compliance", "prompt_injection", "llm_summarizer",
]
FAST_ANALYZERS = ANALYZERS[:6]

GRADES = [
    (97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"),
    (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (60, "D"),
]
VERDICTS = [
    (80, "PRODUCTION READY"), (60, "NEEDS REMEDIATION"), (40, "NOT PRODUCTION READY"),
]
LAST_VERDICT = "CRITICAL — DO NOT DEPLOY"
# ----------------------------------------------------------------------------


def lookup(mapping: dict[str, object], key: Column, default: object = None) -> Column:
    """Literal map lookup; the map is a constant, so nothing is joined or shuffled."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(severity: Column) -> Column:
    """info=1 ... critical=5; 0 for an unknown name."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def analyzer_rank(analyzer: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in ANALYZERS]), analyzer).cast("int")


def emission_order() -> list[Column]:
    """Total order of a repository's findings: analyzer, check, place, content."""
    return [
        analyzer_rank(F.col("analyzer")), F.col("ord"), F.coalesce("file", F.lit("")),
        F.coalesce("line", F.lit(0)), F.col("id"), F.col("confidence"),
    ]


def finding_id(repo_id: Column, analyzer: Column, category: Column, title: Column,
               file: Column, line: Column) -> Column:
    key = F.concat_ws("|", repo_id, analyzer, category, title, file, line.cast("string"))
    return F.concat(F.lit("VA-"), F.upper(F.substring(F.sha2(key, 256), 1, 8)))


def finding_key() -> Column:
    """Full hash of all that tells findings apart, for joins; the short id is for display, and at
    millions of findings different ones share it."""
    told = ("repo_id", "analyzer", "ord", "category", "title", "file", "line", "description", "evidence")
    return F.sha2(F.to_json(F.struct(*told)), 256)


DEFAULTS: dict[str, object] = {
    "ord": 0, "file": None, "line": None, "ai_prompt": "", "evidence": "", "cwe": None,
    "compliance_ref": None, "confidence": 1.0,
}


def finding(**values: Column | str | int | float | None) -> Column:
    """A finding as a struct: each keyword names a field and gives a Column or a plain literal;
    what is left out takes its default. Repository and id are added by ``emit``."""
    cols = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (DEFAULTS | values).items()}
    return F.struct(*[cols[f.name].cast(f.dataType).alias(f.name) for f in FINDING_SCHEMA
                      if f.name in cols])


def _complete(rows: DataFrame) -> DataFrame:
    """The id is a content hash, so a rerun yields the same rows."""
    key = [F.col(c) for c in ("repo_id", "analyzer", "category", "title", "file", "line")]
    return rows.withColumn("id", finding_id(*key)).select(*FINDING_SCHEMA.names)


def emit(files: DataFrame, checks: Sequence[Column]) -> DataFrame:
    """Findings of any number of per-file checks in one pass over the files.

    Each check is an array of findings computed from the columns of a file's row, or null. All of
    them read the row where it was scanned; only findings leave it.
    """
    found = F.flatten(F.array_compact(F.array(*checks)))
    return _complete(files.select("repo_id", F.inline(found)))


def as_findings(df: DataFrame, **values: Column | str | int | float | None) -> DataFrame:
    """Project ``df`` (which carries ``repo_id``) onto the findings schema, one finding a row."""
    return _complete(df.select("repo_id", finding(**values).alias("f")).select("repo_id", "f.*"))


def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
