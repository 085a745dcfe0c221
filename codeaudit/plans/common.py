"""Shared pieces of the registered queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeaudit.plans.corpus import DEPS_SQL, FILES_SQL, REGISTRY_SQL, TRACKED_SQL, sql_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SHOWN = ["repo_id", "ord", "file", "line", "title", "severity", "category", "description", "evidence",
         "cwe", "confidence", "id"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL for the comparison engine."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def shown(findings: DataFrame) -> DataFrame:
    return findings.withColumn("line", F.col("line").cast("bigint")).select(*SHOWN)


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select


FILES, TRACKED, DEPS, REGISTRY = FILES_SQL, TRACKED_SQL, DEPS_SQL, REGISTRY_SQL

LANG_SQL = """CASE WHEN ext = '.py' THEN 'python' WHEN ext IN ('.js', '.jsx', '.mjs', '.cjs')
  THEN 'javascript' WHEN ext IN ('.ts', '.tsx') THEN 'typescript' END"""


def lines_cte(source: str = "files", name: str = "lines") -> str:
    return f"""{name} AS (
  SELECT repo_id, path, {LANG_SQL} AS lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
  FROM (SELECT *, string_split(CASE WHEN right(content, 1) = chr(10)
    THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS ls FROM {source}))"""


def matches_cte(name: str, pattern: str, where: str, groups: dict[str, int] | None = None,
                source: str = "files") -> str:
    """One row per match: ``line_no`` counts the newlines of everything in front of it."""
    p = sql_text(pattern)
    cols = "".join(f", regexp_extract_all(content, {p}, {g}) AS {n}_all"
                   for n, g in (groups or {}).items())
    picks = "".join(f", {n}_all[i] AS {n}" for n in (groups or {}))
    carried = "".join(f", {n}_all" for n in (groups or {}))
    return f"""{name} AS (
  SELECT repo_id, path, lang, content, i, hits[i] AS match{picks},
    1 + length(lead) - length(replace(lead, chr(10), '')) AS line_no
  FROM (SELECT *, array_to_string(pieces[1:i], '') || array_to_string(hits[1:i - 1], '') AS lead
    FROM (SELECT repo_id, path, lang, content, hits, pieces{carried},
        unnest(generate_series(1, len(hits))) AS i
      FROM (SELECT *, {LANG_SQL} AS lang, regexp_extract_all(content, {p}) AS hits,
          string_split_regex(content, {p}) AS pieces{cols}
        FROM {source}) WHERE {where})))"""


def id_sql(analyzer: str, category: str, title: str, file: str, line: str) -> str:
    return (f"'VA-' || upper(left(sha256(concat_ws('|', repo_id, {analyzer}, {category}, {title}, "
            f"{file}, CAST({line} AS VARCHAR))), 8))")


def findings_sql(source: str, *, analyzer: str, category: str, title: str, severity: str,
                 description: str, file: str = "path", line: str = "line_no",
                 evidence: str = "''", cwe: str = "CAST(NULL AS VARCHAR)",
                 confidence: str = "1.0", where: str = "TRUE", ord: str = "0") -> str:
    """SELECT of the shown findings columns; every argument is an SQL expression over source."""
    return f"""SELECT repo_id, CAST({ord} AS BIGINT) AS ord, {file} AS file, CAST({line} AS BIGINT) AS line, {title} AS title,
  {severity} AS severity, {category} AS category, {description} AS description,
  {evidence} AS evidence, {cwe} AS cwe, CAST({confidence} AS DOUBLE) AS confidence,
  {id_sql(analyzer, category, title, file, line)} AS id
FROM {source} WHERE {where}"""
