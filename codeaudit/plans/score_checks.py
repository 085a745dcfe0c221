"""Registered queries: scores, gates, aggregates, exports, the whole audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeaudit.model import (
    ANALYZERS, GRADES, GROUP_OF_ANALYZER, GROUP_OF_CATEGORY, LAST_VERDICT, PENALTIES, VERDICTS,
    WEIGHTS, emission_order, severity_rank,
)
from codeaudit.operators import dependencies, manifests, review, rules, scoring, secrets
from codeaudit.model import emit
from codeaudit.plans import audit
from codeaudit.plans.code_checks import exports_table
from codeaudit.plans.common import (
    FILES, ORACLE, REGISTRY, TRACKED, findings_sql, lines_cte, query, with_ctes,
)
from codeaudit.plans.corpus import Corpus, sql_text
from codeaudit.plans.dependency_checks import (
    CHECKED_SQL, PARSED_SQL, _POPULAR, _URL, _VULN, as_of,
)
from codeaudit.plans.rule_checks import _INVENTORY, _INVENTORY_DIRS, REPORT_LANG_SQL
from codeaudit.sources import files as S, sinks
from codeaudit.sources.registry import registry
from codeaudit.sources.work import stored

# --- SQL of the findings that are scored ------------------------------------------------------
_ANALYZER_OF = {"secrets_all": "secrets", "rules_sast": "sast", "rules_gdpr": "compliance",
                "rules_soc2": "compliance", "rules_injection": "prompt_injection"}
_ALL = {**_ANALYZER_OF, "hallucinated_imports": "hallucination", "next_env": "nextjs",
        "next_routes": "nextjs", "next_actions": "nextjs", "next_html": "nextjs",
        "cost_models": "cost_efficiency", "cost_resources": "cost_efficiency",
        "cost_repeat_calls": "cost_efficiency", "cost_bloat": "cost_efficiency"}


def _findings_cte(parts: dict[str, str], extra: str = "") -> str:
    return "findings AS (" + "\nUNION ALL BY NAME\n".join(
        f"SELECT '{a}' AS analyzer, * FROM ({ORACLE[q]})" for q, a in parts.items()) + extra + ")"


def _case(column: str, mapping: dict[str, object], default: object) -> str:
    return (f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items())
            + f" ELSE {default} END")


_RANK = "list_position([" + ", ".join(f"'{a}'" for a in ANALYZERS) + "], analyzer)"
_SEV = "list_position(['info', 'low', 'medium', 'high', 'critical'], severity)"
_ORDER = f"{_RANK}, ord, coalesce(file, ''), coalesce(line, 0), id, confidence"
_GROUP = _case("category", GROUP_OF_CATEGORY, "'code_quality'")
SCORES_SQL = f"""ranked AS (SELECT *, {_GROUP} AS grp, {_case('severity', PENALTIES, 0)} AS penalty,
  row_number() OVER (PARTITION BY repo_id, {_GROUP}
    ORDER BY {_case('severity', PENALTIES, 0)} DESC, {_ORDER}) AS n FROM findings),
group_scores AS (SELECT repo_id, grp, count(*) AS n_findings, greatest(100 - sum(
    CAST(penalty AS DECIMAL(4, 0)) * CAST(confidence AS DECIMAL(8, 6))
    * CASE WHEN n <= 3 THEN 1.00 WHEN n <= 5 THEN 0.50 ELSE 0.25 END), 0) AS score
  FROM ranked GROUP BY repo_id, grp)"""
RUNS_SQL = f"""runs AS (SELECT repo_id, a AS analyzer, CASE WHEN length(repo_id) = 6
    AND a IN ('dependencies', 'cost_efficiency') THEN 'failed' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT repo_id FROM files), (SELECT unnest([{', '.join(f"'{a}'" for a in ANALYZERS)}]) AS a))"""
COMPOSITE_SQL = f"""scanned AS (SELECT DISTINCT repo_id, {_case('analyzer', GROUP_OF_ANALYZER, 'NULL')} AS grp FROM runs),
all_scores AS (SELECT repo_id, grp, n_findings, CAST(score AS DECIMAL(18, 8)) AS score FROM group_scores
  UNION ALL SELECT repo_id, grp, 0, 100 FROM scanned s WHERE grp IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM group_scores g WHERE g.repo_id = s.repo_id AND g.grp = s.grp)),
weighted AS (SELECT *, CAST({_case('grp', {k: float(v) for k, v in WEIGHTS.items()}, 0.05)}
  AS DECIMAL(4, 3)) AS weight FROM all_scores),
sums AS (SELECT repo_id, CAST(sum(CAST(CAST(score AS DECIMAL(38, 8)) * 100000000 AS HUGEINT) * CAST(weight * 1000 AS HUGEINT))
    AS HUGEINT) AS x, CAST(sum(CAST(weight * 1000 AS HUGEINT)) AS HUGEINT) * 100000000 AS y
  FROM weighted GROUP BY repo_id),
composite AS (SELECT repo_id, CAST((20 * x + y) // (2 * y) AS DOUBLE) / 10 AS score FROM sums)"""
_GRADE = "CASE " + " ".join(f"WHEN score >= {b} THEN '{g}'" for b, g in GRADES) + " ELSE 'F' END"
_VERDICT = ("CASE " + " ".join(f"WHEN score >= {b} THEN '{v}'" for b, v in VERDICTS)
            + f" ELSE '{LAST_VERDICT}' END")
_SCORED = [FILES, _findings_cte(_ANALYZER_OF), SCORES_SQL]


def scored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and rule families in one pass: what the score queries work on."""
    files = rules.with_calls(S.with_language(Corpus(spark, sf_dir).files, keep_others=True))
    return emit(files, [*secrets.secret_checks(), *[rules.rule_check(f) for f in audit.FAMILIES]])


def _repos(c: Corpus) -> DataFrame:
    return c.names.select("repo_id").distinct()


def runs_of(c: Corpus) -> DataFrame:
    failed = (F.length("repo_id") == 6) & F.col("analyzer").isin("dependencies", "cost_efficiency")
    return _repos(c).select("repo_id", F.explode(F.array(*[F.lit(a) for a in ANALYZERS]))
                            .alias("analyzer")).withColumn(
        "status", F.when(failed, "failed").otherwise("ok"))


@query("score_groups", with_ctes(*_SCORED, select="""
SELECT repo_id, grp, n_findings, round(CAST(score AS DOUBLE), 4) AS score FROM group_scores"""))
def score_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.group_scores(scored_findings(spark, sf_dir)).withColumn(
        "score", F.round(F.col("score").cast("double"), 4))


def _scores(spark: SparkSession, sf_dir: str, **kw: object) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return scoring.with_clean_groups(scoring.group_scores(scored_findings(spark, sf_dir)),
                                     scoring.scanned_runs(runs_of(c), **kw))


@query("score_composite", with_ctes(*_SCORED, RUNS_SQL, COMPOSITE_SQL,
                                    select="SELECT repo_id, score FROM composite"))
def score_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.composite(_scores(spark, sf_dir), _repos(Corpus(spark, sf_dir)))


@query("score_grades", with_ctes(*_SCORED, RUNS_SQL, COMPOSITE_SQL.replace(
    "FROM runs)", "FROM runs WHERE status = 'ok' AND analyzer NOT IN ('compliance', 'prompt_injection', 'llm_summarizer'))"),
    select=f"SELECT repo_id, score, {_GRADE} AS grade, {_VERDICT} AS verdict FROM composite"))
def score_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded in fast mode, failed analyzers not counted as clean."""
    return scoring.graded(scoring.composite(_scores(spark, sf_dir, mode="fast", only_ok=True)))


@query("score_strict_groups", with_ctes(FILES, _findings_cte(
    {k: _ALL[k] for k in ("hallucinated_imports", "next_env", "next_routes", "rules_sast")}),
    SCORES_SQL.replace(_GROUP, _case("category", GROUP_OF_CATEGORY | {
        "hallucinated_import": "dependencies", "framework_specific": "sast"}, "'code_quality'")),
    select="SELECT repo_id, grp, n_findings, round(CAST(score AS DOUBLE), 4) AS score FROM group_scores"))
def score_strict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups when import and framework findings count for their analyzers' groups."""
    from codeaudit.operators import frontend, known_exports
    files = Corpus(spark, sf_dir).files
    found = (known_exports.hallucinated_imports(files, exports_table(spark))
             .unionByName(frontend.next_findings(files).filter("ord <= 2"))
             .unionByName(rules.rule_findings(files, "sast")))
    return scoring.group_scores(found, strict_groups=True).withColumn(
        "score", F.round(F.col("score").cast("double"), 4))


@query("gate_severity", with_ctes(*_SCORED[:2], select=f"""
SELECT r.repo_id, count(f.id) > 0 AS blocked, count(f.id) AS n
FROM (SELECT DISTINCT repo_id FROM files) r LEFT JOIN findings f
  ON f.repo_id = r.repo_id AND {_SEV} >= 5 GROUP BY r.repo_id"""))
def gate_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_gate(scored_findings(spark, sf_dir), _repos(Corpus(spark, sf_dir)),
                                 "critical")


@query("gate_score", with_ctes(*_SCORED, RUNS_SQL, COMPOSITE_SQL, select="""
SELECT repo_id, score < 60 AS failed FROM composite"""))
def gate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_gate(scoring.composite(_scores(spark, sf_dir)), 60)


@query("severity_filter", with_ctes(*_SCORED[:2], select="""
SELECT repo_id, file, line, title, severity FROM findings WHERE severity IN ('critical', 'low')"""))
def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_filter(scored_findings(spark, sf_dir), [" Critical", "low"]).select(
        "repo_id", "file", F.col("line").cast("bigint").alias("line"), "title", "severity")


@query("severity_counts", with_ctes(*_SCORED[:2], select=f"""
SELECT repo_id, severity, count(*) AS n, CAST(6 - {_SEV} AS BIGINT) AS pos FROM findings
GROUP BY ALL"""))
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_counts(scored_findings(spark, sf_dir)).withColumn(
        "pos", F.col("pos").cast("bigint"))


@query("breakdown", with_ctes(*_SCORED, RUNS_SQL, COMPOSITE_SQL, select="""
SELECT repo_id, grp, round(CAST(score AS DOUBLE), 4) AS score,
  CAST(floor(score / 10) AS BIGINT) AS bar, n_findings FROM all_scores"""))
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.breakdown(_scores(spark, sf_dir))
    return rows.withColumn("score", F.round("score", 4)).withColumn("bar", F.col("bar").cast("bigint"))


@query("urgent_findings", with_ctes(*_SCORED[:2], select=f"""
SELECT repo_id, analyzer, CASE WHEN coalesce(file, '') <> '' AND coalesce(line, 0) <> 0
    THEN file || ':' || line WHEN coalesce(file, '') <> '' THEN file ELSE '—' END AS location,
  title, severity FROM findings WHERE {_SEV} >= 4"""))
def urgent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeaudit.functions.text import location
    rows = scoring.urgent(scored_findings(spark, sf_dir))
    return rows.select("repo_id", "analyzer", location(F.col("file"), F.col("line"), "—")
                       .alias("location"), "title", "severity")


@query("findings_digest", with_ctes(*_SCORED[:2], f"""
top AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_SEV} DESC, {_ORDER}) AS n
  FROM findings),
lines AS (SELECT repo_id, string_agg('- [' || upper(severity) || '] ' || title || ' @ '
    || CASE WHEN coalesce(line, 0) <> 0 THEN file || ':' || line ELSE coalesce(file, '?') END || ': '
    || left(description, 120), chr(10) ORDER BY n) AS listed FROM top WHERE n <= 15 GROUP BY repo_id),
sev AS (SELECT repo_id, string_agg(severity || '=' || n, ', ' ORDER BY severity) AS t, sum(n) AS total
  FROM (SELECT repo_id, severity, count(*) AS n FROM findings GROUP BY ALL) GROUP BY repo_id),
cat AS (SELECT repo_id, string_agg(category || '=' || n, ', ' ORDER BY category) AS t
  FROM (SELECT repo_id, category, count(*) AS n FROM findings GROUP BY ALL) GROUP BY repo_id)""",
    select="""
SELECT repo_id, concat_ws(chr(10), 'Total: ' || total || ' findings', 'By severity: ' || sev.t,
  'By category: ' || cat.t, '', 'All issues (by severity):', listed) AS digest
FROM sev JOIN cat USING (repo_id) JOIN lines USING (repo_id)"""))
def findings_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.digests(stored(scored_findings(spark, sf_dir), "findings"))


# --- the whole audit --------------------------------------------------------------------------
def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return audit.audit_findings(c.files, exports_table(spark), registry(c.registry_raw), as_of())


_DEP = dict(analyzer="'dependencies'", file="manifest", line="CAST(NULL AS BIGINT)")
_DEP_SQL = with_ctes(FILES, lines_cte(), PARSED_SQL, """
deps AS (SELECT repo_id, manifest, manifest_rank * 1000 + len(string_split(manifest, '/'))
  AS manifest_rank, package, ecosystem, requested, line_no AS ord FROM declared)""",
    REGISTRY, _POPULAR, CHECKED_SQL, select="\nUNION ALL\n".join([
        findings_sql("checked", **_DEP, category="'hallucinated_dependency'", ord="1",
                     severity="'critical'", title="'Hallucinated Package: ' || package",
                     description="''", where="http_status = 404"),
        findings_sql("stale", **_DEP, category=_VULN, severity="sev", ord="2", confidence="0.9",
                     title="'Outdated Package: ' || package", description="''",
                     where="http_status = 200 AND why IS NOT NULL"),
        findings_sql("checked", **_DEP, category=_VULN, severity="'high'", ord="3",
                     title="'Suspicious Low-Download Package: ' || package", description="''",
                     where="http_status = 200 AND loads < 100"),
        findings_sql("checked", **_DEP, category=_VULN, severity="'medium'", ord="4",
                     confidence="0.7", title="'Possible Typosquat: ' || package",
                     description="''", where='http_status = 200 AND "similar" IS NOT NULL')]))
_AUDIT = [FILES, TRACKED, _INVENTORY, _findings_cte(
    _ALL, f"\nUNION ALL BY NAME\nSELECT 'dependencies' AS analyzer, * FROM ({_DEP_SQL})")]


@query("audit_findings", with_ctes(*_AUDIT, select="""
SELECT analyzer, repo_id, ord, file, line, title, severity, category, confidence, id
FROM findings"""))
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).select(
        "analyzer", "repo_id", "ord", "file", F.col("line").cast("bigint").alias("line"), "title",
        "severity", "category", "confidence", "id")


@query("scorecard", with_ctes(*_AUDIT, SCORES_SQL, RUNS_SQL, COMPOSITE_SQL, f"""
langs AS (SELECT repo_id, coalesce(string_agg(DISTINCT {REPORT_LANG_SQL}, ',' ORDER BY
    {REPORT_LANG_SQL}), '') AS languages, count(*) FILTER (ext IN (
    {', '.join(f"'{e}'" for e in S.SCANNABLE)})) AS files_scanned FROM inventory GROUP BY repo_id),
groups AS (SELECT repo_id, string_agg(grp || '=' || CAST(CAST(floor(score * 10 + 0.5) AS DECIMAL(10, 0))
    / 10 AS DECIMAL(10, 1)), ';' ORDER BY grp) AS category_scores, CAST(sum(n_findings) AS BIGINT) AS n
  FROM all_scores GROUP BY repo_id)""", select=f"""
SELECT repo_id, score, {_GRADE} AS grade, {_VERDICT} AS verdict, n AS findings_count, category_scores,
  coalesce(languages, '') AS languages, coalesce(files_scanned, 0) AS files_scanned
FROM composite JOIN groups USING (repo_id) LEFT JOIN langs USING (repo_id)"""))
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every analyzer over every repository, scored and graded: the flagship query."""
    c = Corpus(spark, sf_dir)
    cards = scoring.scorecard(audited(spark, sf_dir), runs_of(c),
                              S.inventory(c.names, c.tracked, c.git_repos))
    groups = F.transform(F.map_entries("category_scores"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("decimal(10,1)").cast("string")))
    return cards.select("repo_id", "score", "grade", "verdict", "findings_count",
                        F.array_join(groups, ";").alias("category_scores"),
                        F.array_join("languages", ",").alias("languages"), "files_scanned")


# --- exports ----------------------------------------------------------------------------------
def _cards(spark: SparkSession, sf_dir: str, findings: DataFrame) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return scoring.scorecard(findings, runs_of(c), S.inventory(c.names))


@query("export_roundtrip", ORACLE["rules_sast"])
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings to JSON rows and back."""
    from codeaudit.plans.common import shown
    found = rules.rule_findings(Corpus(spark, sf_dir).files, "sast")
    return shown(sinks.findings_from_json(sinks.findings_json(found)))


_PLACE = f"""CAST({_RANK} AS DOUBLE) AS k0, CAST(ord AS DOUBLE) AS k1, coalesce(file, '') AS k2,
  CAST(coalesce(line, 0) AS DOUBLE) AS k3, id AS k4, confidence AS k5"""
_NOWHERE = "0.0::DOUBLE AS k0, 0.0::DOUBLE AS k1, '' AS k2, 0.0::DOUBLE AS k3, '' AS k4, 0.0::DOUBLE AS k5"
_TOLD = f"""told AS (SELECT *, CASE analyzer WHEN 'secrets' THEN 'secret-scanner' ELSE 'semgrep' END AS tool,
  CASE analyzer WHEN 'secrets' THEN ['Revoke the credential and read it from an environment variable.',
      'Move the value to an environment variable or a secrets manager.',
      'Verify the value; move it out of the source if it is a secret.'][ord]
    WHEN 'sast' THEN 'Review the matched pattern and refactor according to secure coding guidelines. Rule: '
      || title || '.'
    WHEN 'prompt_injection' THEN {sql_text(rules.REMEDIATION['injection'])}
    ELSE {sql_text(rules.REMEDIATION['gdpr'])} END AS remediation,
  CASE analyzer WHEN 'secrets' THEN 'Take the secret on line ' || line || ' of ' || file || ' out of the source.'
    WHEN 'sast' THEN 'Review ' || file || ':' || line || ' — Semgrep rule ''' || title || ''' matched. Suggest a fix.'
    WHEN 'prompt_injection' THEN 'In ' || file || ' at line ' || line || ', user input flows into an LLM API '
      || 'call without sanitization. Refactor to use a template-based prompt with input validation.'
    ELSE 'Fix the compliance issue in ' || file || ' at line ' || line || ': ' || description END AS ai_prompt,
  CAST(NULL AS VARCHAR) AS compliance_ref FROM findings)"""
_CARDS = [*_SCORED[:2], _TOLD, SCORES_SQL, RUNS_SQL, COMPOSITE_SQL, f"""langs AS (SELECT repo_id,
    coalesce(list(DISTINCT {REPORT_LANG_SQL} ORDER BY {REPORT_LANG_SQL}) FILTER ({REPORT_LANG_SQL} IS NOT NULL), [])
      AS languages, count(*) FILTER (ext IN ({', '.join(f"'{e}'" for e in S.SCANNABLE)})) AS n_files
  FROM files WHERE {_INVENTORY_DIRS} GROUP BY repo_id)""", f"""
cats AS (SELECT repo_id, grp, n_findings,
  CAST(CAST(floor(score * 10 + 0.5) AS DECIMAL(10, 0)) / 10 AS DECIMAL(10, 1)) AS score FROM all_scores),
cards AS (SELECT repo_id, score, {_GRADE} AS grade, {_VERDICT} AS verdict,
    coalesce(languages, []) AS languages, coalesce(n_files, 0) AS files_scanned, n
  FROM composite LEFT JOIN langs USING (repo_id)
  JOIN (SELECT repo_id, CAST(sum(n_findings) AS BIGINT) AS n FROM all_scores GROUP BY repo_id) USING (repo_id))"""]


def _fragments(documents: DataFrame) -> DataFrame:
    return documents.select("repo_id", F.col("section").cast("bigint").alias("section"), "place.*", "text")


@query("export_json", with_ctes(*_CARDS, f"""
rows AS (SELECT repo_id, {_PLACE}, to_json({{{', '.join(f"'{f}': {f}" for f in sinks.FINDING_FIELDS)}}})::VARCHAR
  AS json FROM told),
least AS (SELECT repo_id, min(row(k0, k1, k2, k3, k4, k5)) AS p FROM rows GROUP BY repo_id),
led AS (SELECT r.*, row(k0, k1, k2, k3, k4, k5) = p AS leads FROM rows r JOIN least USING (repo_id)),
groups AS (SELECT repo_id, string_agg(to_json(grp)::VARCHAR || ':' || score, ',' ORDER BY grp) AS listed
  FROM cats GROUP BY repo_id)""", select=f"""
SELECT repo_id, 0::BIGINT AS section, {_NOWHERE}, '{{"score":' || score || ',"grade":"' || grade || '","verdict":"'
  || verdict || '","scan_time":0.0,"repo_path":' || to_json(repo_id)::VARCHAR || ',"languages_detected":'
  || to_json(languages)::VARCHAR || ',"files_scanned":' || files_scanned || ',"tokens_used":0,"category_scores":{{'
  || listed || '}},"findings_count":' || n || ',"findings":[' AS text FROM cards JOIN groups USING (repo_id)
UNION ALL SELECT repo_id, 1, k0, k1, k2, k3, k4, k5, string_agg(json, ',' ORDER BY json) FROM led WHERE leads
  GROUP BY repo_id, k0, k1, k2, k3, k4, k5
UNION ALL SELECT repo_id, 1, k0, k1, k2, k3, k4, k5, ',' || json FROM led WHERE NOT leads
UNION ALL SELECT repo_id, 2, {_NOWHERE}, ']}}' FROM cards"""))
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of one JSON document per repository, with their places."""
    found = stored(scored_findings(spark, sf_dir), "findings")
    return _fragments(sinks.json_documents(_cards(spark, sf_dir, found), found))


_SIGN = _case("severity", sinks.SEVERITY_SIGN, "''")
_LOCATION = """CASE WHEN coalesce(file, '') <> '' AND coalesce(line, 0) <> 0 THEN file || ':' || line
  WHEN coalesce(file, '') <> '' THEN file ELSE '—' END"""


@query("export_markdown", with_ctes(*_CARDS, """
cells AS (SELECT repo_id, string_agg('| ' || array_to_string(list_transform(string_split(grp, '_'),
      lambda w: upper(w[1]) || w[2:]), ' ') || ' | ' || CAST(round_even(score, 0) AS BIGINT) || ' '
    || repeat('🟩', CAST(floor(score / 10) AS BIGINT)) || repeat('⬜', 10 - CAST(floor(score / 10) AS BIGINT))
    || ' |', chr(10) ORDER BY score, grp) AS listed FROM cats GROUP BY repo_id),
counts AS (SELECT repo_id, severity, count(*) AS n FROM told GROUP BY ALL)""", select=f"""
SELECT repo_id, 0::BIGINT AS section, {_NOWHERE}, concat_ws(chr(10), '## 🔍 Audit Report', '',
  '**Score:** ' || CAST(round_even(score, 0) AS BIGINT) || '/100 (' || grade || ') — ' || verdict, '',
  '| Metric | Value |', '|--------|-------|', '| Files Scanned | ' || files_scanned || ' |',
  '| Languages | ' || CASE WHEN len(languages) > 0 THEN array_to_string(languages, ', ') ELSE 'N/A' END || ' |',
  '| Scan Time | 0.0s |', '| Findings | ' || n || ' |', '| LLM Tokens | 0 |', '',
  '### Category Scores', '', '| Category | Score |', '|----------|-------|', listed, '') AS text
FROM cards JOIN cells USING (repo_id)
UNION ALL SELECT DISTINCT repo_id, 1, {_NOWHERE}, '### 🚨 Critical & High Findings' || chr(10) FROM told
  WHERE {_SEV} >= 4
UNION ALL SELECT repo_id, 2, {_PLACE}, concat_ws(chr(10), '<details>', '<summary>' || {_SIGN} || ' <b>' || title
    || '</b> — <code>' || {_LOCATION} || '</code></summary>', '', '**Severity:** ' || upper(severity) || '  ',
    '**Description:** ' || description || '  ', '**Remediation:** ' || remediation || '  ', '',
    '**Cursor/Copilot Prompt:**', '```', ai_prompt, '```', '</details>', '') FROM told WHERE {_SEV} >= 4
UNION ALL SELECT repo_id, 3, {_NOWHERE}, '### Summary' || chr(10) || chr(10) || string_agg('- ' || {_SIGN} || ' **'
    || upper(severity) || '**: ' || n, chr(10) ORDER BY {_SEV} DESC) || chr(10) FROM counts GROUP BY repo_id
UNION ALL SELECT repo_id, 4, {_NOWHERE}, '---' || chr(10) || '*Generated by codeaudit*' FROM cards"""))
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of one Markdown report per repository, with their places."""
    found = stored(scored_findings(spark, sf_dir), "findings")
    return _fragments(sinks.markdown_documents(_cards(spark, sf_dir, found), found))
