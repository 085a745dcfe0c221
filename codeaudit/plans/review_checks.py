"""Registered queries: compliance profile, reviews, token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeaudit.model import finding_key
from codeaudit.operators import profile, review, rules
from codeaudit.plans.common import FILES, ORACLE, lines_cte, query, shown, with_ctes
from codeaudit.plans.corpus import Corpus, sql_text
from codeaudit.plans.rule_checks import _none_of
from codeaudit.sources import files as S
from codeaudit.sources.work import stored

# --- profile ----------------------------------------------------------------------------------
_PROFILED = "ext IN ('.py', '.js', '.ts', '.jsx', '.tsx') AND " + _none_of(S.SKIP_PROFILE)
_VERB = ("CASE " + " ".join(f"WHEN contains(lower(line), '{v}') THEN '{v.upper()}'"
                            for v in profile.VERBS) + " ELSE '?' END")
_WORDS = (f"CASE WHEN ext = '.py' THEN regexp_extract_all(content, {sql_text(profile.PII_PYTHON)}, 1) "
          f"ELSE regexp_extract_all(content, {sql_text(profile.PII_SCRIPT)}, 1) END")
FACTS_SQL = rf"""scope AS (SELECT * FROM files WHERE {_PROFILED}),
scope_lines AS (SELECT l.*, s.ext FROM lines l JOIN scope s USING (repo_id, path)),
decorated AS (SELECT d.repo_id, d.path, d.line_no, d.line,
    (SELECT min(n.line_no) FROM lines n WHERE n.repo_id = d.repo_id AND n.path = d.path
      AND n.line_no > d.line_no AND NOT regexp_matches(n.line, '^\s*@')) AS def_no
  FROM scope_lines d WHERE d.ext = '.py' AND regexp_matches(d.line, '^\s*@')),
marks AS (SELECT d.*, regexp_extract(l.line, '^\s*def\s+(\w+)', 1) AS name FROM decorated d
  JOIN lines l ON l.repo_id = d.repo_id AND l.path = d.path AND l.line_no = d.def_no
  WHERE regexp_matches(l.line, '^\s*def\s+\w+')),
found_routes AS (
  SELECT repo_id, path, line_no AS pos, {_VERB} AS method,
    coalesce(nullif(regexp_extract(line, '^\s*@[\w.]+[(]\s*["'']([^"'']*)', 1), ''), '?') AS route_path
  FROM marks WHERE regexp_matches(line, 'route|get|post|put|delete|patch')
  UNION ALL
  SELECT repo_id, path, line_no, upper(g.a), g.b FROM (SELECT repo_id, path, line_no,
      regexp_extract(line, {sql_text(profile.SCRIPT_ROUTE)}, ['a', 'b']) AS g FROM scope_lines WHERE ext <> '.py' AND
        regexp_matches(line, {sql_text(profile.SCRIPT_ROUTE)}))
  UNION ALL
  SELECT repo_id, path, 1000000, 'API_ROUTE', path FROM scope WHERE ext <> '.py'
    AND (contains(path, 'pages/api/') OR contains(path, 'app/api/'))
    AND regexp_matches(content, {sql_text(profile.EXPORTED_FUNCTION)})),
all_routes AS (SELECT *, CASE WHEN method = 'API_ROUTE' THEN 'API_ROUTE ' || path
    ELSE method || ' ' || route_path || ' (' || path || ')' END AS route FROM found_routes),
auth AS (
  SELECT repo_id, path, name FROM marks WHERE regexp_matches(line, '{profile.AUTH_MARKS}')
  UNION ALL
  SELECT repo_id, path, 'middleware' FROM scope WHERE ext <> '.py'
    AND regexp_matches(content, {sql_text(profile.GUARD_WORDS)})
    AND regexp_matches(content, {sql_text(profile.GUARD_VERBS)})),
guarded AS (SELECT r.*, EXISTS (SELECT 1 FROM auth a WHERE a.repo_id = r.repo_id
  AND contains(r.route, a.name)) AS protected FROM all_routes r),
pii AS (SELECT repo_id, path, list_sort(list_distinct({_WORDS})) AS words FROM scope),
top_pii AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS n FROM pii
  WHERE len(words) > 0),
control AS (SELECT repo_id, CAST(sum(CASE WHEN ext = '.py'
      THEN len(regexp_extract_all(content, {sql_text(profile.LOG_CALL)}))
      WHEN contains(content, 'console.log') OR contains(content, 'console.error') THEN 1
      ELSE 0 END) AS BIGINT) AS log_calls,
    count(*) FILTER (CASE WHEN ext = '.py' THEN regexp_matches(content, {sql_text(profile.LOG_CALL)})
      ELSE contains(content, 'console.log') OR contains(content, 'console.error') END) AS log_files,
    bool_or(regexp_matches(lower(content), 'consent|gdpr')) AS consent,
    bool_or(contains(lower(content), 'delete') AND regexp_matches(lower(content), 'user|account'))
      AS deletion,
    bool_or(ext = '.py' AND regexp_matches(lower(content), 'encrypt|fernet|aes')) AS encryption,
    bool_or(ext = '.py' AND regexp_matches(lower(content), 'bcrypt|argon2|pbkdf2')) AS hashing
  FROM scope GROUP BY repo_id),
framework AS (
  SELECT repo_id, CASE WHEN contains(module, 'flask') THEN 'Flask' WHEN contains(module, 'fastapi')
    THEN 'FastAPI' WHEN contains(module, 'django') THEN 'Django' END AS name
  FROM (SELECT repo_id, regexp_extract(line, '^\s*from\s+([\w.]+)\s+import', 1) AS module
    FROM scope_lines WHERE ext = '.py')
  UNION ALL SELECT repo_id, 'Express' FROM scope WHERE ext <> '.py' AND contains(content, 'express')
  UNION ALL SELECT repo_id, 'Next.js' FROM scope WHERE ext <> '.py'
    AND (contains(lower(path), 'next') OR contains(content, 'Next'))),
frameworks AS (SELECT repo_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS names
  FROM framework WHERE name IS NOT NULL GROUP BY repo_id)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.file_facts(Corpus(spark, sf_dir).files)


@query("profile_routes", with_ctes(FILES, lines_cte(), FACTS_SQL, select="""
SELECT repo_id, path, method, route_path, route, protected FROM guarded"""))
def profile_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stored(_facts(spark, sf_dir).select("repo_id", "path", "routes", "auth"), "facts")
    return profile.with_protection(profile.routes(facts), profile.auth_functions(facts)).drop("pos")


@query("profile_auth", with_ctes(FILES, lines_cte(), FACTS_SQL, select="""
SELECT repo_id, path, name, name || ' (' || path || ')' AS auth FROM auth"""))
def profile_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.auth_functions(_facts(spark, sf_dir))


@query("profile_pii", with_ctes(FILES, lines_cte(), FACTS_SQL, select="""
SELECT repo_id, path, array_to_string(words[1:5], ',') AS words FROM top_pii WHERE n <= 8"""))
def profile_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pii_files(_facts(spark, sf_dir)).withColumn("words", F.array_join("words", ","))


@query("profile_pii_fields", with_ctes(FILES, lines_cte(), FACTS_SQL, select=rf"""
SELECT repo_id, path, name FROM (SELECT repo_id, path, regexp_extract(target, '[^.]*$') AS name
  FROM (SELECT repo_id, path, unnest(string_split_regex(regexp_replace(regexp_extract(line,
      '^[ \t]*((?:[A-Za-z_][\w.]*[ \t]*=[ \t]*)+)[^=]', 1), '[ \t]*=[ \t]*$', ''),
      '[ \t]*=[ \t]*')) AS target
    FROM scope_lines WHERE ext = '.py' AND NOT regexp_matches(line, ',\s*$')))
WHERE regexp_matches(name, {sql_text(profile.PII_PYTHON)})
UNION ALL
SELECT repo_id, path, unnest({_WORDS}) FROM scope WHERE ext <> '.py'"""))
def profile_pii_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pii_fields(_facts(spark, sf_dir))


@query("profile_controls", with_ctes(FILES, lines_cte(), FACTS_SQL, select="""
SELECT c.*, (SELECT count(*) FROM top_pii p WHERE p.repo_id = c.repo_id) AS pii_files,
  coalesce(names, '') AS frameworks FROM control c LEFT JOIN frameworks USING (repo_id)"""))
def profile_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.controls(_facts(spark, sf_dir)).withColumn(
        "frameworks", F.array_join("frameworks", ", "))


_PROFILE_SQL = with_ctes(FILES, lines_cte(), FACTS_SQL, """
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, protected ORDER BY path, pos) AS n,
  count(*) OVER (PARTITION BY repo_id, protected) AS total FROM guarded),
lists AS (SELECT repo_id, protected, max(total) AS total,
  string_agg(route, ', ' ORDER BY path, pos) FILTER (n <= 8) AS names FROM ranked GROUP BY ALL),
auths AS (SELECT repo_id, array_to_string(list_sort(list_distinct(array_agg(
  name || ' (' || path || ')')))[1:5], ', ') AS names FROM auth GROUP BY repo_id),
pii_text AS (SELECT repo_id, count(*) AS total, string_agg('  - ' || path || ': '
  || array_to_string(words[1:5], ', '), chr(10) ORDER BY path) FILTER (n <= 8) AS names
  FROM top_pii GROUP BY repo_id)""", select="""
SELECT c.repo_id, concat_ws(chr(10), 'Frameworks: ' || f.names,
  'Protected routes (' || p.total || '): ' || p.names,
  'Unprotected routes (' || u.total || '): ' || u.names,
  CASE WHEN p.total IS NULL AND u.total IS NULL THEN 'Routes: NONE DETECTED' END,
  coalesce('PII-like fields found in ' || t.total || ' files:' || chr(10) || t.names,
    'PII-like fields: NONE DETECTED'),
  'Auth decorators: ' || coalesce(a.names, 'NONE DETECTED'),
  CASE WHEN log_calls > 0 THEN 'Logging: ' || log_calls || ' calls across ' || log_files || ' files'
    ELSE 'Logging: NONE DETECTED' END,
  'Consent mechanism: ' || CASE WHEN consent THEN 'YES' ELSE 'NOT DETECTED' END,
  'Deletion endpoint: ' || CASE WHEN deletion THEN 'YES' ELSE 'NOT DETECTED' END,
  'Encryption at rest: ' || CASE WHEN encryption THEN 'YES' ELSE 'NOT DETECTED' END,
  'Password hashing (bcrypt/argon2): ' || CASE WHEN hashing THEN 'YES' ELSE 'NOT DETECTED' END)
  AS profile
FROM control c LEFT JOIN frameworks f USING (repo_id)
LEFT JOIN lists p ON p.repo_id = c.repo_id AND p.protected
LEFT JOIN lists u ON u.repo_id = c.repo_id AND NOT u.protected
LEFT JOIN auths a ON a.repo_id = c.repo_id LEFT JOIN pii_text t ON t.repo_id = c.repo_id""")


@query("profile_text", _PROFILE_SQL)
def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profiles(stored(_facts(spark, sf_dir), "facts"))


# --- prompt-injection reviews -----------------------------------------------------------------
PROMPT = "FILE: {file_path}\nLINES: {start_line}-{end_line}\n{code_segment}\nGenuine?"
_INJECTION = ORACLE["rules_injection"]
_SEGMENTS = _INJECTION[:_INJECTION.rindex("\nSELECT")]


@query("review_segments", _SEGMENTS + """
SELECT repo_id, path, CAST(line_no AS BIGINT) AS line_no, rule_id, CAST(start_line AS BIGINT)
  AS start_line, CAST(end_line AS BIGINT) AS end_line, code_segment FROM segments""")
def review_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_bigint(rules.injection_segments(Corpus(spark, sf_dir).files).drop("message"))


def _as_bigint(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c)
                       for c, t in df.dtypes])


@query("review_report_segments", with_ctes(FILES, """
hits AS (SELECT repo_id, path, CAST(1 + doc_id % 40 AS BIGINT) AS line_no FROM files),
texts AS (SELECT repo_id, path, string_split(CASE WHEN right(content, 1) = chr(10)
  THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS ls FROM files)""", select="""
SELECT repo_id, path, line_no, CAST(greatest(1, line_no - 15) AS BIGINT) AS start_line,
  CAST(least(len(ls), line_no + 15) AS BIGINT) AS end_line,
  array_to_string(ls[greatest(1, line_no - 15):line_no + 15], chr(10)) AS code_segment
FROM hits JOIN texts USING (repo_id, path)"""))
def review_report_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of hits that an outside report names, here one somewhere in or past each file."""
    files = Corpus(spark, sf_dir).files
    hits = files.select("repo_id", "path", (F.col("doc_id") % 40 + 1).cast("int").alias("line_no"),
                        F.lit("reported").alias("rule_id"), F.lit("").alias("message"))
    return _as_bigint(rules.hit_segments(files, hits).drop("rule_id", "message"))


@query("review_prompts", _SEGMENTS + """
SELECT repo_id, path, CAST(line_no AS BIGINT) AS line_no, rule_id, 'FILE: ' || path || chr(10)
  || 'LINES: ' || start_line || '-' || end_line || chr(10) || left(code_segment, 800) || chr(10)
  || 'Genuine?' AS prompt FROM segments""")
def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = rules.injection_segments(Corpus(spark, sf_dir).files)
    return _as_bigint(review.render_prompts(segments, PROMPT)).select(
        "repo_id", "path", "line_no", "rule_id", "prompt")


@query("review_verdicts", f"""
WITH f AS ({_INJECTION}), v AS (SELECT *, line % 8 AS k FROM f)
SELECT repo_id, file, line, title, severity, id,
  CASE WHEN k = 2 THEN 'OWASP LLM LLM01' END AS cwe,
  CASE k WHEN 2 THEN 0.9 WHEN 4 THEN 0.3 WHEN 6 THEN 0.5 ELSE confidence END AS confidence,
  CASE k WHEN 2 THEN 'because {{x}} of ' || line ELSE description END AS description
FROM v WHERE k NOT IN (3, 5)""")
def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.segment_findings(rules.injection_segments(Corpus(spark, sf_dir).files))
    k = F.col("line") % 8
    body = (F.when(k == 1, "no JSON at all")
            .when(k == 2, F.concat(F.lit(
                'Sure:\n```json\n{"is_vulnerable": true, "confidence": 0.9, "owasp_ref": "LLM01", '
                '"explanation": "because {x} of '), F.col("line"), F.lit('"}\n```')))
            .when(k == 3, '{"is_vulnerable": true, "confidence": 0.29}')
            .when(k == 4, '{"is_vulnerable": true, "confidence": 0.30, "owasp_ref": null}')
            .when(k == 5, '{"is_vulnerable": false, "confidence": 0.9}')
            .when(k == 6, 'text {"is_vulnerable": true} text').when(k == 7, '{"is_vulnerable": tr}'))
    replies = found.select(finding_key().alias("key"), body.alias("body"))
    return review.apply_verdicts(found, replies).select(
        "repo_id", "file", F.col("line").cast("bigint").alias("line"), "title", "severity", "id",
        "cwe", "confidence", "description")


# --- replies ----------------------------------------------------------------------------------
@query("review_compliance", """
WITH item(pos, title, sev, cat, file, description, remediation, ref) AS (VALUES
  (0, 'A', 'low', 'compliance_soc2', 'a.py', 'd1', 'r1', 'SOC2 CC6.1'),
  (1, 'B', 'high', 'compliance_gdpr', NULL, '', '', NULL),
  (2, 'C', 'medium', 'compliance_gdpr', NULL, '', '', NULL),
  (3, 'D', 'high', 'compliance_gdpr', NULL, '', '', NULL),
  (4, 'E', 'info', 'compliance_gdpr', NULL, '', '', NULL),
  (5, 'Compliance gap', 'medium', 'compliance_gdpr', NULL, '', '', NULL),
  (6, 'G', 'high', 'compliance_gdpr', NULL, '', '', NULL)),
reply AS (SELECT 'cust-' || c_custkey AS repo_id, c_custkey % 3 = 0 AS raised, item.* FROM customer, item
  WHERE c_custkey % 5 < 3),
ranked AS (SELECT * REPLACE (CASE WHEN pos = 0 AND raised THEN 'high' ELSE sev END AS sev,
    CASE WHEN pos = 1 THEN 'B' || substr(repo_id, 6) ELSE title END AS title) FROM reply),
top AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE sev WHEN 'high' THEN 0
    WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, pos) AS n FROM ranked)
SELECT repo_id, n + 999 AS ord, title, sev AS severity, cat AS category, file, description,
  remediation, ref AS compliance_ref, CAST(0.7 AS DOUBLE) AS confidence FROM top WHERE n <= 5""")
def review_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    items = F.concat(
        F.lit('[{"title": "A", "category": "compliance_soc2", "file": "a.py", "description": "d1", '
              '"remediation": "r1", "compliance_ref": "SOC2 CC6.1", "severity": "'),
        F.when(key % 3 == 0, "high").otherwise("low"), F.lit('"}, {"title": "B'), key,
        F.lit('", "severity": "critical"}, {"title": "C"}, "text", {"title": "D", "severity": '
              '"high", "category": "odd"}, {"title": "E", "severity": "info"}, {"severity": '
              '"weird"}, {"title": "G", "severity": "high"}]'))
    body = (F.when(key % 5 == 0, F.concat(F.lit("```json\n"), items, F.lit("\n```")))
            .when(key % 5 == 1, items)
            .when(key % 5 == 2, F.concat(F.lit("Here: "), items, F.lit(" done")))
            .when(key % 5 == 3, F.lit("No gaps found.")).otherwise(F.lit("[{broken]")))
    replies = Corpus(spark, sf_dir).table("customer").select(
        F.concat(F.lit("cust-"), key).alias("repo_id"), body.alias("body"))
    return review.compliance_replies(replies).select(
        "repo_id", "ord", "title", "severity", "category", "file", "description", "remediation",
        "compliance_ref", "confidence")


@query("summary_findings", """
WITH item(ord, title, description, remediation, confidence) AS (VALUES
  (0, 'Executive Summary', 'S', 'See individual findings for specific fixes.', 1.0),
  (1, 'Remediation: T', 'AI-generated remediation for: T', 'P', 0.9),
  (2, 'Remediation: Fix', 'AI-generated remediation for: ', '', 0.9))
SELECT 'cust-' || c_custkey AS repo_id, CAST(ord AS BIGINT) AS ord, title, CASE WHEN ord = 0
    THEN description || c_custkey ELSE description END AS description, remediation,
  CAST(confidence AS DOUBLE) AS confidence, 'info' AS severity, 'llm_review' AS category
FROM customer, item WHERE c_custkey % 4 < 2 OR c_custkey % 4 = 2 AND ord > 0""")
def summary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    prompts = F.lit('"remediation_prompts": [{"title": "T", "severity": "high", "prompt": "P"}, '
                    '"x", {}]}')
    full = F.concat(F.lit('{"executive_summary": "S'), key, F.lit('", '), prompts)
    body = (F.when(key % 4 == 0, full)
            .when(key % 4 == 1, F.concat(F.lit("```\n"), full, F.lit("\n```")))
            .when(key % 4 == 2, F.concat(F.lit('{"executive_summary": "", '), prompts))
            .otherwise("sorry"))
    replies = Corpus(spark, sf_dir).table("customer").select(
        F.concat(F.lit("cust-"), key).alias("repo_id"), body.alias("body"))
    return review.summary_replies(replies).select(
        "repo_id", "ord", "title", "description", "remediation", "confidence", "severity",
        "category")


# --- tokens -----------------------------------------------------------------------------------
BUDGET = 2000
_BUDGET_SQL = f"""WITH calls AS (SELECT user_id AS client, event_id AS seq, event_type AS repo_id,
  CAST(floor(value) AS BIGINT) AS tokens FROM events),
sums AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY client ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM calls)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).table("events").select(
        F.col("user_id").alias("client"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("repo_id"), F.floor("value").alias("tokens"))


@query("token_budget", _BUDGET_SQL + f"""
SELECT client, seq, tokens, used_before, used_before < {BUDGET} AS admitted FROM sums""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.token_budget(_calls(spark, sf_dir), BUDGET, width=1000)


@query("token_cost", _BUDGET_SQL + f"""
SELECT repo_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(round(sum(tokens) * 0.000003, 6) AS DOUBLE) AS cost
FROM sums WHERE used_before < {BUDGET} GROUP BY repo_id""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    admitted = review.token_budget(calls, BUDGET).filter("admitted").select("client", "seq")
    return review.token_totals(calls.join(admitted, ["client", "seq"], "left_semi"))
