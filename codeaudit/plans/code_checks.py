"""Registered queries: Next.js, structure and imports, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeaudit.operators import cost, frontend, known_exports, structure
from codeaudit.plans.common import (
    FILES, LANG_SQL, findings_sql, lines_cte, matches_cte, query, shown, with_ctes,
)
from codeaudit.plans.corpus import Corpus, sql_text
from codeaudit.plans.rule_checks import _ARGS, _none_of
from codeaudit.sources import files as S

NEXT_REPOS = """next_repos AS (SELECT DISTINCT repo_id FROM files
  WHERE path IN ('next.config.js', 'next.config.ts', 'next.config.mjs')
    OR (path = 'package.json' AND coalesce(
      list_contains(json_keys(TRY_CAST(content AS JSON), '$.dependencies'), 'next'), FALSE)
    OR (path = 'package.json' AND coalesce(
      list_contains(json_keys(TRY_CAST(content AS JSON), '$.devDependencies'), 'next'), FALSE))))"""
_SCRIPT = "ext IN ('.js', '.ts', '.jsx', '.tsx')"
_IN_NEXT = "repo_id IN (SELECT repo_id FROM next_repos)"


@query("next_gate", with_ctes(FILES, NEXT_REPOS, select="SELECT repo_id FROM next_repos"))
def next_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontend.next_repos(Corpus(spark, sf_dir).files)


def _next(n: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = frontend.next_findings(Corpus(spark, sf_dir).files)
        return shown(found.filter(F.col("ord") == n))
    return run


_NEXT = dict(analyzer="'nextjs'", category="'framework_specific'")
query("next_env", with_ctes(FILES, lines_cte(), NEXT_REPOS, r"""
env AS (SELECT *, regexp_extract(line, '^\s*([^=]*?)\s*=', 1) AS name FROM lines
  WHERE regexp_matches(path, '^[.]env[^/]*$') AND NOT regexp_matches(line, '^\s*#')
    AND contains(line, '='))""", select=findings_sql(
    "env", **_NEXT, title="'Secret Exposed to Client: ' || name", severity="'critical'", ord="1",
    description="'Environment variable ''' || name || ''' has the NEXT_PUBLIC_ prefix, which "
                "exposes it to the browser. This variable appears to contain sensitive data that "
                "should never reach the client.'",
    evidence="'Line ' || line_no || ': ' || name || '=...'",
    where=f"{_IN_NEXT} AND starts_with(name, 'NEXT_PUBLIC_') AND regexp_matches(upper(name), "
          "'SECRET|PASSWORD|API_KEY|PRIVATE_KEY|TOKEN|DATABASE_URL|DB_URL|OPENAI_API|"
          "ANTHROPIC_API|GEMINI_API|ENCRYPTION_KEY|SUPABASE_SERVICE_ROLE')")))(_next(1))
query("next_routes", with_ctes(FILES, NEXT_REPOS, select=findings_sql(
    "files", **_NEXT, title="'Unprotected API Route: ' || path", severity="'high'", ord="2",
    line="CAST(NULL AS BIGINT)",
    description="'API route ''' || path || ''' has no authentication check. Any user (or bot) can "
                "call this endpoint. This is a common mistake in vibe-coded Next.js apps.'",
    evidence="'No auth pattern found (getServerSession, verifyToken, withAuth, etc.)'",
    where=f"{_IN_NEXT} AND {_SCRIPT} AND regexp_matches(path, '^(src/)?(pages|app)/api/') AND NOT "
          "regexp_matches(lower(path), 'health|status|ping|webhook') AND NOT "
          f"regexp_matches(content, {sql_text(frontend.AUTH)})")))(_next(2))
query("next_actions", with_ctes(FILES, NEXT_REPOS, select=findings_sql(
    "files", **_NEXT, title="'Unvalidated Server Action: ' || path", severity="'high'", ord="3",
    line="CAST(NULL AS BIGINT)",
    description="'Server action in ''' || path || ''' contains ''use server'' but has no input "
                "validation (no zod .parse(), joi.validate(), etc.). Server actions receive raw "
                "user input from the client.'",
    evidence="'''use server'' directive found but no validation pattern detected'",
    where=f"{_IN_NEXT} AND {_SCRIPT} AND regexp_matches(path, '^(src/)?(app|actions)/') AND "
          "(contains(content, '''use server''') OR contains(content, '\"use server\"')) AND NOT "
          f"regexp_matches(content, {sql_text(frontend.VALIDATION)})")))(_next(3))
query("next_html", with_ctes(FILES, lines_cte(), NEXT_REPOS, """
first AS (SELECT l.*, row_number() OVER (PARTITION BY l.repo_id, l.path ORDER BY line_no) AS n
  FROM lines l JOIN files f ON f.repo_id = l.repo_id AND f.path = l.path
  WHERE f.ext IN ('.js', '.ts', '.jsx', '.tsx') AND contains(line, 'dangerouslySetInnerHTML')
    AND NOT contains(content, 'DOMPurify') AND NOT contains(lower(content), 'sanitize'))""",
    select=findings_sql(
        "first", **_NEXT, title="'Unsanitized dangerouslySetInnerHTML'", severity="'high'", ord="4",
        description="'dangerouslySetInnerHTML is used without DOMPurify or sanitization. This "
                    "enables XSS if the content comes from user input or an LLM.'",
        evidence=r"'Line ' || line_no || ': ' || left(regexp_replace(line, '^\s+|\s+$', '', 'g'), 100)",
        where=f"n = 1 AND {_IN_NEXT} AND NOT contains(path, 'node_modules') AND NOT "
              "contains(path, '.next') AND NOT contains(path, '.venv')")))(_next(4))

# --- structure --------------------------------------------------------------------------------
_SCOPE = _none_of(S.SKIP_STRUCTURE)
_WS = r"'^\s+|\s+$', '', 'g'"
_LIST = lambda text: (
    f"list_filter(list_transform(string_split({text}, ','), lambda x: regexp_replace(x, {_WS})), "
    "lambda x: x <> '')")
_JOIN = lambda names: f"coalesce(array_to_string({names}, ','), '')"
_PY_FROM_RE2 = (r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]*"
                r"(?:\(([^)]*)\)|((?:\\\n|[^\n#;(])+))")


@query("imports_py", with_ctes(
    FILES,
    matches_cte("plain", structure.PY_IMPORT, "lang = 'python'", {"items": 1}),
    matches_cte("named", _PY_FROM_RE2, "lang = 'python'", {"module": 1, "inn": 2, "bare": 3}),
    select=rf"""
SELECT repo_id, path, CAST(line_no AS BIGINT) AS line, regexp_extract(item, '^[\w.]+') AS module,
  '' AS names, nullif(regexp_extract(item, '\sas\s+(\w+)', 1), '') AS alias
FROM (SELECT *, unnest({_LIST('items')}) AS item FROM plain) WHERE {_SCOPE}
UNION ALL
SELECT repo_id, path, line_no, regexp_replace(module, '^[.]+', ''),
  {_JOIN(rf"list_transform({_LIST(r"regexp_replace(coalesce(inn, '') || coalesce(bare, ''), '#[^\n]*', '', 'g')")}, lambda n: regexp_replace(n, '\s+as\s.*$', ''))")},
  NULL
FROM named WHERE {_SCOPE}"""))
def imports_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir).filter("lang = 'python'").select(
        "repo_id", "path", F.col("line_no").cast("bigint").alias("line"), "module",
        F.array_join("names", ",").alias("names"), "alias")


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.in_import_map(structure.imports(
        structure.code_files(Corpus(spark, sf_dir).files)))


_JS = "lang IN ('javascript', 'typescript')"


@query("imports_js", with_ctes(
    FILES,
    matches_cte("a", structure.JS_NAMED, _JS, {"x": 1, "m": 2}),
    matches_cte("b", structure.JS_DEFAULT, _JS, {"x": 1, "m": 2}),
    matches_cte("c", structure.JS_STAR, _JS, {"x": 1, "m": 2}),
    matches_cte("d", structure.JS_REQUIRE, _JS, {"y": 1, "x": 2, "m": 3}), select=rf"""
SELECT repo_id, path, CAST(line_no AS BIGINT) AS line, m AS module,
  {_JOIN(rf"list_transform({_LIST('x')}, lambda n: regexp_replace(n, '\s+as\s.*$', ''))")} AS names,
  CAST(NULL AS VARCHAR) AS alias, FALSE AS is_default FROM a WHERE {_SCOPE}
UNION ALL SELECT repo_id, path, line_no, m, '', x, TRUE FROM b WHERE {_SCOPE}
UNION ALL SELECT repo_id, path, line_no, m, '', x, FALSE FROM c WHERE {_SCOPE}
UNION ALL SELECT repo_id, path, line_no, m, {_JOIN(_LIST("coalesce(y, '')"))}, nullif(x, ''),
  coalesce(y, '') = '' FROM d WHERE {_SCOPE}"""))
def imports_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir).filter("lang <> 'python'").select(
        "repo_id", "path", F.col("line_no").cast("bigint").alias("line"), "module",
        F.array_join("names", ",").alias("names"), "alias", "is_default")


# Python blocks of the comparison engine work on numbered lines: a block ends at the last line
# that is not blank before the next line indented no deeper than its head.
_PY_LINES = r"""py AS (SELECT repo_id, path, line, line_no,
    length(regexp_extract(line, '^[ \t]*')) AS indent FROM lines
  WHERE lang = 'python' AND regexp_matches(line, '\S')),
heads AS (SELECT *, regexp_matches(line, '^[ \t]*(async[ \t]+)?def[ \t]+\w+[ \t]*[(]') AS is_def,
    regexp_matches(line, '^[ \t]*class[ \t]+\w+') AS is_class FROM py),
ends AS (SELECT h.repo_id, h.path, h.line_no,
    min(p.line_no) FILTER (p.indent <= h.indent AND NOT starts_with(trim(p.line), ')')) AS stop
  FROM heads h LEFT JOIN py p ON p.repo_id = h.repo_id AND p.path = h.path
    AND p.line_no > h.line_no WHERE h.is_def OR h.is_class GROUP BY ALL),
blocks AS (SELECT h.*, (SELECT max(p.line_no) FROM py p WHERE p.repo_id = h.repo_id
    AND p.path = h.path AND (e.stop IS NULL OR p.line_no < e.stop)) AS end_line
  FROM heads h JOIN ends e USING (repo_id, path, line_no)),
texts AS (SELECT repo_id, path, array_agg(line ORDER BY line_no) AS ls FROM lines GROUP BY ALL)"""
_JS_FUNCTIONS = ["js_f", "js_a"]


def _flat_sql(args: str) -> str:
    """Arguments without strings and, from the inside, without brackets."""
    args = f"regexp_replace({args}, {sql_text(_STRINGS)}, '_', 'g')"
    for _ in range(6):
        args = f"regexp_replace({args}, '[(][^()]*[)]|[{{][^{{}}]*[}}]', '', 'g')"
    return args


_STRINGS = "\"[^\"\n]*\"|'[^'\n]*'"


@query("functions_all", with_ctes(
    FILES, lines_cte(), _PY_LINES, rf"""
defs AS (SELECT b.*, regexp_extract(line, 'def[ \t]+(\w+)', 1) AS name,
    regexp_extract(array_to_string(ls[line_no:line_no + 5], chr(10)),
      {sql_text(r'def[ \t]+\w+[ \t]*[(](' + _ARGS + ')[)]')}, 1) AS args,
    ls[line_no - 1] AS above, ls[line_no - 2] AS above2
  FROM blocks b JOIN texts USING (repo_id, path) WHERE is_def)""",
    matches_cte("js_f", structure.JS_FUNCTION, _JS, {"name": 1, "args": 2}),
    matches_cte("js_a", structure.JS_ARROW, _JS, {"name": 1, "args": 2}), select=rf"""
SELECT repo_id, path, name, CAST(line_no AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS
  end_line, regexp_matches(line, '^[ \t]*async') AS is_async,
  {_JOIN(rf"list_transform({_LIST("regexp_extract(regexp_replace(" + _flat_sql('args') + r", '^[^*]*/\s*,', ''), '^[^*]*')")}, lambda p: regexp_extract(p, '^\w*'))")} AS params,
  array_to_string(list_filter([CASE WHEN regexp_matches(above, '^[ \t]*@') AND
      regexp_matches(above2, '^[ \t]*@[\w.]+\s*$') THEN trim(above2)[2:] END,
    CASE WHEN regexp_matches(above, '^[ \t]*@[\w.]+\s*$') THEN trim(above)[2:] END],
    lambda x: x IS NOT NULL), ',') AS decorators
FROM defs WHERE {_SCOPE}
UNION ALL
SELECT repo_id, path, name, line_no, 0, contains(match, 'async'),
  {_JOIN(rf"list_transform({_LIST('args')}, lambda p: regexp_replace(p, '\s*:.*$', ''))")}, ''
FROM js_f WHERE {_SCOPE}
UNION ALL
SELECT repo_id, path, name, line_no, 0, FALSE,
  {_JOIN(rf"list_transform({_LIST('args')}, lambda p: regexp_replace(p, '\s*:.*$', ''))")}, ''
FROM js_a WHERE {_SCOPE}"""))
def functions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.functions(structure.code_files(Corpus(spark, sf_dir).files))
    return structure.in_import_map(rows).select(
        "repo_id", "path", "name", F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"), "is_async",
        F.array_join("params", ",").alias("params"),
        F.array_join("decorators", ",").alias("decorators"))


@query("classes_all", with_ctes(
    FILES, lines_cte(), _PY_LINES, r"""
py_classes AS (SELECT *, regexp_extract(line, 'class[ \t]+(\w+)', 1) AS name,
    regexp_extract(line, '[(](.*)[)]\s*:', 1) AS args FROM blocks WHERE is_class),
members AS (SELECT c.repo_id, c.path, c.line_no, m.line_no AS pos,
    regexp_extract(m.line, 'def[ \t]+(\w+)', 1) AS method, m.indent,
    min(p.indent) AS body_indent
  FROM py_classes c JOIN heads m ON m.repo_id = c.repo_id AND m.path = c.path AND m.is_def
    AND m.line_no > c.line_no AND m.line_no <= c.end_line
  JOIN py p ON p.repo_id = c.repo_id AND p.path = c.path AND p.line_no > c.line_no
    AND p.line_no <= c.end_line GROUP BY ALL),
methods AS (SELECT repo_id, path, line_no, string_agg(method, ',' ORDER BY pos) AS methods
  FROM members WHERE indent = body_indent GROUP BY ALL)""",
    matches_cte("js_c", structure.JS_CLASS, _JS, {"name": 1, "base": 2}), select=rf"""
SELECT c.repo_id, c.path, name, CAST(c.line_no AS BIGINT) AS start_line,
  {_JOIN(rf"list_transform(list_filter({_LIST('args')}, lambda b: regexp_matches(b, '^[\w.]+$')), lambda b: regexp_extract(b, '[^.]*$'))")} AS bases,
  coalesce(methods, '') AS methods
FROM py_classes c LEFT JOIN methods m USING (repo_id, path, line_no) WHERE {_none_of(S.SKIP_STRUCTURE, 'c.path')}
UNION ALL SELECT repo_id, path, name, line_no, coalesce(base, ''), '' FROM js_c WHERE {_SCOPE}"""))
def classes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.classes(structure.code_files(Corpus(spark, sf_dir).files))
    return structure.in_import_map(rows).select(
        "repo_id", "path", "name", F.col("start_line").cast("bigint").alias("start_line"),
        F.array_join("bases", ",").alias("bases"), F.array_join("methods", ",").alias("methods"))


# --- imports of unknown names -----------------------------------------------------------------
def exports_table(spark: SparkSession) -> DataFrame:
    return known_exports.known_exports(spark)


_EXPORTS = [(m, e) for m, names in known_exports.KNOWN_EXPORTS.items() for e in names]
_EXPORTS_SQL = ("exports(module, export) AS (VALUES "
                + ", ".join(f"('{m}', '{e}')" for m, e in _EXPORTS) + ")")
from codeaudit.plans.common import ORACLE  # noqa: E402

HALLUCINATED_SQL = f"""imported AS (
  SELECT repo_id, path, line AS line_no, module, 2 AS kind, unnest(string_split(names, ',')) AS name
  FROM ({ORACLE['imports_py']})
  UNION ALL
  SELECT repo_id, path, line, module, CASE WHEN is_default OR alias IS NULL AND names = '' THEN 4
      ELSE 3 END, unnest(string_split(names, ','))
  FROM ({ORACLE['imports_js']})),
unknown AS (SELECT i.* REPLACE (CASE WHEN kind = 3 AND contains(content, 'require(')
      THEN 6 ELSE kind END AS kind),
    (SELECT string_agg(export, ', ' ORDER BY export) FROM (SELECT export FROM exports e
      WHERE e.module = i.module ORDER BY export LIMIT 8)) AS sample
  FROM imported i JOIN files f ON f.repo_id = i.repo_id AND f.path = i.path
  WHERE name NOT IN ('', '*')
    AND module IN (SELECT module FROM exports)
    AND NOT EXISTS (SELECT 1 FROM exports e WHERE e.module = i.module AND e.export = i.name))"""


@query("hallucinated_imports", with_ctes(FILES, _EXPORTS_SQL, HALLUCINATED_SQL, select=findings_sql(
    "unknown", analyzer="'hallucination'", category="'hallucinated_import'", severity="'high'",
    title="'Hallucinated Import: ' || name || ' from ''' || module || ''''", ord="kind",
    description="'''' || name || ''' is not a known export of ''' || module || '''. This is "
                "likely hallucinated by an LLM. Known exports include: ' || sample || '...'",
    evidence="'''' || name || ''' not in known exports of ''' || module || ''''")))
def hallucinated_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(known_exports.hallucinated_imports(
        Corpus(spark, sf_dir).files, exports_table(spark)))


# --- cost -------------------------------------------------------------------------------------
_COST = dict(analyzer="'cost_efficiency'", category="'cost_efficiency'")
_COST_SCOPE = _none_of(S.SKIP_COST)
_COST_CODE = "ext IN ('.py', '.js', '.ts', '.jsx', '.tsx')"
_CONFIG = "regexp_matches(base, '[.](yml|yaml)$|^Dockerfile$|^docker-compose')"


def _cost(*numbers: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(cost.cost_findings(Corpus(spark, sf_dir).files)
                     .filter(F.col("ord").isin(*numbers)))
    return run


query("cost_models", with_ctes(FILES, *[
    matches_cte(f"m{i}", r"(?i)model\s*[=:]\s*[\"']?" + m.replace(".", "[.]"), _COST_CODE) for i, m in enumerate(cost.MODELS)],
    "hits AS (" + " UNION ALL ".join(
        f"SELECT repo_id, path, line_no, '{m}' AS model, {sql_text(alt)} AS alt FROM m{i}"
        for i, (m, alt) in enumerate(cost.MODELS.items())) + ")", select=findings_sql(
    "hits", **_COST, title="'Expensive LLM model: ' || model", severity="'medium'", ord="1",
    description="'Using expensive model ''' || model || '''. Consider ' || alt || ' for cost "
                "savings.'", confidence="0.8", where=_COST_SCOPE)))(_cost(1))
query("cost_resources", with_ctes(
    FILES, matches_cte("c", cost.CPU, _CONFIG, {"n": 1}),
    matches_cte("m", cost.MEMORY, _CONFIG, {"n": 1, "u": 2}),
    matches_cte("s", cost.SERVERLESS_MEMORY, _CONFIG, {"n": 1}), select="\nUNION ALL\n".join([
        findings_sql("c", **_COST, title="'Over-provisioned CPU: ' || n || ' cores'", ord="2",
                     severity="'medium'", confidence="0.7",
                     description="'Container requests ' || n || ' CPU cores. Most application "
                                 "containers run fine on 0.5-1 cores.'",
                     where=f"{_COST_SCOPE} AND CAST(n AS BIGINT) > 2 AND NOT (contains("
                           "lower(match), 'm') AND CAST(n AS BIGINT) <= 2000)"),
        findings_sql("m", **_COST, title="'Over-provisioned memory: ' || n || u", ord="3",
                     severity="'medium'", confidence="0.7",
                     description="'Container requests ' || n || u || ' memory. Most web "
                                 "applications run under 512Mi-1Gi.'",
                     where=f"{_COST_SCOPE} AND CAST(n AS BIGINT) * CASE u WHEN 'Gi' THEN 1024 "
                           "ELSE 1 END > 4096"),
        findings_sql("s", **_COST, title="'Over-provisioned Lambda: ' || n || 'MB'", ord="4",
                     severity="'low'", confidence="0.6",
                     description="'Lambda function configured with ' || n || 'MB memory. Most "
                                 "functions run under 256-512MB.'",
                     where=f"{_COST_SCOPE} AND CAST(n AS BIGINT) > 512")])))(_cost(2, 3, 4))
query("cost_repeat_calls", with_ctes(
    FILES, matches_cte("c", cost.CALL, _COST_CODE, {"url": 1}), """
runs AS (SELECT repo_id, path, url, min(line_no) AS line_no, count(*) AS n,
    array_to_string(array_agg(line_no ORDER BY line_no)[1:5], ', ') AS lines
  FROM c GROUP BY ALL HAVING count(*) >= 2)""", select=findings_sql(
        "runs", **_COST, title="'Redundant API calls to same URL'", severity="'medium'", ord="5",
        description="'The URL ''' || left(url, 60) || '...'' is called ' || n || ' times in this "
                    "file (lines ' || lines || '). Each call incurs network latency and potential "
                    "API costs.'", confidence="0.7", where=_COST_SCOPE)))(_cost(5))
_HEAVY = ("heavy(dep, alt) AS (VALUES " + ", ".join(
    f"('{d}', {sql_text(a)})" for d, a in cost.HEAVY_PACKAGES.items()) + ")")
query("cost_bloat", with_ctes(FILES, lines_cte(), _HEAVY, """
json_hits AS (SELECT repo_id, path, dep, alt, left(content, strpos(content, '"' || dep || '"') - 1) AS lead
  FROM files, heavy WHERE base = 'package.json' AND contains(content, '"' || dep || '"')),
text_hits AS (SELECT f.repo_id, f.path, dep, alt, coalesce((SELECT min(line_no) FROM lines l
    WHERE l.repo_id = f.repo_id AND l.path = f.path AND contains(line, dep)), 1) AS line_no
  FROM files f, heavy WHERE regexp_matches(base, '^requirements.*[.]txt$|^pyproject[.]toml$')
    AND regexp_matches(content, '(?:^|\\n|")\\s*' || dep || '\\s*[=<>!\\n"]'))""".replace("\\\\", "\\"),
    select="\nUNION ALL\n".join([
        findings_sql("json_hits", **_COST, title="'Bloated dependency: ' || dep",
                     severity="'low'", ord="6",
                     line="(1 + length(lead) - length(replace(lead, chr(10), '')))",
                     description="'''' || dep || ''' is a heavy dependency. Consider: ' || alt || "
                                 "'.'", confidence="0.8", where=_COST_SCOPE),
        findings_sql("text_hits", **_COST, title="'Bloated dependency: ' || dep",
                     severity="'low'", ord="7",
                     description="'''' || dep || ''' is a heavy dependency. Consider: ' || alt || "
                                 "'.'", confidence="0.7", where=_COST_SCOPE)])))(_cost(6, 7))
