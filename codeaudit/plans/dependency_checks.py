"""Registered queries: manifests, dependencies, registry answers, scanner reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeaudit.model import emit
from codeaudit.operators import dependencies, manifests
from codeaudit.plans.common import (
    DEPS, FILES, REGISTRY, findings_sql, lines_cte, query, shown, with_ctes,
)
from codeaudit.plans.corpus import ADVISORIES_SQL, AS_OF, Corpus
from codeaudit.plans.rule_checks import _none_of
from codeaudit.sources import files as S, reports as R
from codeaudit.sources.registry import registry

# --- manifests --------------------------------------------------------------------------------
_IN_SCOPE = ("(path = base OR (" + _none_of(S.SKIP_MANIFESTS)
             + " AND NOT regexp_matches(path, '(^|/)[.]')))")
_VALUE = r"""regexp_extract(line, '=\s*(?:[{].*?version\s*=\s*)?["'']([^"'']*)["'']', 1)"""
PARSED_SQL = rf"""ml AS (SELECT l.*, f.base FROM lines l JOIN files f USING (repo_id, path)
  WHERE f.base IN ('requirements.txt', 'pyproject.toml', 'package.json', 'Gemfile', 'Cargo.toml',
    'Pipfile') AND {_IN_SCOPE.replace('path', 'f.path').replace('base', 'f.base')}),
sections AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^\s*\[+[^\[\]]*\]+\s*$')
      THEN regexp_replace(line, '\s', '', 'g') END IGNORE NULLS)
    OVER (PARTITION BY repo_id, path ORDER BY line_no) AS section,
    nullif(regexp_extract(line, '^\s*([\w-]+)\s*=', 1), '') AS key FROM ml),
keys AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY repo_id, path, section
  ORDER BY line_no) AS current_key FROM sections),
specs AS (
  SELECT repo_id, path, base, line_no, regexp_replace(line, '\s*#.*$', '') AS spec FROM ml
  WHERE base = 'requirements.txt' AND regexp_matches(line, '\S')
    AND NOT regexp_matches(line, '^\s*(#|-r|--requirement|-e|git[+])')
  UNION ALL
  SELECT repo_id, path, base, line_no, trim(item, '"''') FROM (SELECT *, unnest(
      regexp_extract_all(line, '"[^"]*"|''[^'']*''')) AS item FROM keys
    WHERE base = 'pyproject.toml' AND NOT regexp_matches(line, '^\s*#')
      AND (section = '[project]' AND current_key = 'dependencies'
        OR section = '[project.optional-dependencies]'))),
parsed AS (
  SELECT repo_id, path, base, line_no,
    lower(trim(regexp_extract(spec, '^([\w. -]*)', 1))) AS package,
    trim(regexp_extract(regexp_extract(spec, '^[^;]*'), '([<>=!~]+.*)$', 1)) AS requested FROM specs
  UNION ALL
  SELECT repo_id, path, base, line_no, lower(key), {_VALUE} FROM sections
  WHERE key IS NOT NULL AND (base = 'Cargo.toml' AND contains(section, 'dependencies')
    OR base = 'Pipfile' AND section IN ('[packages]', '[dev-packages]')
    OR base = 'pyproject.toml' AND key <> 'python' AND regexp_matches(section,
      '^\[tool[.]poetry[.](dependencies|dev-dependencies|group[.].*[.]dependencies)\]$'))
  UNION ALL
  SELECT repo_id, path, base, line_no, lower(regexp_extract(line, '^\s*gem\s+["'']([^"'']*)', 1)),
    regexp_extract(line, ',\s*["'']([^"'']*)', 1)
  FROM ml WHERE base = 'Gemfile' AND regexp_matches(line, '^\s*gem\s')
  UNION ALL
  SELECT repo_id, path, base, pos, lower(k), json_extract_string(content, '$.' || part || '."' || k || '"')
  FROM (SELECT repo_id, path, base, content, part, pos,
      unnest(json_keys(content, '$.' || part)) AS k
    FROM files, (VALUES ('dependencies', 1), ('devDependencies', 2), ('optionalDependencies', 3),
      ('peerDependencies', 4)) AS p(part, pos)
    WHERE base = 'package.json' AND {_IN_SCOPE} AND json_valid(content))),
declared AS (SELECT repo_id, path AS manifest, package, CASE base WHEN 'package.json' THEN 'npm'
    WHEN 'Gemfile' THEN 'rubygems' WHEN 'Cargo.toml' THEN 'crates' ELSE 'pypi' END AS ecosystem,
    nullif(requested, '') AS requested, line_no,
    2 * list_position(['requirements.txt', 'pyproject.toml', 'package.json', 'Gemfile',
      'Cargo.toml', 'Pipfile'], base) - CASE WHEN path = base THEN 1 ELSE 0 END AS manifest_rank
  FROM parsed)"""


@query("deps_parsed", with_ctes(FILES, lines_cte(), PARSED_SQL, select="""
SELECT repo_id, manifest, package, ecosystem, requested FROM declared"""))
def deps_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.declared_dependencies(Corpus(spark, sf_dir).files).select(
        "repo_id", "manifest", "package", "ecosystem", "requested")


@query("deps_unique", with_ctes(FILES, lines_cte(), PARSED_SQL, select="""
SELECT repo_id, package, ecosystem, manifest, requested FROM (SELECT *, row_number() OVER (
    PARTITION BY repo_id, package, ecosystem ORDER BY manifest_rank,
      len(string_split(manifest, '/')), manifest, line_no) AS n FROM declared) WHERE n = 1"""))
def deps_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = manifests.declared_dependencies(Corpus(spark, sf_dir).files)
    return manifests.unique_dependencies(deps).select(
        "repo_id", "package", "ecosystem", "manifest", "requested")


# --- checks against the registry --------------------------------------------------------------
_POPULAR = ("popular(ecosystem, name, pos) AS (VALUES " + ", ".join(
    f"('{e}', '{n}', {i})" for e, names in dependencies.POPULAR.items()
    for i, n in enumerate(names)) + ")")


def _parts_sql(v: str) -> str:
    return (rf"list_concat(list_transform(list_filter(string_split_regex({v}, '[.\-]'), "
            r"lambda s: regexp_matches(s, '^\d')), lambda s: coalesce(TRY_CAST("
            r"regexp_extract(s, '^\d+') AS DECIMAL(38, 0)), CAST(repeat('9', 38) AS DECIMAL(38, 0)))), [0, 0, 0])[1:3]")


def _range_sql(v: str) -> str:
    """(parts without zeros at the end, each with its length in front; 0 for a release candidate, else 1):
    compares as versions do, of the kinds that the derived tables hold."""
    numbers = rf"regexp_replace(regexp_extract({v}, '^[\d.]+'), '(\.0+)+$', '')"
    return (rf"{{'parts': list_transform(string_split({numbers}, '.'), lambda s: {{'n': length(ltrim(s, '0')), 'd': ltrim(s, '0')}}), "
            rf"'final': CASE WHEN regexp_matches({v}, 'rc') THEN 0 ELSE 1 END}}")


CHECKED_SQL = rf"""uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, package, ecosystem
    ORDER BY manifest_rank, manifest, ord) AS n FROM deps) WHERE n = 1),
facts AS (SELECT ecosystem, package, http_status,
    CASE WHEN http_status = 200 THEN latest_version END AS latest,
    CASE WHEN http_status = 200 AND ecosystem <> 'rubygems' THEN released END AS released,
    CASE WHEN http_status = 200 AND ecosystem IN ('rubygems', 'crates') THEN loads END AS loads,
    CASE WHEN package NOT IN (SELECT name FROM popular p WHERE p.ecosystem = r.ecosystem) THEN
      (SELECT first(name ORDER BY pos) FROM popular p WHERE p.ecosystem = r.ecosystem
        AND levenshtein(name, package) BETWEEN 1 AND 2) END AS similar
  FROM registry r),
checked AS (SELECT u.*, http_status, latest, released, loads, "similar",
    nullif(regexp_extract(requested, '\d[\d.]*'), '') AS base FROM uniq u
  JOIN facts USING (ecosystem, package)),
ages AS (SELECT *, floor((epoch(TIMESTAMP '{AS_OF}')
      - epoch(CAST(replace(replace(released, 'T', ' '), 'Z', '') AS TIMESTAMP))) / 86400) / 365.25 AS age,
    {_parts_sql('base')} AS have, {_parts_sql('latest')} AS newest FROM checked),
stale AS (SELECT *, CASE
    WHEN age >= 3 THEN 'deprecated — last release ' || printf('%.1f', age) || ' years ago'
    WHEN newest[1] - have[1] >= 2 THEN CAST(newest[1] - have[1] AS VARCHAR) || ' major versions behind (' || base || ' → ' || latest || ')'
    WHEN newest[1] - have[1] = 1 THEN '1 major version behind (' || base || ' → ' || latest || ')'
    WHEN newest[1] = have[1] AND newest[2] - have[2] >= 3 THEN CAST(newest[2] - have[2] AS VARCHAR) || ' minor versions behind (' || base || ' → ' || latest || ')' END AS why,
    CASE WHEN age >= 3 OR newest[1] - have[1] >= 2 THEN 'high' ELSE 'medium' END AS sev FROM ages)""".replace(
        "END AS similar", 'END AS "similar"')
_DEP = dict(analyzer="'dependencies'", file="manifest", line="CAST(NULL AS BIGINT)")
_VULN = "'vulnerable_dependency'"
_URL = ("CASE ecosystem WHEN 'pypi' THEN 'https://pypi.org/pypi/' || package || '/json' "
        "WHEN 'npm' THEN 'https://registry.npmjs.org/' || package WHEN 'rubygems' THEN "
        "'https://rubygems.org/api/v1/gems/' || package || '.json' ELSE "
        "'https://crates.io/api/v1/crates/' || package END")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def unique(c: Corpus) -> DataFrame:
    return manifests.unique_dependencies(c.deps)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    facts = dependencies.package_facts(registry(c.registry_raw), as_of())
    return dependencies.with_facts(unique(c), facts)


@query("deps_missing", with_ctes(DEPS, REGISTRY, _POPULAR, CHECKED_SQL, select=findings_sql(
    "checked", **_DEP, category="'hallucinated_dependency'", severity="'critical'", ord="1",
    title="'Hallucinated Package: ' || package",
    description="'Package ''' || package || ''' does not exist on ' || upper(ecosystem) || ' "
                "(HTTP 404). Likely hallucinated by an LLM.' || coalesce(' Did you mean ''' || "
                "\"similar\" || '''?', '')", evidence=f"{_URL} || ' → 404 Not Found'",
    where="http_status = 404")))
def deps_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(emit(_checked(spark, sf_dir), [dependencies.missing_package()]))


@query("deps_typosquat", with_ctes(DEPS, REGISTRY, _POPULAR, CHECKED_SQL, select=findings_sql(
    "checked", **_DEP, category=_VULN, severity="'medium'", ord="4", confidence="0.7",
    title="'Possible Typosquat: ' || package",
    description="'Package ''' || package || ''' is very similar to popular package ''' || "
                "\"similar\" || ''' (Levenshtein distance ≤ 2). This could be a typosquat or a "
                "typo.'", evidence="'Levenshtein distance to ''' || \"similar\" || ''' ≤ 2'",
    where='http_status = 200 AND "similar" IS NOT NULL')))
def deps_typosquat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(emit(_checked(spark, sf_dir), [dependencies.typosquat()]))


@query("deps_stale", with_ctes(DEPS, REGISTRY, _POPULAR, CHECKED_SQL, select=findings_sql(
    "stale", **_DEP, category=_VULN, severity="sev", ord="2", confidence="0.9",
    title="'Outdated Package: ' || package",
    description="'Package ''' || package || ''' is ' || why || '.'",
    evidence="'Requested: ' || coalesce(requested, 'unpinned') || ', Latest: ' || latest",
    where="http_status = 200 AND why IS NOT NULL")))
def deps_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(emit(_checked(spark, sf_dir), [dependencies.stale_package()]))


@query("deps_low_downloads", with_ctes(DEPS, REGISTRY, _POPULAR, CHECKED_SQL, select=findings_sql(
    "checked", **_DEP, category=_VULN, severity="'high'", ord="3",
    title="'Suspicious Low-Download Package: ' || package",
    description="'Package ''' || package || ''' has only ' || loads || ' weekly downloads on ' || "
                "upper(ecosystem) || '. Low-popularity packages are higher risk for supply chain "
                "attacks.'", evidence="loads || ' weekly downloads'",
    where="http_status = 200 AND loads < 100")))
def deps_low_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(emit(_checked(spark, sf_dir), [dependencies.rarely_loaded()]))


@query("deps_advisories", with_ctes(DEPS, REGISTRY, ADVISORIES_SQL, _POPULAR, CHECKED_SQL, rf"""
hit AS (SELECT c.* REPLACE (exact AS base), advisory, introduced, fixed, a.severity AS sev
  FROM (SELECT *, nullif(regexp_extract(requested, '\d[-\w.]*'), '') AS exact FROM checked) c
  JOIN advisories a USING (ecosystem, package) WHERE exact IS NOT NULL
    AND (introduced IS NULL OR {_range_sql('exact')} >= {_range_sql('introduced')})
    AND (fixed IS NULL OR {_range_sql('exact')} < {_range_sql('fixed')}))""", select=findings_sql(
    "hit", **_DEP, category=_VULN, severity="sev", ord="5", cwe="advisory",
    title="'CVE: ' || package || '==' || base || ' — ' || advisory",
    description="'Version ' || base || ' of ''' || package || ''' is affected by ' || advisory || "
                "'.'", evidence="'https://osv.dev/vulnerability/' || advisory")))
def deps_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return shown(dependencies.known_vulnerabilities(unique(c), c.advisories))


_HEALTH_SQL = r"""health AS (SELECT *, CASE WHEN http_status IS DISTINCT FROM 200 THEN 'not_found'
    WHEN age >= 3 THEN 'deprecated' WHEN latest IS NULL THEN 'unknown'
    WHEN base IS NULL OR newest <= have THEN 'current'
    WHEN newest[1] - have[1] >= 2 THEN 'major2' WHEN newest[1] > have[1] THEN 'major1'
    WHEN newest[2] - have[2] >= 3 THEN 'minor3' WHEN newest[2] > have[2] THEN 'minor1'
    ELSE 'patch' END AS state FROM ages),
scored AS (SELECT *, CASE state WHEN 'not_found' THEN 0 WHEN 'deprecated' THEN 0
    WHEN 'unknown' THEN 8 WHEN 'current' THEN 10 WHEN 'major2' THEN 1 WHEN 'major1' THEN 3
    WHEN 'minor3' THEN 5 WHEN 'minor1' THEN 7 ELSE 9 END AS points,
    CASE WHEN state IN ('not_found', 'deprecated') THEN state WHEN state IN ('unknown', 'current')
      THEN 'up_to_date' ELSE 'outdated' END AS bucket FROM health)"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return dependencies.package_health(unique(c), registry(c.registry_raw), as_of())


@query("deps_health_packages", with_ctes(DEPS, REGISTRY, _POPULAR, CHECKED_SQL, _HEALTH_SQL,
                                         select="""
SELECT repo_id, package, ecosystem, requested, latest, CAST(points AS BIGINT) AS score, bucket
FROM scored"""))
def deps_health_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select(
        "repo_id", "package", "ecosystem", "requested", "latest",
        F.col("score").cast("bigint").alias("score"), "bucket")


@query("deps_health", with_ctes(DEPS, REGISTRY, _POPULAR, CHECKED_SQL, _HEALTH_SQL, """
sums AS (SELECT repo_id, sum(points) AS points, count(*) AS n,
    count(*) FILTER (bucket = 'up_to_date') AS up_to_date,
    count(*) FILTER (bucket = 'outdated') AS outdated,
    count(*) FILTER (bucket = 'deprecated') AS deprecated,
    count(*) FILTER (bucket = 'not_found') AS not_found FROM scored GROUP BY repo_id)""", select="""
SELECT 'team-' || CAST(s_suppkey AS VARCHAR) AS repo_id,
  CASE WHEN n IS NULL THEN 10.0 ELSE CAST((20 * points + n) // (2 * n) AS DOUBLE) / 10 END AS score,
  coalesce(n, 0) AS total_packages, coalesce(up_to_date, 0) AS up_to_date,
  coalesce(outdated, 0) AS outdated, coalesce(deprecated, 0) AS deprecated,
  coalesce(not_found, 0) AS not_found
FROM supplier LEFT JOIN sums ON sums.repo_id = 'team-' || CAST(s_suppkey AS VARCHAR)"""))
def deps_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = Corpus(spark, sf_dir).table("supplier").select(
        F.concat(F.lit("team-"), F.col("s_suppkey")).alias("repo_id"))
    return dependencies.health_report(_health(spark, sf_dir), repos)


# --- ingestion --------------------------------------------------------------------------------
@query("ingest_registry", with_ctes(REGISTRY, select="""
SELECT ecosystem, package, CAST(http_status AS BIGINT) AS http_status,
  CASE WHEN http_status = 200 THEN latest_version END AS latest_version,
  CASE WHEN http_status = 200 AND ecosystem <> 'rubygems' THEN released END AS latest_release_date,
  CASE WHEN http_status = 200 AND ecosystem IN ('rubygems', 'crates') THEN loads END AS downloads
FROM registry"""))
def ingest_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(Corpus(spark, sf_dir).registry_raw).withColumn(
        "http_status", F.col("http_status").cast("bigint"))


# The expected findings come straight from the columns the reports were written from.
_PARTS = """parts AS (SELECT *, 'team-' || CAST(p_size AS VARCHAR) AS repo_id FROM part WHERE p_size <> 50)"""


def _pick(n: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{n} % {len(values)} + 1]"


def _with_empty(full: str, empty: str) -> str:
    return f"SELECT {full} FROM parts UNION ALL SELECT {empty} FROM parts"


query("ingest_bandit", with_ctes(_PARTS, "r AS (" + _with_empty(
    f"""repo_id, 0 AS ord, 'src/' || p_name AS path, p_partkey AS line_no, 'T' || p_size AS title,
    {_pick('p_partkey', 'low', 'medium', 'high', 'medium')} AS sev, p_type AS text,
    p_brand AS code, 'CWE-' || p_size AS cwe,
    [1.0, 0.7, 0.4, 0.7][p_size % 4 + 1] AS conf""",
    "repo_id, 1, '', 0, 'Bandit Issue', 'medium', '', '', NULL, 0.7") + ")", select=findings_sql(
        "r", analyzer="'sast'", category="'sast'", title="title", severity="sev", ord="ord",
        description="text", evidence="code", cwe="cwe", confidence="conf")))(
    lambda spark, sf_dir: shown(R.bandit(Corpus(spark, sf_dir).reports)))
query("ingest_semgrep", with_ctes(_PARTS, "r AS (" + _with_empty(
    f"""repo_id, 0 AS ord, 'src/' || p_name AS path, p_partkey AS line_no, 'rule-' || p_size AS title,
    {_pick('p_partkey', 'info', 'medium', 'high', 'medium')} AS sev, p_type AS text,
    p_brand AS code, 'CWE-' || p_size AS cwe""",
    "repo_id, 1, '', 0, 'Semgrep Issue', 'medium', 'Semgrep rule matched.', '', NULL") + ")",
    select=findings_sql("r", analyzer="'sast'", category="'sast'", title="title", severity="sev",
                        ord="ord", description="text", evidence="code", cwe="cwe")))(
    lambda spark, sf_dir: shown(R.semgrep(Corpus(spark, sf_dir).reports)))
query("ingest_semgrep_compliance", with_ctes(_PARTS, "r AS (" + _with_empty(
    f"""repo_id, 0 AS ord, 'src/' || p_name AS path, p_partkey AS line_no, 'rule-' || p_size AS title,
    {_pick('p_partkey', 'low', 'medium', 'high', 'medium')} AS sev, p_type AS text, p_brand AS code,
    {_pick('p_partkey', 'compliance_gdpr', 'compliance_soc2')} AS cat""",
    f"""repo_id, 1, '', NULL, 'compliance-issue', 'medium', 'Compliance issue detected by semgrep', '',
    {_pick('p_partkey', 'compliance_gdpr', 'compliance_soc2')}""") + ")", select=findings_sql(
        "r", analyzer="'compliance'", category="cat", title="title", severity="sev", ord="ord",
        description="text", evidence="code")))(
    lambda spark, sf_dir: shown(R.semgrep_compliance(Corpus(spark, sf_dir).reports)))
query("ingest_semgrep_injection", with_ctes(_PARTS, "r AS (" + _with_empty(
    """repo_id, 'src/' || p_name AS path, CAST(p_partkey AS BIGINT) AS line_no,
    'rule-' || p_size AS rule_id, p_type AS message""",
    "repo_id, '', 1, 'prompt-injection', 'Potential prompt injection surface'") + ")",
    select="SELECT * FROM r"))(
    lambda spark, sf_dir: R.semgrep_injection_hits(Corpus(spark, sf_dir).reports).withColumn(
        "line_no", F.col("line_no").cast("bigint")))
_NPM_SEV = _pick("p_size", "critical", "high", "moderate", "low", "info", "odd")
query("ingest_npm", with_ctes(_PARTS, "r AS (" + _with_empty(
    f"""repo_id, 'svc' || p_size || '/package.json' AS path, 'pkg-' || p_partkey AS package,
    {_pick('p_size', 'critical', 'high', 'medium', 'low', 'info', 'medium')} AS sev,
    'CVE: pkg-' || p_partkey || ' — T' || p_size AS title, 'npm audit found a ' || {_NPM_SEV}
      || ' vulnerability in ''pkg-' || p_partkey || '''. T' || p_size || ' | U (CVE-' || p_partkey || ')' AS text,
    'https://a/' || p_partkey AS ev, 'CVE-' || p_partkey AS cwe,
    'Update ''pkg-' || p_partkey || ''' to a patched version.' || CASE p_partkey % 3
      WHEN 0 THEN ' Run `npm audit fix` to resolve.' WHEN 1 THEN '' ELSE
      ' Fix: update to fixed@' || p_size || '.1' END AS remediation""",
    """repo_id, 'svc' || p_size || '/package.json', 'plain-' || p_partkey, 'medium',
    'CVE: plain-' || p_partkey || ' — Known vulnerability in plain-' || p_partkey,
    'npm audit found a moderate vulnerability in ''plain-' || p_partkey || '''. ',
    'npm audit --json (moderate)', NULL,
    'Update ''plain-' || p_partkey || ''' to a patched version.'""") + ")", select="""
SELECT repo_id, path AS file, sev AS severity, title, text AS description, ev AS evidence, cwe,
  remediation FROM r"""))(
    lambda spark, sf_dir: R.npm_audit(Corpus(spark, sf_dir).reports).select(
        "repo_id", "file", "severity", "title", "description", "evidence", "cwe", "remediation"))
query("ingest_pip", with_ctes(_PARTS, "r AS (" + _with_empty(
    """repo_id, 'CVE: pkg-' || p_partkey || '==' || p_size || '.0 — PYSEC-' || p_partkey AS title,
    'pip-audit found vulnerability PYSEC-' || p_partkey || ' in ''pkg-' || p_partkey || '==' || p_size
      || '.0''. ' || left(repeat(p_type || ' ', 30), 200) AS text,
    'Update ''pkg-' || p_partkey || ''' to ' || p_size || '.1, ' || p_size || '.2' AS remediation,
    'PYSEC-' || p_partkey AS cwe""",
    """repo_id, 'CVE: pkg-' || p_partkey || '==' || p_size || '.0 — X',
    'pip-audit found vulnerability X in ''pkg-' || p_partkey || '==' || p_size
      || '.0''. No description available',
    'Check for a patched version of ''pkg-' || p_partkey || '''', 'X'""") + ")", select="""
SELECT repo_id, title, text AS description, remediation, cwe, 'high' AS severity FROM r"""))(
    lambda spark, sf_dir: R.pip_audit(Corpus(spark, sf_dir).reports).select(
        "repo_id", "title", "description", "remediation", "cwe", "severity"))
query("ingest_malformed", """
SELECT tool, count(*) FILTER (p_size = 50) AS malformed, count(*) AS total
FROM part, (VALUES ('bandit'), ('semgrep'), ('semgrep-compliance'),
  ('semgrep-injection'), ('npm-audit'), ('pip-audit'))
  AS t(tool) GROUP BY tool""")(
    lambda spark, sf_dir: R.malformed_counts(Corpus(spark, sf_dir).reports))
