"""Registered queries: files, lines, pattern rules, secrets."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeaudit.functions.text import explode_lines, line_array, mask, matches
from codeaudit.model import as_findings
from codeaudit.operators import rules, secrets
from codeaudit.plans.common import (
    FILES, TRACKED, findings_sql, lines_cte, matches_cte, query, shown, with_ctes,
)
from codeaudit.plans.corpus import Corpus, sql_text
from codeaudit.sources import files as S
from codeaudit.sources.tree import read_tree, write_tree
from codeaudit.sources.work import work_dir

REPORT_LANG_SQL = ("CASE " + " ".join(
    f"WHEN ext = '{e}' THEN '{n}'" for e, n in S.REPORT_LANGUAGES.items()) + " END")


def _none_of(names: list[str], column: str = "path") -> str:
    return "NOT list_has_any(string_split({}, '/'), [{}])".format(
        column, ", ".join(f"'{n}'" for n in names))


_INVENTORY_DIRS = (_none_of(S.SKIP_INVENTORY, "regexp_replace(path, '[^/]*$', '')")
                   + " AND NOT regexp_matches(path, '(^|/)[.][^/]*/')")
_INVENTORY = f"""inventory AS (
  SELECT repo_id, path, ext FROM files WHERE repo_id NOT IN (SELECT repo_id FROM git_repos)
    AND {_INVENTORY_DIRS}
  UNION ALL
  SELECT f.repo_id, f.path, f.ext FROM files f JOIN tracked t
    ON t.repo_id = f.repo_id AND t.path = f.path)"""


_ON_DISK = """['pkg_{id}/__init__.py', 'web/_app_{id}.tsx', '.github/ci_{id}.yml', 'svc_{id}/.env', 'src/a_{id}.py']"""
_DISK_SQL = f"""placed AS (SELECT doc_id, source AS repo_id, replace({_ON_DISK}[doc_id % 5 + 1], '{{id}}',
    CAST(doc_id AS VARCHAR)) AS path, text AS content FROM documents)"""


def _on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with hidden names and others: doc_id, repo_id, path, content."""
    path = F.expr("element_at(array" + _ON_DISK.replace("[", "(").replace("]", ")") + ", cast(doc_id % 5 + 1 as int))")
    return Corpus(spark, sf_dir).table("documents").select(
        "doc_id", F.col("source").alias("repo_id"), F.col("text").alias("content"),
        F.replace(path, F.lit("{id}"), F.col("doc_id").cast("string")).alias("path"))


@query("read_files", rf"""WITH {_DISK_SQL}
SELECT repo_id, path, regexp_extract(path, '[^/]*$') AS base, length(content) AS n_chars, md5(content) AS content_md5
FROM placed WHERE regexp_matches(content, '\S')""")
def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of all documents, written and read with its hidden names."""
    root = work_dir(spark, "tree")
    write_tree(_on_disk(spark, sf_dir), root)
    return S.read_repositories(spark, root).select(
        "repo_id", "path", "base", F.length("content").cast("bigint").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive: a tar, a zip, a zip with protected members, or a zip that breaks off."""
    repo, kind, out = rows.repo_id.iloc[0], int(rows.kind.iloc[0]), io.BytesIO()
    rows = rows.sort_values("path")
    if kind == 0:
        with tarfile.open(fileobj=out, mode="w") as t:
            for r in rows.itertuples():
                info, data = tarfile.TarInfo("./" + r.path), r.content.encode()
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    else:
        with zipfile.ZipFile(out, "w") as z:
            for r in rows.itertuples():
                z.writestr(r.path, r.content)
    data = bytearray(out.getvalue())
    if kind == 2:  # the flag of protected members, in the directory behind the data
        at = data.rfind(b"PK\5\6")
        start = int.from_bytes(data[at + 16:at + 20], "little")
        for r in zipfile.ZipFile(io.BytesIO(bytes(data))).infolist():
            data[start + 8] |= 1
            data[r.header_offset + 6] |= 1
            start += 46 + sum(int.from_bytes(data[start + i:start + i + 2], "little") for i in (28, 30, 32))
    elif kind == 3:
        data = data[:-22]
    return pd.DataFrame({"repo_id": ["packed"], "path": [f"{repo}.{'zip' if kind else 'tar'}"], "content": [bytes(data)]})


@query("read_packed", f"""WITH {_DISK_SQL},
parts AS (SELECT repo_id || '-' || CAST(doc_id // 200 AS VARCHAR) AS repo_id, CAST(doc_id // 200 AS BIGINT) % 4 AS kind, path,
  coalesce(content, '') AS content FROM placed)
SELECT repo_id, path, kind < 2 AS readable, CASE WHEN kind < 2 THEN md5(content) END AS content_md5 FROM parts WHERE kind < 3
UNION ALL SELECT DISTINCT repo_id, repo_id || '.zip', FALSE, CAST(NULL AS VARCHAR) FROM parts WHERE kind = 3""")
def read_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents packed into archives of some ten files each, among them protected and broken ones."""
    bucket = F.expr("doc_id div 200")
    parts = _on_disk(spark, sf_dir).select(
        F.concat("repo_id", F.lit("-"), bucket).alias("repo_id"), (bucket % 4).alias("kind"), "path",
        F.coalesce("content", F.lit("")).alias("content"))
    root = work_dir(spark, "archives")
    write_tree(parts.groupBy("repo_id", "kind").applyInPandas(_packed, "repo_id string, path string, content binary"), root)
    return read_tree(spark, root, archives=True).select(
        "repo_id", "path", F.col("error").isNull().alias("readable"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("corpus_languages", with_ctes(FILES, TRACKED, _INVENTORY, select=f"""
SELECT repo_id, coalesce(string_agg(DISTINCT {REPORT_LANG_SQL}, ',' ORDER BY {REPORT_LANG_SQL}), '')
  AS languages FROM inventory GROUP BY repo_id"""))
def corpus_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return S.inventory(c.names, c.tracked, c.git_repos).select(
        "repo_id", F.array_join("languages", ",").alias("languages"))


@query("corpus_file_counts", with_ctes(FILES, TRACKED, _INVENTORY, select=f"""
SELECT repo_id, CAST(count(*) FILTER (ext IN ({', '.join(f"'{e}'" for e in S.SCANNABLE)})) AS BIGINT)
  AS files_scanned FROM inventory GROUP BY repo_id"""))
def corpus_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    return S.inventory(c.names, c.tracked, c.git_repos).select("repo_id", "files_scanned")


@query("corpus_tracked", with_ctes(FILES, TRACKED, select="""
SELECT repo_id, path, length(content) AS n_chars FROM files f
WHERE repo_id NOT IN (SELECT repo_id FROM git_repos)
  OR EXISTS (SELECT 1 FROM tracked t WHERE t.repo_id = f.repo_id AND t.path = f.path)"""))
def corpus_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(spark, sf_dir)
    rows = c.files.select("repo_id", "path", F.length("content").cast("bigint").alias("n_chars"))
    return S.only_tracked(rows, c.tracked, c.git_repos, F.lit(True))


@query("corpus_excluded", with_ctes(FILES, select=f"""
SELECT repo_id, path, {_none_of(S.SKIP_STRUCTURE)} AS in_structure,
  {_none_of(S.SKIP_COST)} AS in_cost, {_none_of(S.SKIP_PROFILE)} AS in_profile,
  {_none_of(S.SKIP_MANIFESTS)} AND NOT regexp_matches(path, '(^|/)[.]') AS in_manifests
FROM files WHERE {_none_of(['docs', 'cmd'])} AND NOT starts_with(path, 'tests/')"""))
def corpus_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory filter side by side, after configured excludes and the prefix filter."""
    path = F.col("path")
    rows = S.without_prefix(S.exclude_paths(Corpus(spark, sf_dir).files, ["docs/", "cmd"]),
                            "tests/")
    return rows.select(
        "repo_id", "path", S.outside(path, S.SKIP_STRUCTURE).alias("in_structure"),
        S.outside(path, S.SKIP_COST).alias("in_cost"),
        S.outside(path, S.SKIP_PROFILE).alias("in_profile"),
        S.outside(path, S.SKIP_MANIFESTS, dot_parts=True).alias("in_manifests"))


@query("lines_exploded", """
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, md5(string_agg(line, '|' ORDER BY line_no))
  AS lines_hash
FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
  FROM (SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10)
    THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM documents))
GROUP BY doc_id""")
def lines_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_array(F.col("content"))
    return Corpus(spark, sf_dir).documents.select(
        "doc_id", F.size(lines).cast("bigint").alias("n_lines"),
        F.md5(F.array_join(lines, "|")).alias("lines_hash"))


_CALL = r"\b(\w+)\(\s*[\"']"


@query("match_line_numbers", with_ctes(
    FILES, matches_cte("hits", _CALL, "TRUE", {"called": 1}), select="""
SELECT repo_id, path, CAST(i AS BIGINT) AS hit_no, CAST(line_no AS BIGINT) AS line, called
FROM hits"""))
def match_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = Corpus(spark, sf_dir).files.select(
        "repo_id", "path", F.posexplode(matches(F.col("content"), _CALL, 1)).alias("pos", "m"))
    return hits.select("repo_id", "path", (F.col("pos") + 1).cast("bigint").alias("hit_no"),
                       F.col("m.line").cast("bigint").alias("line"),
                       F.get("m.groups", 0).alias("called"))


# --- rule families ----------------------------------------------------------------------------
_EXCLUDED_HOSTS = "|".join(["localhost", "example[.]", "schemas", r"www[.]w3[.]org", "testserver"])
_RE2 = {
    "va-error-leak": r"(?m)^    except\b[^\n:]*:[^\n]*(?:\n     +[^ \n][^\n]*)*",
    "va-no-auth-middleware":
        r"(?m)^[ \t]*@\w+\.(route|get|post)\([^\n]*\)[ \t]*\n((?:[ \t]*@[^\n]*\n)*)"
        r"[ \t]*def[ \t]+\w+[ \t]*\((ARGS)\)",
}
_CALL_SQL = {  # the call's pattern, and what its text must hold
    "va-broad-cors": (r"\bCORS\s*\(ARGS\)|\ballow_origins\s*=\s*\[\s*[\"']\*[\"']\s*\]",
                      r"^allow_origins|\borigins\s*=\s*[\"']\*[\"']|[\"']origins[\"']\s*:\s*[\"']\*[\"']"),
    "va-hardcoded-jwt": (r"\bjwt\.(?:encode|sign|decode)\s*\(ARGS\)",
                         r"^jwt\.\w+\s*\(\s*(?:[^,()]|\((?:[^()]|\([^()]*\))*\))*,\s*[\"'][^\"'\n]*[\"']"),
    "va-pii-in-logs": (r"(?:\blogging\.\w+|\bprint|\bconsole\.log)\s*\(ARGS\)",
                       r"^(?:logging\.info|print|console\.log)\s*\((?:[^()]*,|\s*\"\)\",)?\s*" + rules.ARG + r"\." + rules.FIELDS
                       + r"\s*[,)]|^logging\.debug\s*\((?:[^()]*,)?\s*" + rules.ARG + r"\.(?:email|password)\s*[,)]"
                       r"|^logging\.\w+\s*\(\s*f[\"'][^\n]*\{" + rules.ARG + r"\." + rules.FIELDS + r"\}"),
    "va-llm-output-to-eval": (r"(?:^|[^\w.])(?:eval|exec)\s*\(ARGS\)", r"\(\s*[A-Za-z_][^,]*\)$"),
    "va-llm-output-to-subprocess": (
        r"\bsubprocess\.(?:run|call|Popen)\s*\(ARGS\)|\bos\.system\s*\(", r"\bshell\s*=\s*True\b|^os"),
    "va-missing-output-validation": (
        rules.MARKS["va-missing-output-validation"].replace("=(?!=)", "=[^=]") + r"|\bdocument\.write\s*\(", ""),
    "va-user-input-to-llm": (r"[\w.]*(?:\.chat\.completions\.create|\.messages\.create|\bopenai\.ChatCompletion\.create)\s*"
                             r"\(ARGS\)", rules.USER_F_STRING),
}
_ARGS = "[^()]*"
for _ in range(5):  # deeper than any call of the derived files
    _ARGS = rf"""(?:[^()"'#]|#[^\n]*|"[^"\n]*"|'[^'\n]*'|\({_ARGS}\))*"""


def _lang_in(rule: rules.LineRule) -> str:
    if not rule.languages:
        return "TRUE"
    return "lang IN ({})".format(", ".join(f"'{x}'" for x in rule.languages))


def _line_rule_sql(rule: rules.LineRule) -> str:
    if rule.id == "va-no-https":
        test = (f"len(list_filter(regexp_extract_all(line, "
                f"{sql_text('http://(' + rules.PLAIN_HTTP_HOST + ')')}, 1), lambda h: NOT "
                f"regexp_matches(h, '^({_EXCLUDED_HOSTS})'))) > 0")
    else:
        test = f"regexp_matches(line, {sql_text(rule.pattern)})"
    code = "" if not rule.languages else f" AND NOT regexp_matches(line, {sql_text(rules.COMMENT)})"
    return (f"SELECT repo_id, path, line_no, line, '{rule.id}' AS rule_id FROM lines "
            f"WHERE {_lang_in(rule)} AND {test}{code}")


SEGMENTS_SQL = """segments AS (
  SELECT h.*, greatest(1, line_no - 15) AS start_line, least(len(ls), line_no + 15) AS end_line,
    array_to_string(ls[greatest(1, line_no - 15):line_no + 15], chr(10)) AS code_segment
  FROM hits h JOIN (SELECT repo_id, path, string_split(CASE WHEN right(content, 1) = chr(10)
    THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS ls FROM files)
    USING (repo_id, path))"""


def _family_sql(family: str) -> str:
    ctes, selects = [FILES, lines_cte()], []
    shift = 100 if family == "soc2" else 0
    conditions = {
        "va-error-leak": f"regexp_matches(match, {sql_text(rules.LEAKED_RETURN)})",
        "va-no-auth-middleware": r"""NOT (verb = 'route' AND
          regexp_matches(more, '(?m)^[ \t]*@login_required\b'))
          AND NOT (verb <> 'route' AND regexp_matches(args, '=\s*Depends\('))""",
    }
    groups = {"va-no-auth-middleware": {"verb": 1, "more": 2, "args": 3}}
    of = [r for r in rules.ALL_RULES if r.family == family]
    for n, rule in enumerate(of):
        if rule.names:
            pattern, holds = _CALL_SQL[rule.id]
            ctes.append(matches_cte(f"m{n}", pattern.replace("ARGS", _ARGS), _lang_in(rule)))
            selects.append(f"""SELECT DISTINCT repo_id, path, line_no, line, '{rule.id}' AS rule_id
              FROM (SELECT repo_id, path, line_no + CAST(starts_with(match, chr(10)) AS INTEGER) AS line_no FROM m{n}
                WHERE regexp_matches(match, {sql_text(holds)})) JOIN lines USING (repo_id, path, line_no)
              WHERE NOT regexp_matches(line, {sql_text(rules.COMMENT)})""")
            continue
        if rule in rules.LINE_RULES:
            selects.append(_line_rule_sql(rule))
            continue
        ctes.append(matches_cte(f"m{n}", _RE2.get(rule.id, rule.pattern).replace("ARGS", _ARGS), _lang_in(rule),
                                groups.get(rule.id)))
        selects.append(
            f"SELECT repo_id, path, line_no, split_part(match, chr(10), 1) AS line, "
            f"'{rule.id}' AS rule_id FROM m{n} WHERE {conditions.get(rule.id, 'TRUE')}")
    case = lambda f: "CASE rule_id " + " ".join(
        f"WHEN '{r.id}' THEN {sql_text(f(r))}" for r in of) + " END"
    ctes.append("hits AS (" + "\nUNION ALL\n".join(selects) + ")")
    if family == "injection":
        ctes.append(SEGMENTS_SQL)
    return with_ctes(*ctes, select=findings_sql(
        "segments" if family == "injection" else "hits", analyzer=f"'{rules.ANALYZER[family]}'", category=f"'{rules.CATEGORY[family]}'",
        title="rule_id", severity=case(lambda r: rules.LEVELS[family][r.level]),
        description=case(lambda r: r.message), evidence="left(code_segment, 500)" if family == "injection" else "line",
        cwe=case(lambda r: r.cwe) if family == "sast" else "CAST(NULL AS VARCHAR)",
        confidence="0.6" if family == "injection" else "1.0",
        ord=f"list_position([{', '.join(sql_text(r.id) for r in of)}], rule_id) + {shift}"))


def _register_family(name: str, family: str) -> None:
    @query(name, _family_sql(family))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(rules.rule_findings(Corpus(spark, sf_dir).files, family))


for _name, _family in (("rules_sast", "sast"), ("rules_gdpr", "gdpr"), ("rules_soc2", "soc2"),
                       ("rules_injection", "injection")):
    _register_family(_name, _family)


@query("insecure_urls", f"""
SELECT page_id, url FROM pages WHERE len(list_filter(regexp_extract_all(url,
  {sql_text('http://(' + rules.PLAIN_HTTP_HOST + ')')}, 1),
  lambda h: NOT regexp_matches(h, '^({_EXCLUDED_HOSTS})'))) > 0""")
def insecure_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.insecure_urls(Corpus(spark, sf_dir).table("pages")).select("page_id", "url")


_MERGE_SQL = with_ctes(FILES, lines_cte(), r"""
calls AS (SELECT repo_id, path, CAST(line_no // 2 AS INTEGER) AS line_no, line_no AS ord, line
  FROM lines WHERE lang IS NOT NULL AND regexp_matches(line, '\w\(')),
semgrep AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, line_no ORDER BY ord DESC) AS n
  FROM calls WHERE contains(line, '"')),
bandit AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, line_no ORDER BY ord) AS n
  FROM calls WHERE lang_py(path))
""".replace("lang_py(path)", "ends_with(path, '.py')"), select="""
SELECT repo_id, path AS file, CAST(line_no AS BIGINT) AS line, 'semgrep' AS tool,
  CAST(ord AS BIGINT) AS ord FROM semgrep WHERE n = 1
UNION ALL
SELECT repo_id, path, CAST(line_no AS BIGINT), 'bandit', CAST(ord AS BIGINT) FROM bandit b
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM semgrep s WHERE s.repo_id = b.repo_id
  AND s.path = b.path AND s.line_no = b.line_no)""")


@query("scanner_merge", _MERGE_SQL)
def scanner_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scanners' findings on pairs of lines, so that both kinds of collision occur."""
    code = S.with_language(Corpus(spark, sf_dir).files)
    calls = explode_lines(code, "repo_id", "path", "ext").filter(F.col("line").rlike(r"\w\("))

    def reported(rows: DataFrame, tool: str) -> DataFrame:
        return as_findings(
            rows, analyzer="sast", ord=F.col("line_no"), title=F.col("line"), severity="medium",
            category="sast", file=F.col("path"), line=F.floor(F.col("line_no") / 2),
            description="", remediation="", tool=tool)

    merged = rules.merge_scanners(
        reported(calls.filter(F.col("line").contains('"')), "semgrep"),
        reported(calls.filter(F.col("ext") == ".py"), "bandit"))
    return merged.select("repo_id", "file", F.col("line").cast("bigint").alias("line"), "tool",
                         "ord")


# --- secrets ----------------------------------------------------------------------------------
_DOC_FILES = """files AS (SELECT source AS repo_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
  '.txt' AS ext, text AS content FROM documents)"""


def _mask_sql(x: str) -> str:
    return f"left({x}, 4) || repeat('*', length({x}) - 4)"


@query("secrets_keyword", with_ctes(_DOC_FILES, lines_cte(), select=f"""
SELECT repo_id, path, CAST(line_no AS BIGINT) AS line_no, secret, {_mask_sql('secret')} AS masked
FROM (SELECT repo_id, path, line_no,
    unnest(regexp_extract_all(line, {sql_text(secrets.KEYWORD)}, 1)) AS secret FROM lines)"""))
def secrets_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.keyword_secrets(Corpus(spark, sf_dir).documents).select(
        "repo_id", "path", F.col("line_no").cast("bigint").alias("line_no"), "secret",
        mask(F.col("secret")).alias("masked"))


@query("secrets_known", with_ctes(FILES, lines_cte(), select="\nUNION ALL\n".join(f"""
SELECT repo_id, path, CAST(line_no AS BIGINT) AS line_no, '{n}' AS rule, '{sev}' AS severity, secret
FROM (SELECT repo_id, path, line_no, unnest(regexp_extract_all(line, {sql_text(p)}, 1)) AS secret
  FROM lines)""" for n, sev, _, p in secrets.KNOWN_FORMATS)))
def secrets_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.known_secrets(Corpus(spark, sf_dir).files).select(
        "repo_id", "path", F.col("line_no").cast("bigint").alias("line_no"), "rule", "severity",
        "secret")


@query("secrets_entropy", with_ctes(_DOC_FILES, lines_cte(), f"""
tokens AS (SELECT row_number() OVER () AS n, * FROM (SELECT repo_id, path, line_no,
    unnest(regexp_extract_all(line, {sql_text(secrets.QUOTED_TOKEN)}, 1)) AS secret FROM lines)),
chars AS (SELECT n, ch, count(*) AS k FROM (SELECT n, unnest(string_split(secret, '')) AS ch
  FROM tokens) GROUP BY n, ch),
scored AS (SELECT n, -sum(k / total * log2(k / total)) AS entropy
  FROM (SELECT *, sum(k) OVER (PARTITION BY n) AS total FROM chars) GROUP BY n)""", select=f"""
SELECT repo_id, path, CAST(line_no AS BIGINT) AS line_no, secret, round(entropy, 4) AS entropy
FROM tokens JOIN scored USING (n)
WHERE entropy > CASE WHEN regexp_matches(secret, '^[0-9a-fA-F]+$') THEN {secrets.MIN_ENTROPY_HEX}
  ELSE {secrets.MIN_ENTROPY_MIXED} END"""))
def secrets_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.entropy_secrets(Corpus(spark, sf_dir).documents).select(
        "repo_id", "path", F.col("line_no").cast("bigint").alias("line_no"), "secret",
        F.round("entropy", 4).alias("entropy"))


def _secrets_sql() -> str:
    """Findings of all detectors over ``files``; a CTE body named secret_findings."""
    known = "\nUNION ALL\n".join(f"""
      SELECT repo_id, path, line_no, line, '{t}' AS title, '{sev}' AS severity, 1.0 AS confidence,
        1 AS ord, unnest(regexp_extract_all(line, {sql_text(p)}, 1)) AS secret FROM lines"""
                                 for _, sev, t, p in secrets.KNOWN_FORMATS)
    reported = " OR ".join(
        f"list_contains(regexp_extract_all(line, {sql_text(p)}, 1), secret)"
        for p in [*[p for *_, p in secrets.KNOWN_FORMATS], secrets.KEYWORD])
    return f"""secret_hits AS ({known}
      UNION ALL
      SELECT repo_id, path, line_no, line, 'Hardcoded Secret', 'high', 1.0, 2,
        unnest(regexp_extract_all(line, {sql_text(secrets.KEYWORD)}, 1)) FROM lines
      UNION ALL
      SELECT repo_id, path, line_no, line, 'High-Entropy String', 'medium', 0.7, 3, secret
      FROM (SELECT *, CASE WHEN length(secret) = 0 THEN 0 ELSE list_sum(list_transform(
          list_distinct(string_split(secret, '')), lambda c:
            -(length(secret) - length(replace(secret, c, ''))) / length(secret)
            * log2((length(secret) - length(replace(secret, c, ''))) / length(secret)))) END AS ent
        FROM (SELECT *, unnest(regexp_extract_all(line, {sql_text(secrets.QUOTED_TOKEN)}, 1))
          AS secret FROM lines))
      WHERE ent > CASE WHEN regexp_matches(secret, '^[0-9a-fA-F]+$')
        THEN {secrets.MIN_ENTROPY_HEX} ELSE {secrets.MIN_ENTROPY_MIXED} END AND NOT ({reported})),
    secret_findings AS (SELECT repo_id, 'secrets' AS analyzer, ord, title, severity,
      'secret' AS category, path AS file, line_no AS line, confidence,
      {_mask_sql('secret')} AS evidence FROM secret_hits)"""


_SECRET_TEXT = ("CASE ord WHEN 1 THEN 'Credential of a known format found in source: ' WHEN 2 THEN "
                "'A string literal is assigned to a secret''s name: ' ELSE "
                "'A random-looking string literal may be a secret: ' END || evidence")


@query("secrets_all", with_ctes(FILES, lines_cte(), _secrets_sql(), select=findings_sql(
    "secret_findings", analyzer="'secrets'", category="'secret'", title="title", file="file",
    line="line", severity="severity", description=_SECRET_TEXT, evidence="evidence",
    cwe="'CWE-798'", confidence="confidence", ord="ord")))
def secrets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(secrets.secret_findings(Corpus(spark, sf_dir).files))
