"""URL filter: pattern rules, indexed by their rarest literal token.

A rule is a regular expression over ``host || path`` of a URL together with literal tokens that
every match contains. Counting the tokens of all URLs tells which token of a rule is the rarest;
the rule is filed under that one. A URL looks up its own tokens in this index, and only the rules
so found run their regular expression.

Defined cases. A null URL, or one without ``://``, has an empty host and path; no rule fits it and
the default verdict holds. Empty tables give empty results. Repeated rows are judged one by one.
Of several rules that fit, site rules go before patterns, then the longest wins, then the smallest
rule text. A rule without literal tokens is refused (ValueError), since no index could find it.
Only the named columns of the input are read, so further columns can't clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path): what the site rules of the production run are.
SITE_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
              ("allow", "org/fr/")]
#: (pattern over host and path, literal tokens): junk sites and pages.
SPAM_PATTERNS = [
    (r"(^|[.-])casino[.-]", ["casino"]),
    (r"(^|[.-])poker[.-]", ["poker"]),
    (r"(^|[.-])cheap-pills[.-]", ["cheap", "pills"]),
    (r"(^|[.-])online-pharmacy[.-]", ["online", "pharmacy"]),
    (r"(^|[.-])spam-farm[.-]", ["spam", "farm"]),
    (r"(^|[.-])free-download[s]?[.-]", ["free"]),
    (r"/(wp-login|xmlrpc)\.php$", ["php"]),
]
RULE_SCHEMA = "rule string, site boolean, verdict string, pattern string, tokens array<string>"


def site_rule(verdict: str, rule: str) -> tuple:
    """A host with all its subdomains, and the beginning of a path."""
    host, slash, path = rule.partition("/")
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return rule, True, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", \
        sorted({t.lower() for t in whole})


def rule_table(spark: SparkSession, sites: list[tuple[str, str]] = SITE_RULES,
               patterns: list[tuple[str, list[str]]] = SPAM_PATTERNS) -> DataFrame:
    rows = [site_rule(v, r) for v, r in sites] + [(p, False, "block", p, t) for p, t in patterns]
    if bare := [r[0] for r in rows if not r[4]]:
        raise ValueError(f"rules without a literal token: {bare}")
    return spark.createDataFrame(rows, RULE_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")),
                  F.substring(url, F.locate("://", url) + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(place: Column) -> Column:
    return F.array_distinct(F.array_remove(
        F.split(F.translate(place, UPPER, LOWER), "[^a-z0-9]+"), ""))


def rarest_token_index(rules: DataFrame, places: DataFrame) -> DataFrame:
    """(token, rule...): each rule under the token of its own that the fewest ``place``s have."""
    wanted = rules.select("rule", F.explode("tokens").alias("token"))
    seen = (places.select(F.explode(url_tokens(F.col("place"))).alias("token"), "times")
            .join(wanted.select("token").distinct(), "token", "left_semi")
            .groupBy("token").agg(F.sum("times").alias("seen")))
    best = (wanted.join(seen, "token", "left")
            .groupBy("rule").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"),
                                                "token")).alias("best")))
    return rules.drop("tokens").join(best, "rule").select("*", F.col("best.token").alias("token"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, the site rule that decided (else null), the pattern that
    decided (else null), verdict. Equal places are judged once; the judgements of those that some
    rule fits are joined back by place, where adaptive execution splits a frequent place."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    place = F.concat("host", "path").alias("place")
    places = parts.select(place).groupBy("place").agg(F.count("*").alias("times"))
    fits = (places.select("place", F.explode(url_tokens(F.col("place"))).alias("token"))
            .join(rarest_token_index(rules, places), "token")
            .filter(F.expr("place rlike pattern")))
    order = F.struct((~F.col("site")).alias("o1"), (-F.length("rule")).alias("o2"),
                     F.col("rule").alias("o3"))
    decided = fits.groupBy("place").agg(
        F.min_by(F.struct("rule", "site", "verdict"), order).alias("hit"))
    return (parts.select("*", place).join(decided, "place", "left")
            .select(id_col, "host", "path",
                    F.when(F.col("hit.site"), F.col("hit.rule")).alias("rule"),
                    F.when(~F.col("hit.site"), F.col("hit.rule")).alias("pattern"),
                    F.coalesce("hit.verdict", F.lit(default)).alias("verdict")))


def judge_sql() -> str:
    """The judgement of ``pages`` by SITE_RULES and SPAM_PATTERNS as plain SQL."""
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    sites = sorted(SITE_RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = {}
    for _, r in sites:
        h, slash, p = r.partition("/")
        fits[r] = (f"((host = {text(h)} OR ends_with(host, {text('.' + h)})) AND "
                   f"starts_with(path, {text(slash + p)}))")
    pats = sorted((p for p, _ in SPAM_PATTERNS), key=lambda p: (-len(p), p))
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN {text(r)}" for _, r in sites) + " END"
    pattern = "CASE " + " ".join(
        f"WHEN regexp_matches(host || path, {text(p)}) THEN {text(p)}" for p in pats) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN {text(r)} THEN {text(v)}" for v, r in sites) + " END"
    return f"""WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
    ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
found AS (SELECT *, {rule} AS rule, {pattern} AS any_pattern FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN any_pattern END AS pattern,
  coalesce({verdict}, CASE WHEN any_pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM found"""
