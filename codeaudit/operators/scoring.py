"""Scores, grades, verdicts, gates and report aggregates over the findings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeaudit.model import (
    ANALYZERS, DEFAULT_GROUP, DEFAULT_WEIGHT, FAST_ANALYZERS, GRADES, GROUP_OF_ANALYZER,
    GROUP_OF_CATEGORY, LAST_VERDICT, PENALTIES, SEVERITIES, VERDICTS, WEIGHTS, emission_order,
    lookup, severity_rank,
)

SALTS = 64
ORDER_NAMES = [f"o{i}" for i in range(6)]
PART_ORDER = ["neg_penalty", *ORDER_NAMES, "cost"]
PART_STATE = ("cost long, n_findings long, first array<struct<neg_penalty: long, o0: long, o1: long, "
              "o2: string, o3: long, o4: string, o5: double, cost: long>>")


def with_group(findings: DataFrame, strict_groups: bool = False) -> DataFrame:
    """Add the scoring group. Categories without one fall back to code quality; ``strict_groups``
    credits imports to dependencies and framework checks to sast instead."""
    groups = dict(GROUP_OF_CATEGORY)
    if strict_groups:
        groups |= {"hallucinated_import": "dependencies", "framework_specific": "sast"}
    return findings.withColumn("grp", lookup(groups, F.col("category"), DEFAULT_GROUP))


def group_state(findings: DataFrame, strict_groups: bool = False) -> DataFrame:
    """(repo_id, grp, cost, n_findings, first): all that a group's score depends on.

    In order of penalty, ties in order of emission, the first three findings of a group cost their
    full penalty, the next two a half, all others a quarter, each times its confidence. So a score
    needs the sum over all findings and the first five by order. Rows are shuffled once by
    (repo_id, grp, salt); each salt yields its sum and its own first five, and the second
    aggregation sees at most five rows per salt, however large a group is.
    """
    rows = _priced(findings, strict_groups)
    keys = ["neg_penalty", *ORDER_NAMES]
    ranked = rows.withColumn("pos", F.row_number().over(
        Window.partitionBy("repo_id", "grp", "salt").orderBy(*keys)))
    first = F.collect_list(F.when(F.col("pos") <= 5, F.struct(*keys, "cost")))
    salted = ranked.groupBy("repo_id", "grp", "salt").agg(
        F.sum("cost").cast("decimal(28,6)").alias("cost"), F.count("*").alias("n_findings"),
        first.alias("first"))
    return merge_states(salted.drop("salt"))


def _priced(findings: DataFrame, strict_groups: bool) -> DataFrame:
    """(repo_id, grp, neg_penalty, order of emission, cost, salt) per finding."""
    penalty = lookup(PENALTIES, F.col("severity"), 0).cast("int")
    return with_group(findings, strict_groups).select(
        "repo_id", "grp", (-penalty).alias("neg_penalty"),
        *[c.alias(n) for c, n in zip(emission_order(), ORDER_NAMES)],
        (penalty * F.col("confidence").cast("decimal(9,6)")).alias("cost"),
        F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))


def part_rows(findings: DataFrame, strict_groups: bool = False) -> DataFrame:
    """Findings as the rows whose sums and first five make ``PART_STATE``: costs in millionths, the
    place of each within the order of its equals, no nulls."""
    rank, ord_, file, line, id_, confidence = (F.col(n) for n in ORDER_NAMES)
    number = lambda c, kind: F.coalesce(c.cast(kind), F.lit(-1).cast(kind))
    return _priced(findings, strict_groups).select(
        "repo_id", "grp", F.col("salt").cast("long").alias("salt"),
        F.col("neg_penalty").cast("long").alias("neg_penalty"), number(rank, "long").alias("o0"),
        number(ord_, "long").alias("o1"), file.alias("o2"), line.cast("long").alias("o3"),
        F.coalesce(id_, F.lit("")).alias("o4"), number(confidence, "double").alias("o5"),
        F.coalesce((F.col("cost") * 1000000).cast("long"), F.lit(0)).alias("cost"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Group states, as ``group_state`` gives them, of (repo_id, grp, PART_STATE) rows."""
    money = lambda c: (c.cast("decimal(22,0)") / F.lit(1000000).cast("decimal(7,0)")).cast(
        "decimal(28,6)")
    first = F.transform("first", lambda f: F.struct(
        *[f[n].alias(n) for n in PART_ORDER[:-1]], money(f["cost"]).alias("cost")))
    return merge_states(parts.select("repo_id", "grp", money(F.col("cost")).alias("cost"),
                                     "n_findings", first.alias("first")))


def merge_states(states: DataFrame) -> DataFrame:
    """States of parts of a repository's findings as one state per group."""
    return states.groupBy("repo_id", "grp").agg(
        F.sum("cost").cast("decimal(28,6)").alias("cost"),
        F.sum("n_findings").alias("n_findings"),
        F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 5).alias("first"))


def scores_of(states: DataFrame) -> DataFrame:
    """(repo_id, grp, n_findings, score) of group states."""
    extra = F.aggregate(
        F.transform("first", lambda f, i: f["cost"] * F.when(i < 3, F.lit(0.75)).otherwise(
            F.lit(0.25)).cast("decimal(3,2)")),
        F.lit(0).cast("decimal(38,8)"), lambda acc, x: (acc + x).cast("decimal(38,8)"))
    lost = F.col("cost") * F.lit("0.25").cast("decimal(3,2)") + extra
    return states.select(
        "repo_id", "grp", "n_findings",
        F.greatest(F.lit(100) - lost, F.lit(0).cast("decimal(38,8)"))
         .cast("decimal(18,8)").alias("score"))


def group_scores(findings: DataFrame, strict_groups: bool = False) -> DataFrame:
    """(repo_id, grp, n_findings, score): 100 less penalties with diminishing returns."""
    return scores_of(group_state(findings, strict_groups))


def scanned_runs(runs: DataFrame, mode: str = "full", only_ok: bool = False) -> DataFrame:
    """Analyzer runs that count: those of the mode; a failed run counts unless ``only_ok``."""
    if mode not in ("full", "fast"):
        raise ValueError(f"mode must be full or fast, not {mode!r}")
    listed = runs.filter(F.col("analyzer").isin(FAST_ANALYZERS if mode == "fast" else ANALYZERS))
    return listed.filter(F.col("status") == "ok") if only_ok else listed


def with_clean_groups(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Add 100 for each group that an analyzer run covers and no finding touches."""
    clean = (runs.select("repo_id", lookup(GROUP_OF_ANALYZER, F.col("analyzer")).alias("grp"))
                 .filter(F.col("grp").isNotNull())
                 .select("repo_id", "grp", F.lit(0).cast("bigint").alias("n_findings"),
                         F.lit(100).cast("decimal(18,8)").alias("score")))
    return scores.unionByName(clean).groupBy("repo_id", "grp").agg(
        F.max("n_findings").alias("n_findings"), F.min("score").alias("score"))


def _weighted() -> list[Column]:
    weight = lookup(WEIGHTS, F.col("grp"), DEFAULT_WEIGHT).cast("decimal(4,3)")
    return [F.sum(F.col("score") * weight).alias("points"), F.sum(weight).alias("weight")]


def _mean() -> Column:
    """Mean by weight with one decimal, ties up; 100 where there is no group."""
    return F.coalesce(F.round(F.col("points") / F.col("weight"), 1).cast("double"), F.lit(100.0))


def composite(scores: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """(repo_id, score) by weight over the groups present; a listed repository without groups
    scores 100."""
    sums = scores.groupBy("repo_id").agg(*_weighted())
    if repos is not None:
        sums = repos.select("repo_id").distinct().join(sums, "repo_id", "left")
    return sums.select("repo_id", _mean().alias("score"))


def _steps(score: Column, steps: Sequence[tuple[int, str]], last: str) -> Column:
    out = F.when(score >= steps[0][0], steps[0][1])
    for bound, name in steps[1:]:
        out = out.when(score >= bound, name)
    return out.otherwise(last)


def grade(score: Column) -> Column:
    return _steps(score, GRADES, "F")


def verdict(score: Column) -> Column:
    return _steps(score, VERDICTS, LAST_VERDICT)


def graded(scores: DataFrame) -> DataFrame:
    return scores.select("repo_id", "score", grade(F.col("score")).alias("grade"),
                         verdict(F.col("score")).alias("verdict"))


def severity_filter(findings: DataFrame, severities: Sequence[str]) -> DataFrame:
    """For display only: scores and gates take the unfiltered findings."""
    return findings.filter(F.col("severity").isin([s.strip().lower() for s in severities]))


def severity_gate(findings: DataFrame, repos: DataFrame, min_severity: str) -> DataFrame:
    """(repo_id, blocked, n) with n findings at or above ``min_severity``."""
    if min_severity.lower() not in SEVERITIES:
        raise ValueError(f"unknown severity {min_severity!r}")
    least = SEVERITIES.index(min_severity.lower()) + 1
    counts = (findings.filter(severity_rank(F.col("severity")) >= least)
              .groupBy("repo_id").agg(F.count("*").alias("n")))
    n = F.coalesce("n", F.lit(0))
    return (repos.select("repo_id").distinct().join(counts, "repo_id", "left")
            .select("repo_id", (n > 0).alias("blocked"), n.alias("n")))


def score_gate(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("repo_id", (F.col("score") < threshold).alias("failed"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(repo_id, severity, n, pos), pos 1 for critical; severities without findings are absent."""
    return (findings.groupBy("repo_id", "severity").agg(F.count("*").alias("n"))
            .withColumn("pos", 6 - severity_rank(F.col("severity"))))


def breakdown(scores: DataFrame) -> DataFrame:
    """Per group: score, bar of 0 to 10 cells, number of findings."""
    return scores.select("repo_id", "grp", F.col("score").cast("double").alias("score"),
                         F.floor(F.col("score") / 10).cast("int").alias("bar"), "n_findings")


def urgent(findings: DataFrame) -> DataFrame:
    """Critical and high findings, to be ordered by ``emission_order`` where they are shown."""
    return findings.filter(F.col("severity").isin("critical", "high"))


def scorecard(findings: DataFrame, runs: DataFrame, inventory: DataFrame,
              tokens: DataFrame | None = None, scan_seconds: DataFrame | None = None,
              mode: str = "full", only_ok: bool = False,
              strict_groups: bool = False) -> DataFrame:
    """One row per repository with every field of a scan result but the findings themselves,
    which stay rows of the findings table (one repository may own a large part of it)."""
    counted = scanned_runs(runs, mode, only_ok)
    scores = with_clean_groups(group_scores(findings, strict_groups), counted)
    repos = inventory.select("repo_id").union(runs.select("repo_id"))
    # one aggregation for all of it: the findings behind the scores are computed once
    sums = scores.groupBy("repo_id").agg(
        *_weighted(), F.sum("n_findings").alias("findings_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "grp", F.round("score", 1).cast("double").alias("score"))))).alias("category_scores"))
    out = (repos.distinct().join(sums, "repo_id", "left").withColumn("score", _mean())
           .join(inventory, "repo_id", "left"))
    if tokens is not None:
        out = out.join(tokens.select("repo_id", F.col("tokens").alias("tokens_used")),
                       "repo_id", "left")
    else:
        out = out.withColumn("tokens_used", F.lit(0).cast("bigint"))
    if scan_seconds is not None:
        out = out.join(scan_seconds.select("repo_id", "scan_time"), "repo_id", "left")
    else:
        out = out.withColumn("scan_time", F.lit(0.0))
    return out.select(
        "repo_id", "score", grade(F.col("score")).alias("grade"),
        verdict(F.col("score")).alias("verdict"), F.coalesce("findings_count", F.lit(0)).alias("findings_count"), "category_scores",
        "scan_time", F.coalesce("languages", F.array().cast("array<string>")).alias("languages"),
        F.coalesce("files_scanned", F.lit(0)).alias("files_scanned"),
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"))
