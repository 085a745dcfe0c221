"""Mixing sources to target weights: temperature, budget, block permutations.

With token shares p of the sources, the weights are p**a, normalised. The exponent a in [0, 1] is
the largest on a grid of 2**-20 at which the weights have an entropy of at least ``entropy`` times the
largest possible, unless that takes some source more often than ``repetitions`` times: then it is the
smallest that doesn't, so that a tiny source bounds how far the weights are tempered instead of being
copied without end. Either goal may be None. Both are bisected, ``WAYS`` candidates per step, in an
aggregation over the sources. Exponent 1 leaves the shares as they are, 0 makes them equal. (A budget
of more than ``repetitions`` times all tokens can't keep the limit; the shares then stay as they are.)

The budget of tokens (default: as many as there are) times its weight is a source's quota. Each
source is a stream of epochs; an epoch is a permutation of its documents by a hash of id, text and
epoch. A document belongs to the mixture for every epoch in which its place in the stream, counted
in tokens, is below the quota. The share of the quota at that place gives the document's block:
blocks hold about ``block_tokens`` tokens at the target weights, and are ordered inside by the same
hash. Running sums go by pieces of hash ranges, whose number follows the size of the source, and
then over the pieces' totals, so no task sorts a whole source.

Defined cases. A null source is a source of its own. Null and empty texts have no tokens; they come
once per begun epoch, where they stand. Repeated rows come together: as one entry with their tokens
added up. A source without tokens, and every source if there are none at all, has an empty quota and
gives nothing. A source of very few tokens comes ``repetitions`` times at most, and once more in part. Empty tables give empty results. Only doc_id, text and source are read; ``mixed``
returns all columns of its input, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeaudit.llm.words import words
from codeaudit.sources.work import stored

ENTROPY, REPETITIONS, BLOCK_TOKENS, PIECE_ROWS = 0.95, 4.0, 1_000_000, 4096
STEPS, WAYS = 4, 32  # 32 candidates in each of 4 steps: 20 bits
GRID = WAYS ** STEPS


def _key(epoch: Column | int) -> Column:
    """Place of a row in its source's permutation."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                             F.col("text_md5"), epoch.cast("string")).cast("binary"))


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_md5, n_tokens, times): one row per distinct row, with how many there
    are."""
    return (docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
                        F.size(words(F.col("text"))).cast("bigint").alias("n_tokens"))
            .groupBy("doc_id", "source", "text_md5", "n_tokens").agg(F.count("*").alias("times")))


def exponent(shares: DataFrame, entropy: float | None = ENTROPY, repetitions: float | None = REPETITIONS,
             budget: Column | None = None) -> float:
    """Bisects the exponent over ``shares`` (source, tokens, share > 0)."""
    n = shares.count()
    if n < 2:
        return 1.0

    def measured(candidates: list[int]) -> list[tuple[int, float, float]]:
        """(candidate, entropy, how often the most repeated source comes)."""
        a = F.explode(F.array([F.lit(c).cast("bigint") for c in candidates])).alias("c")
        power = F.pow(F.col("share"), F.col("c") / GRID)
        rows = (shares.select("share", "tokens", a).withColumn("p", power)
                .groupBy("c").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("share")).alias("l"),
                                  F.sum("tokens").alias("all"),
                                  F.max(F.col("p") / F.col("tokens")).alias("most"))
                .select("c", (F.log("z") - F.col("c") / GRID * F.col("l") / F.col("z")),
                        (F.col("most") / F.col("z") * (budget if budget is not None else F.col("all")))))
        return sorted(map(tuple, rows.collect()))  # a row per candidate

    def last(holds) -> int:
        """The last candidate that ``holds``, which then fails for all larger ones; 0 if none does."""
        low, high = 0, GRID
        if holds(measured([high])[0]):
            return high
        while high - low > 1:
            step = max(1, (high - low) // WAYS)
            for row in measured(list(range(low + step, high, step))):
                if not holds(row):
                    high = row[0]
                    break
                low = row[0]
        return low

    a = GRID if entropy is None else last(lambda r: r[1] >= entropy * math.log(n))
    if repetitions is not None and a < GRID and measured([a])[0][2] > repetitions:
        a = min(GRID, last(lambda r: r[2] > repetitions) + 1)
    return a / GRID


def quotas(rows: DataFrame, entropy: float | None = ENTROPY, repetitions: float | None = REPETITIONS,
           budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, tokens, rows, weight, quota, blocks) of each source with tokens."""
    by = stored(rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"),
                                           F.count("*").alias("rows")).filter("tokens > 0"), "sources")
    total = by.agg(F.sum("tokens").alias("t")).first().t or 0
    shares = by.withColumn("share", F.col("tokens") / F.lit(total or 1))
    budget = total if budget is None else budget
    a = exponent(shares, entropy, repetitions, F.lit(budget))
    power = shares.withColumn("p", F.pow("share", F.lit(a)))
    z = power.agg(F.sum("p").alias("z")).first().z or 1.0
    return stored(power.select(
        "source", "tokens", "rows", F.round(F.col("p") / z, 9).alias("weight"),
        F.lit(a).alias("exponent"), F.round(F.col("p") / z * budget).cast("bigint").alias("quota"))
        .withColumn("blocks", F.lit(max(1, -(-budget // block_tokens))).cast("bigint")), "quotas")


def plan(rows: DataFrame, goal: DataFrame, begun: bool = False) -> DataFrame:
    """Entries of the mixture: ``narrow`` rows with epoch, start (in the source's stream), block and
    key. ``begun``: only those of the last epoch."""
    same = F.col("source").eqNullSafe(F.col("s"))
    goal = goal.select(F.col("source").alias("s"), "tokens", "rows", "quota", "blocks", "weight")
    last = F.expr("(quota - 1) div tokens").cast("int")
    spread = (rows.join(goal.filter("quota > 0"), same)
              .select("*", F.explode(F.array(last) if begun else F.sequence(F.lit(0), last)).alias("epoch"))
              .withColumn("key", _key(F.col("epoch")))
              .withColumn("digits", F.greatest(F.lit(0), F.ceil(
                  F.log(F.col("rows") / PIECE_ROWS) / math.log(16.0))).cast("int"))
              .withColumn("part", F.expr("substr(key, 1, digits)")))
    spread = stored(spread, "entries")
    amount = F.col("n_tokens") * F.col("times")
    parts = spread.groupBy("s", "epoch", "part").agg(F.sum(amount).alias("held"))
    to_here = Window.partitionBy("s", "epoch").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = parts.select(F.col("s").alias("s2"), F.col("epoch").alias("e2"), F.col("part").alias("p2"),
                         F.coalesce(F.sum("held").over(to_here), F.lit(0)).alias("before"))
    inside = Window.partitionBy("s", "epoch", "part").orderBy("key").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (spread.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
              .join(parts, F.col("s").eqNullSafe(F.col("s2")) & (F.col("epoch") == F.col("e2"))
                    & (F.col("part") == F.col("p2")))
              .withColumn("start", F.col("epoch") * F.col("tokens") + F.col("before") + F.col("inside"))
              .filter("start < quota"))
    return placed.select("doc_id", "source", "text_md5", "n_tokens", "times", "weight", "epoch", "start",
                         F.expr("start * blocks div quota").alias("block"), "key")


def mixed(docs: DataFrame, **goal) -> DataFrame:
    """The rows of ``docs`` in the mixture, as often as they are in it. What the plan decides about
    a source's documents is two values, the number of epochs before the last and the last key of that, so
    texts aren't shuffled."""
    rows = stored(narrow(docs), "narrow")
    goals = quotas(rows, **goal)
    chosen = plan(rows, goals, begun=True)
    whole = goals.filter("quota > 0").select(
        F.col("source").alias("_s"), F.expr("(quota - 1) div tokens").cast("int").alias("_full"))
    last = (chosen.groupBy("source").agg(F.max("key").alias("_last"))
            .select(F.col("source").alias("_s2"), "_last"))
    ends = stored(whole.join(last, F.col("_s").eqNullSafe(F.col("_s2")), "left")
                  .select("_s", "_full", "_last"), "ends")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d")
    told = (docs.select(own, "doc_id", "source",
                        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
            .join(ends, F.col("source").eqNullSafe(F.col("_s"))))
    more = (_key(F.col("_full")) <= F.col("_last")).cast("int")
    copies = F.col("_full") + F.coalesce(more, F.lit(0))
    return (told.withColumn("_n", copies).filter("_n > 0")
            .select("_d", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_d.*"))


def plan_sql() -> str:
    """The production mixture of ``documents`` as SQL."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH RECURSIVE narrow AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{word}')) AS BIGINT) AS n_tokens,
    count(*) AS times
  FROM documents GROUP BY ALL),
sources AS (SELECT source, CAST(sum(n_tokens * times) AS BIGINT) AS tokens FROM narrow GROUP BY source
  HAVING sum(n_tokens * times) > 0),
total AS (SELECT CAST(sum(tokens) AS BIGINT) AS t, count(*) AS n FROM sources),
shares AS (SELECT source, tokens, tokens / t AS share FROM sources, total),
bisected AS (
  SELECT 0 AS step, CAST(0 AS BIGINT) AS low, CAST({GRID} AS BIGINT) AS high
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN (low + high) // 2 ELSE low END,
    CASE WHEN ok THEN high ELSE (low + high) // 2 END
  FROM (SELECT b.step, b.low, b.high, (
      SELECT ln(sum(pow(share, ((b.low + b.high) // 2) / {GRID}))) - ((b.low + b.high) // 2) / {GRID}
        * sum(pow(share, ((b.low + b.high) // 2) / {GRID}) * ln(share))
        / sum(pow(share, ((b.low + b.high) // 2) / {GRID})) FROM shares)
      >= {ENTROPY} * ln((SELECT n FROM total)) AS ok
    FROM bisected b WHERE b.high - b.low > 1)),
tempered AS (SELECT CASE WHEN n < 2 OR (SELECT -sum(share * ln(share)) FROM shares) >= {ENTROPY} * ln(n)
    THEN 1.0 ELSE (SELECT max(low) FROM bisected) / {GRID} END AS a FROM total),
bounded AS (
  SELECT CAST(0 AS BIGINT) AS low, CAST({GRID} AS BIGINT) AS high
  UNION ALL
  SELECT CASE WHEN many THEN (low + high) // 2 ELSE low END, CASE WHEN many THEN high ELSE (low + high) // 2 END
  FROM (SELECT b.low, b.high, (
      SELECT max(pow(share, ((b.low + b.high) // 2) / {GRID}) / tokens) / sum(pow(share, ((b.low + b.high) // 2) / {GRID}))
        FROM shares) * (SELECT t FROM total) > {REPETITIONS} AS many
    FROM bounded b WHERE b.high - b.low > 1)),
chosen AS (SELECT CASE WHEN (SELECT max(pow(share, a) / tokens) / sum(pow(share, a)) FROM shares) * t > {REPETITIONS}
    THEN (SELECT min(high) FROM bounded) / {GRID} ELSE a END AS a FROM tempered, total),
goals AS (SELECT source, tokens, t,
    pow(share, a) / (SELECT sum(pow(share, a)) FROM shares, chosen) AS weight
  FROM shares, chosen, total),
quotas AS (SELECT source, tokens, round(weight, 9) AS weight, CAST(round(weight * t) AS BIGINT) AS quota,
    CAST(greatest(1, (t + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) AS BIGINT) AS blocks FROM goals),
spread AS (
  SELECT n.*, q.tokens, q.weight, q.quota, q.blocks, epoch,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_md5 || '|' || epoch) AS key
  FROM narrow n JOIN quotas q ON n.source IS NOT DISTINCT FROM q.source,
    unnest(generate_series(0, CAST(ceil(q.quota / q.tokens) AS BIGINT) - 1)) AS e(epoch)
  WHERE quota > 0),
placed AS (
  SELECT *, CAST(epoch * tokens + coalesce(sum(n_tokens * times) OVER (PARTITION BY source, epoch
    ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM spread)
SELECT doc_id, source, text_md5, n_tokens, times, weight, CAST(epoch AS INTEGER) AS epoch, start,
  CAST(start * blocks // quota AS BIGINT) AS block, key
FROM placed WHERE start < quota"""
