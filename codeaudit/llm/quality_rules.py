r"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Every word and every pair of neighbouring words (the last word paired with the end) is hashed into
``buckets`` cells. Two multinomials over the cells are counted with additive smoothing: one of all
documents, one of trusted documents. A document's score is the sum of log(trusted / all) over its
n-grams, divided by their number; it is kept if the base rules pass and the score reaches the
threshold. All of it is in-row expressions and one aggregation to ``buckets`` rows. The counts of
all documents and of trusted ones are complete; trusted are all documents whose label says quality 1
and not toxic. For their counts texts are dealt by id to where the trusted ids are; none is broadcast
and no text is sorted, however many ids there are.

Three quarters of the trusted documents give the counts; the rest, as far as they pass the base
rules, give the threshold: ``SPREADS`` standard deviations below their mean score. With fewer than
two of those it is ``THRESHOLD``. Scores are stored before the threshold is taken from them, so no
text is scored twice.

Defined cases. Null text has no words and fails the base rules. A null id is never trusted. Empty
labels: no score (null), and the base rules alone decide. Repeated rows are judged one by one.
Only the named columns are read; ``keep`` returns all columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.llm.words import computed, let, words
from codeaudit.sources.work import stored

SYMBOLS = r"[#*$%&|<>]+"
BUCKETS, SMOOTHING, SPREADS, THRESHOLD = 10_000, 1.0, 4.0, -0.5
MAX_TRUSTED: int | None = None  # no bound
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


def repeated_words(hashes: Column) -> Column:
    """How many words stand in windows of three words that occur twice or more. The windows' hashes
    are sorted with their places; equal neighbours are repeats; each repeat covers three words, less
    the overlap with the next one."""
    windows = let(hashes, lambda h: F.slice(F.transform(h, lambda x, i: F.struct(
        F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i"))),
        1, F.greatest(F.size(h) - 2, F.lit(0))))

    def places(s: Column) -> Column:
        same = F.filter(s, lambda w, k: (w["h"] == F.get(s, k + 1)["h"])
                        | (w["h"] == F.get(s, k - 1)["h"]))
        return F.sort_array(F.transform(same, lambda w: w["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(
            F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, s: a + s)
    return let(F.sort_array(windows), lambda s: let(places(s), covered))


def with_counts(docs: DataFrame, text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """``docs`` as a struct ``_d`` (columns ``only``, else all), with the base counts beside it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in (only or docs.columns)]).alias("_d")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(kept, words(F.col(text_col)).alias("_w"), lines.alias("_l"),
                      (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")))
                      .cast("bigint").alias("n_symbols"))
    out = out.select("_d", "n_symbols", F.size("_w").cast("bigint").alias("n_words"),
                     F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
                     (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint")
                     .alias("n_dup_lines"),
                     F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    out = computed(out.select("*", repeated_words(F.col("_h")).alias("n_repeat_words")))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def cells(hashes: Column, buckets: int) -> tuple[Column, Column]:
    """Cells of the words and of the pairs, from the words' hashes."""
    def cell(h: Column) -> Column:
        return F.pmod(h, F.lit(buckets)).cast("int")
    return (F.transform(hashes, lambda x: cell(x)),
            F.transform(hashes, lambda x, i: cell(F.xxhash64(x, F.get(hashes, i + 1)))))


FITTED = "pmod(xxhash64(_id, 'fit'), 4) > 0"


def trusted_ids(labels: DataFrame, most: int | None = MAX_TRUSTED) -> DataFrame:
    """The distinct ids of quality 1 and not toxic: all, unless ``most`` asks for fewer."""
    ids = (labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
                         & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    if most is not None:
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return ids.select(F.col("doc_id").alias("_id"))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame | None:
    """One row: ``_r``, the log ratio of each of the ``buckets`` cells. None without trusted
    documents."""
    hashed = (docs.select(F.col("doc_id").alias("_id"), "text")
              .join(trusted.filter(FITTED).withColumn("_t", F.lit(1)).hint("shuffle_hash"), "_id", "left")
              .select("_t", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_h")))
    one, two = cells(F.col("_h"), buckets)
    counts = stored(hashed.select(F.explode(F.concat(one, two)).alias("id"),
                                  F.col("_t").cast("bigint").alias("t"))
                    .groupBy("id").agg(F.count("*").alias("n"), F.sum("t").alias("t")), "cells")
    every = counts.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not every.t:
        return None

    def share(c: str, total: int) -> Column:
        return F.log((F.coalesce(c, F.lit(0)) + SMOOTHING) / (total + SMOOTHING * buckets))
    ratio = (docs.sparkSession.range(buckets).join(counts, "id", "left")
             .select("id", (share("t", every.t) - share("n", every.n)).alias("r")))
    table = F.transform(F.array_sort(F.collect_list(F.struct("id", "r"))), lambda x: x["r"])
    return stored(ratio.agg(table.alias("_r")), "ratios")


def with_ratio(rows: DataFrame, ratios: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``score`` from the words' hashes ``_h``: the length-normalised log-likelihood ratio, 0 for no
    words. The one row of ratios is joined to all rows (80 kB, whatever the corpus)."""
    def of(h: Column) -> Column:
        return F.get(F.col("_r"), F.pmod(h, F.lit(buckets)).cast("int"))
    hashes = F.col("_h")
    each = F.transform(hashes, lambda x, i: of(x) + of(F.xxhash64(x, F.get(hashes, i + 1))))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    score = F.when(F.size(hashes) == 0, 0.0).otherwise(total / (2 * F.size(hashes)))
    one = F.lit(1).alias("_one")
    return (rows.select("*", one).join(F.broadcast(ratios.select("_r", one)), "_one")
            .select(*rows.columns, score.alias("score")))


def threshold_of(scored: DataFrame, trusted: DataFrame) -> float:
    """``SPREADS`` standard deviations below the mean score of trusted documents that pass the base
    rules and that the ratios weren't fitted on."""
    found = scored.join(trusted.filter(f"NOT ({FITTED})"), F.col("_d.doc_id") == F.col("_id"))
    good = F.when(~F.col("base_failed"), F.col("score"))
    r = found.agg(F.avg(good).alias("mean"), F.stddev(good).alias("spread")).first()
    return THRESHOLD if r.spread is None else r.mean - SPREADS * r.spread


def judged(docs: DataFrame, labels: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``_d`` (columns ``only``, ``doc_id`` among them, else all) and the base counts, base_failed,
    score, threshold, kept of every document."""
    trusted = trusted_ids(labels)
    ratios = fit(docs, trusted)
    out = with_counts(docs, only=only)
    if ratios is None:
        return out.select("*", F.lit(None).cast("double").alias("score"),
                          F.lit(None).cast("double").alias("threshold"),
                          (~F.col("base_failed")).alias("kept")).drop("_h")
    out = stored(with_ratio(out, ratios).drop("_h"), "scored")
    least = threshold_of(out, trusted)
    out = out.withColumn("threshold", F.lit(least))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return judged(docs, labels).filter("kept").select("_d.*")
