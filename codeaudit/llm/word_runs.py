r"""Periodic runs of words, by an online sparse dynamic programme over diagonals.

Word i on diagonal (lag) d equals word i - d. The words are read once, left to right; an earlier
occurrence of a word names a lag, the match length of that lag's diagonal grows by one, and a
diagonal that isn't continued ends and at once emits its run, if long enough.

Not every earlier occurrence can belong to a run. A run is four periods long at least, so its
diagonal matches 3 * d words in a row, and what is asked for a lag in (k / 2, k] is that not only
the word at i but the k words from there on stood at i - d. Of these occurrences only the nearest
counts: one at a smaller lag inside the same run would give the run a smaller period. So for k = 1,
2, 4, ... each word has one earlier occurrence to look up, under the rank of its k words, and a
sequence of c words whose occurrences lie at the same lag d is a diagonal of c + k - 1 matches: a
run of c + k - 1 + d words whose smallest period is d. Ranks of 2 * k words are pairs of ranks, and
words whose k words are not found twice drop out of all later rounds, in plain prose nearly all of
them by k = 4. Time is at most words * log(words), also for one word repeated a million times,
memory some 200 bytes a word of the longest text in a batch.

Defined cases. Null, empty and blank texts have no words and no runs. Texts are told apart by row,
so repeated rows and null ids give a result each. Runs may overlap; each is reported. Empty tables
give empty results. Only the columns named are read, and ``collapsed`` returns the caller's columns
inside a struct, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codeaudit.llm.words import computed, crc32_sql, let, words

LEAST, TIMES = 6, 4  # a run has this many words, and this many periods, at least
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                      T.StructField("kept", T.StringType())])


def runs(tokens: list) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start, then period."""
    found: list[tuple[int, int, int]] = []
    names: dict = {}
    rank = [names.setdefault(t, len(names)) for t in tokens]
    at: list[int] | range = range(len(tokens))
    k = 1
    while len(tokens) >= max(LEAST, TIMES * (k // 2 + 1)) and at:
        low, seen, lag, first, before = k // 2, {}, 0, 0, -1

        def end() -> None:
            length = before - first + k + lag
            if length >= max(LEAST, TIMES * lag):
                found.append((first - lag, length, lag))

        for i, r in zip(at, rank):
            d = i - seen.get(r, i)
            seen[r] = i
            if d != lag or i != before + 1:
                if lag:
                    end()
                lag, first = (d if low < d <= k else 0), i
            before = i
        if lag:
            end()
        times = Counter(rank)
        held = {i: r for i, r in zip(at, rank) if times[r] > 1}
        names, at, rank = {}, [], []
        for i, r in held.items():
            s = held.get(i + k)
            if s is not None:
                at.append(i)
                rank.append(names.setdefault((r, s), len(names)))
        k *= 2
    return sorted(found)


def without_repeats(tokens: list, found: list[tuple[int, int, int]]) -> list:
    """The words but those after the first period of a run."""
    out, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in found):
        if end > at:
            out += tokens[at:max(at, start)]
            at = end
    return out + tokens[at:]


@F.arrow_udf(FOUND)
def found_in(text: pa.Array) -> pa.Array:
    """n_words, runs and the collapsed text of each text."""
    def told(t: bytes | None) -> dict:
        tokens = (t or b"").split()  # bytes: space and U+0009-U+000D
        own = runs(tokens)
        return {"n_words": len(tokens), "runs": [{"start": s, "length": n, "period": p} for s, n, p in own],
                "kept": b" ".join(without_repeats(tokens, own)).decode()}
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run)), ("kept", pa.string())])
    return pa.array([told(t.as_py()) for t in text.cast(pa.large_binary())], kind)


def collapsed(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """``docs`` as a struct ``_d``, with n_words, runs (by start, then period) and ``kept``, the text
    with one period left of each run."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d")
    text = F.col(text) if isinstance(text, str) else text
    rows = computed(docs.select(own, text.alias("_t")))
    return computed(rows.select("_d", found_in("_t").alias("_f"))).select(
        "_d", "_f.n_words", "_f.runs", "_f.kept")


def damaged() -> Column:
    """The text of ``documents``, periodic from some word on in a tenth of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def periodic(w: Column) -> Column:
        n, g = F.size(w), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (g % 8 + 3))
        return F.when(n > 0, let(F.struct(w.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p")), lambda v: F.array_join(
            F.transform(F.sequence(F.lit(0), F.size(v["w"]) - 1), lambda i: F.get(v["w"], F.when(
                i < v["a"], i).otherwise(v["a"] + (i - v["a"]) % v["p"]))), " ")))
    return F.when(h % 10 == 0, let(words(F.col("text")), periodic)).otherwise(F.col("text"))


def digests(rows: DataFrame) -> DataFrame:
    """What is asked of each document: the number of runs, the one with the greatest exponent, and
    hashes of the runs and of the collapsed text."""
    better = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    none = F.lit(None).cast(RUN)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("best", F.aggregate("runs", none, better)).select(
        "_d.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


def runs_sql() -> str:
    """The digests as SQL, for documents whose ids differ."""
    return r"""WITH crc AS (SELECT doc_id, CRC AS h FROM documents WHERE doc_id IS NOT NULL),
split AS (
  SELECT d.doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, h
  FROM documents d LEFT JOIN crc c ON c.doc_id = d.doc_id),
sized AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
turned AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
word AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word
  FROM turned, unnest(range(n)) AS r(i)),
pair AS (
  SELECT x.doc_id, x.i, x.i - y.i AS lag FROM word x JOIN word y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
diagonal AS (
  SELECT doc_id, lag, min(i) - lag AS start, count(*) + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS place FROM pair)
  GROUP BY doc_id, lag, place HAVING count(*) + lag >= greatest(6, 4 * lag)),
run AS (SELECT doc_id, start, length, min(lag) AS period FROM diagonal GROUP BY ALL),
told AS (
  SELECT doc_id, count(*) AS n_runs,
    arg_min({'start': start, 'length': length, 'period': period}, {'r': -length / period, 's': start, 'p': period}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM run, unnest(range(start + period, start + length)) AS r(i)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start,
  CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""".replace("CRC", crc32_sql("CAST(doc_id AS VARCHAR)"))
