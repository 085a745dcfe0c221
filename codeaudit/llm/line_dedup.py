r"""Line dedup on levelled sorted runs of line hashes.

A line's key is the line without blanks at its ends, A-Z lower-cased; keys of at least ``CHARS`` code
points count. ``LineRuns`` is the index: per key hash (128 bits) the number of documents seen so far
and the largest id among them, kept as runs, tables bucketed and sorted by hash in the shared folder.
A batch of documents is added in one step: its own keys, one row each, are merge-anti-joined with the
runs, which leaves out what a run has settled (enough documents, a larger id), and what is left is
written as a run of level 0. ``FAN`` runs of a level are compacted into one of the next, adding up
counts, so there are at most FAN - 1 runs a level and every entry is rewritten once per level. Runs
and batches share their buckets, so runs are read in place and only the batch is shuffled. Very
frequent lines are settled early and never written again.

``deduplicated`` feeds the documents in ``BATCHES`` parts by a hash of their id, all rows of an id in
one part, so that counts add up; then settled keys (in ``DOCUMENTS`` or more) take their lines out of
all documents but the one with the largest id. The hashes of a document's lines are made distinct in
its row, counted with map-side combination, and joined back as (hash, id) pairs, where adaptive
execution can split a frequent line; no task sees all documents of a line.

Defined cases. Null and empty texts are one empty line, whose key is too short. Rows of one id are
one document: they count once, and keep or lose the same lines. Null ids are one document, smaller
than all others. A key twice in a document counts once; its lines go or stay together. Empty tables
give empty results. Only doc_id and text are read; callers' columns, whatever their names, come back
in a struct ``_d``.
"""

from __future__ import annotations

import string
from struct import unpack

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from xxhash import xxh128_digest

from codeaudit.llm.words import computed
from codeaudit.sources.work import stored, work_dir

CHARS, DOCUMENTS = 20, 3
FAN, BATCHES, BUCKET_ROWS = 3, 6, 250_000
HASH = ["h1", "h2"]
PAIR = T.StructType([T.StructField(h, T.LongType()) for h in HASH])
LEFT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                     T.StructField("kept", T.StringType())])


def lines_and_hashes(text: bytes | None) -> tuple[list[bytes], list[tuple[int, int] | None]]:
    """The lines of a text, and of each the hash of its key; none if the key is too short."""
    lines = (text or b"").split(b"\n")
    keys = [x.strip().lower() for x in lines]  # bytes: space and U+0009-U+000D; A-Z
    return lines, [unpack("<qq", xxh128_digest(k)) if len(k) >= CHARS and (k.isascii() or len(k.decode()) >= CHARS)
                   else None for k in keys]


@F.arrow_udf(T.ArrayType(PAIR))
def hashes_in(text: pa.Array) -> pa.Array:
    """The distinct hashes of each text's lines."""
    own = [dict.fromkeys(lines_and_hashes(t.as_py())[1]) for t in text.cast(pa.large_binary())]
    return pa.array([[{"h1": h[0], "h2": h[1]} for h in hs if h] for hs in own],
                    pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())])))


@F.arrow_udf(LEFT)
def left_of(text: pa.Array, gone: pa.Array) -> pa.Array:
    """n_lines, n_dropped and the kept text, without the lines whose hashes are gone."""
    def told(text: bytes | None, gone: list[dict] | None) -> dict:
        if not gone:
            return {"n_lines": (text or b"").count(b"\n") + 1, "n_dropped": 0, "kept": (text or b"").decode()}
        lines, hashes = lines_and_hashes(text)
        dropped = {(g["h1"], g["h2"]) for g in gone}
        stay = [x for x, h in zip(lines, hashes) if h not in dropped]
        return {"n_lines": len(lines), "n_dropped": len(lines) - len(stay), "kept": b"\n".join(stay).decode()}
    rows = [told(t.as_py(), g.as_py()) for t, g in zip(text.cast(pa.large_binary()), gone)]
    return pa.array(rows, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())]))


class LineRuns:
    """The runs of one index. Rows are (h1, h2, docs, top)."""

    def __init__(self, spark: SparkSession, buckets: int, least: int = DOCUMENTS, fan: int = FAN):
        self.spark, self.buckets, self.least, self.fan = spark, buckets, least, fan
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        """A new run of ``rows`` that are partitioned by h1: one file per bucket."""
        path = work_dir(self.spark, f"run{level}")
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        (rows.write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").option("path", path)
         .saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        rows = computed(self.spark.table(names[0]))  # a union of plain bucketed scans adds up wrongly
        for n in names[1:]:
            rows = rows.unionAll(computed(self.spark.table(n)))
        return (rows.repartition(self.buckets, "h1").groupBy(*HASH)
                .agg(F.sum("docs").alias("docs"), F.max("top").alias("top")))

    def add(self, batch: DataFrame) -> None:
        """``batch``: the distinct (h1, h2, doc_id) of documents that no earlier batch held."""
        rows = batch.groupBy(*HASH).agg(F.count("*").alias("docs"), F.max("doc_id").alias("top"))
        rows = rows.repartition(self.buckets, "h1")
        for name in [n for level in self.levels for n in level]:
            run = self.spark.table(name).filter(F.col("docs") >= self.least).select(
                F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("top").alias("r_top"))
            later = F.col("top").isNull() | (F.col("r_top") >= F.col("top"))
            rows = rows.hint("merge").join(
                run, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & later, "left_anti")
        self._write(rows, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            self._drop(full)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for n in names:  # external tables: the folder goes with the work folder
            self.spark.sql(f"DROP TABLE {n}")

    def settled(self) -> DataFrame:
        """(h1, h2, docs, top) of the keys that are in enough documents."""
        names = [n for level in self.levels for n in level]
        return stored(self._merged(names).filter(F.col("docs") >= self.least), "settled")

    def close(self) -> None:
        self._drop([n for level in self.levels for n in level])
        self.levels = []


def hashes(docs: DataFrame, batches: int) -> DataFrame:
    """(h1, h2, doc_id, batch), distinct, written by batch."""
    rows = (docs.select("doc_id", F.explode(hashes_in("text")).alias("h")).select("h.h1", "h.h2", "doc_id").distinct()
            .withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")))
    path = work_dir(docs.sparkSession, "lines")
    rows.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` as a struct ``_d``, with n_lines, n_dropped and ``kept``, the text that is left."""
    spark = docs.sparkSession
    lines = hashes(docs, batches)
    index = LineRuns(spark, buckets=max(8, lines.count() // BUCKET_ROWS))
    for b in range(batches):
        index.add(lines.filter(F.col("batch") == b).drop("batch"))
    settled = index.settled()
    index.close()
    earlier = F.col("doc_id").isNull() | (F.col("doc_id") < F.col("top"))
    gone = (lines.join(settled.select(*HASH, "top"), HASH).filter(earlier)
            .groupBy("doc_id").agg(F.collect_list(F.struct(*HASH)).alias("gone")))
    gone = stored(gone.select(F.col("doc_id").alias("_id"), "gone"), "gone")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d")
    rows = docs.select(own, F.col("doc_id").alias("_k")).join(gone, F.col("_k").eqNullSafe(F.col("_id")), "left")
    return computed(rows.select("_d", left_of("_d.text", "gone").alias("_l"))).select(
        "_d", "_l.n_lines", "_l.n_dropped", "_l.kept")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("_d.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def lines_sql() -> str:
    """The digests as SQL, for documents whose ids differ."""
    return f"""WITH line AS (
  SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)),
found AS (SELECT key, max(doc_id) AS top FROM line WHERE length(key) >= {CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top > doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (top IS NULL OR top <= doc_id), '')) AS kept_sha256
FROM line LEFT JOIN found USING (key) GROUP BY doc_id"""
