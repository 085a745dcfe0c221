"""Repeated passages: byte strings of ``WIDTH`` that start more than once, by suffix arrays.

The longest previous factor of a position is the longest string that starts there and also earlier.
In suffix order it is the longer common prefix with the nearest neighbour above and the nearest one
below that start earlier in the text: the previous and next smaller positions. ``keep="first"``
removes what positions with a previous factor of at least ``WIDTH`` cover, so the first copy stays;
``keep="none"`` also takes next factors (the same with positions in reverse), so no copy stays.

One suffix array can't hold a corpus, so windows of ``WIDTH`` bytes that could be equal are first
brought together. Each window names an anchor: of its ``GRAM``-byte strings the one with the
smallest hash, leftmost on ties. Equal windows have equal anchors. Neighbouring windows mostly share
one, about every 85 bytes it changes; such a run of windows with the bytes under them is a context.

1. Contexts are counted by anchor. An anchor seen once can't hold a repeat.
2. Anchors whose contexts are all equal (128 bits of hash) are settled by the counts alone. This is
   what copies of whole documents come down to, thousands of them as well as two.
3. Of the other anchors one representative per distinct context sends its bytes. Blocks of whole
   anchors are suffix-sorted by prefix doubling, and previous or next factors decide each window.
4. An anchor with over ``HOT`` distinct contexts would make a block too large (over some 6 MB, whose
   suffix array takes 350 MB); for its windows a count by hash of the whole window decides, which
   combines before the shuffle.

Defined cases. Null and empty texts, and those below ``WIDTH`` bytes, lose nothing. With
``keep="first"`` the order of documents is doc_id (nulls first), then a hash of the text, and rows
equal in both count as one document (all keep or lose the same); with ``keep="none"`` they are
copies of each other. Empty tables give empty results. Texts of any length are worked on in pieces
of 1 MB. Columns beyond doc_id and text are ignored by ``digests`` and returned by ``without``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from codeaudit.sources.work import stored

WIDTH, GRAM, HOT = 200, 32, 16_384
PIECE, BLOCK = 1 << 20, 1 << 20
WINDOW = WIDTH - GRAM + 1
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240817))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 62)) | 5
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + WIDTH + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, _U), np.full(size - 1, b, _U))), dtype=_U)
                      for b in (_U(_BASE), _U(inverse))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15 ^ (salt << 1))
    return h ^ (h >> _U(29))


class Hashes:
    """Hashes of all substrings of some bytes, in constant time each."""

    def __init__(self, x: np.ndarray):
        self.power, self.inverse = _powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, _U)
        np.cumsum(_TABLE[x] * self.power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self) -> np.ndarray:
        n = len(self.sums) - GRAM
        return _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[:n], 0)


def contexts(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of documents that lie one after another in x and end at ``ends``: number of the
    document, first and last window start in x, anchor, digest."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    if len(x) < WIDTH:
        return none
    hashes = Hashes(x)
    grams = hashes.grams()
    low = _U((1 << 21) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=_U)
    wide = np.full(-(-len(key) // WINDOW) * WINDOW, ~_U(0), _U)
    wide[:len(key)] = key
    wide = wide.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    back = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - WIDTH + 1
    owner = (np.minimum(back[:n], ahead[WINDOW - 1:WINDOW - 1 + n]) & low).astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    valid = np.zeros(n + 1, np.int32)
    has = ends - begins >= WIDTH
    np.add.at(valid, begins[has], 1)
    np.add.at(valid, ends[has] - WIDTH + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    new = valid.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    hi = np.flatnonzero(last)
    at = owner[lo]
    shape = ((at - lo).astype(_U) << _U(32)) | (hi - lo).astype(_U)
    digest = _mix(hashes.of(lo, hi + WIDTH) ^ _mix(shape, 3), 7)
    return np.searchsorted(ends, lo, "right"), lo, hi, grams[at], digest


def _pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """Runs of documents of about PIECE bytes: (first document, where they begin in data, ends
    within the piece, where the piece begins in its only document). Longer documents go in several
    pieces that overlap by a window, so that each window start belongs to one."""
    first, begin = 0, 0
    while first < len(ends):
        upto = max(int(np.searchsorted(ends, begin + PIECE, "right")), first + 1)
        size = int(ends[upto - 1]) - begin
        if size <= PIECE:
            yield first, begin, ends[first:upto] - begin, 0
        else:
            for at in range(0, size, PIECE - WIDTH):
                stop = min(size, at + PIECE - 1)
                if stop - at >= WIDTH or not at:
                    yield first, begin + at, np.array([stop - at]), at
        first, begin = upto, int(ends[upto - 1])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts one after another, and where each text ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    x = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return x[offsets[0]:offsets[-1]], (offsets[1:] - offsets[0])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc, text) to a row per context."""
    for b in batches:
        data, ends = _bytes_of(b.column(2))
        for first, begin, stops, shift in _pieces(data, ends):
            which, lo, hi, anchor, digest = contexts(data[begin:begin + int(stops[-1])], stops)
            rel = np.concatenate(([0], stops[:-1]))[which] - shift
            which = pa.array(which + first)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(which), b.column(1).take(which), pa.array((lo - rel).astype(np.int32)),
                 pa.array((hi - rel).astype(np.int32)), pa.array(anchor.view(np.int64)),
                 pa.array(digest.view(np.int64))], ["id", "doc", "lo", "hi", "anchor", "digest"])


CONTEXT = "id bigint, doc bigint, lo int, hi int, anchor bigint, digest bigint"


def _ranks(x: np.ndarray) -> dict[int, np.ndarray]:
    """Rank of the string of 8, 16, ... 128 bytes at each position, by prefix doubling; the bytes
    must be followed by 2 * 128 bytes of padding."""
    word = np.lib.stride_tricks.sliding_window_view(x, 8)
    word = np.ascontiguousarray(word).view(">u8").ravel().astype(_U)
    ranks, size = {8: np.unique(word, return_inverse=True)[1].astype(np.int32)}, 8
    while size < 128:
        r = ranks[size]
        pair = r[:-size].astype(np.int64) * (len(r) + 1) + r[size:]
        ranks[2 * size] = np.unique(pair, return_inverse=True)[1].astype(np.int32)
        size *= 2
    return ranks


def _common(ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix in steps of 8, up to 248; 0 where b is negative."""
    some = np.flatnonzero(b >= 0)
    length, a, b = np.zeros(len(a), np.int64), a[some], b[some]
    got = np.zeros(len(some), np.int64)
    for size in (128, 64, 32, 16, 8):
        got += size * (ranks[size][a + got] == ranks[size][b + got])
    length[some] = got
    return length


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, or -1; all indices jump at once."""
    found = np.arange(len(values)) - 1
    todo = np.flatnonzero(found >= 0)
    while len(todo):
        todo = todo[values[found[todo]] > values[todo]]
        found[todo] = found[found[todo]]
        todo = todo[found[todo] >= 0]
    return found


def previous_factors(ranks: dict[int, np.ndarray], starts: np.ndarray,
                     time: np.ndarray) -> np.ndarray:
    """For each of ``starts`` the longest factor that also starts at one with a smaller ``time``:
    the longer common prefix with the previous and the next smaller time in suffix order."""
    order = np.lexsort((time, ranks[8][starts + 192], ranks[64][starts + 128], ranks[128][starts]))
    p, t = starts[order], time[order]
    before = _smaller_before(t)
    after = len(t) - 1 - _smaller_before(t[::-1])[::-1]
    after[after == len(t)] = -1
    at = lambda i: np.where(i >= 0, p[i], -1)
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(_common(ranks, p, at(before)), _common(ranks, p, at(after)))
    return out


def repeats(texts: list[bytes], owned: list[int], time: np.ndarray, both: bool) -> list[np.ndarray]:
    """Contexts and how many window starts each has to those of them that are repeated; ``time``
    orders all starts, context after context."""
    x = np.frombuffer(b"".join(texts) + bytes(2 * 256), np.uint8)
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    starts = np.concatenate([np.arange(b, b + n) for b, n in zip(begins, owned)])
    ranks = _ranks(x)
    hit = previous_factors(ranks, starts, time) >= WIDTH
    if both:
        hit |= previous_factors(ranks, starts, -time) >= WIDTH
    return [np.flatnonzero(h) for h in np.split(hit, np.cumsum(owned)[:-1])]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive integers."""
    cut = np.flatnonzero(np.diff(values) != 1)
    return values[np.concatenate(([0], cut + 1))], values[np.concatenate((cut, [len(values) - 1]))]


def _decide(both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, id, doc, lo, hi, bytes) sorted by anchor, id, doc, lo: repeated window starts."""
        rows: list[tuple] = []

        def decide(rows: list[tuple]) -> pa.RecordBatch:
            owned = [r[4] - r[3] + 1 for r in rows]
            by = sorted(range(len(rows)), key=lambda i: (rows[i][1] is not None, rows[i][1] or 0,
                                                        rows[i][2], rows[i][3]))
            first = np.zeros(len(rows), np.int64)
            first[by] = np.concatenate(([0], np.cumsum([owned[i] for i in by])[:-1]))
            time = np.concatenate([np.arange(f, f + n) for f, n in zip(first, owned)])
            out: list[list] = [[], [], []]
            for r, hit in zip(rows, repeats([r[5] for r in rows], owned, time, both)):
                if len(hit):
                    lo, hi = _runs(hit + r[3])
                    out[0] += [r[2]] * len(lo)
                    out[1] += lo.tolist()
                    out[2] += hi.tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                 pa.array(out[2], pa.int32())], ["doc", "lo", "hi"])

        size = 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BLOCK and r[0] != rows[-1][0]:
                    yield decide(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
        if rows:
            yield decide(rows)
    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, doc, text, todo: list of anchor, lo, hi, hot): bytes of each context, and for hot ones
    the hash of each window."""
    for b in batches:
        ids, docs, todo = (b.column(i).to_pylist() for i in (0, 1, 3))
        out: list[list] = [[] for _ in range(7)]
        size = 0
        for k, (i, d, parts) in enumerate(zip(ids, docs, todo)):
            text = b.column(2)[k].cast(pa.large_binary()).as_py()
            for p in parts:
                part, owned = text[p["lo"]:p["hi"] + WIDTH], p["hi"] - p["lo"] + 1
                wins = None
                if p["hot"]:
                    at = np.arange(owned)
                    wins = _mix(Hashes(np.frombuffer(part, np.uint8)).of(at, at + WIDTH), 11)
                    wins = wins.view(np.int64).tolist()
                for c, v in zip(out, (p["anchor"], i, d, p["lo"], p["hi"],
                                      None if p["hot"] else part, wins)):
                    c.append(v)
                size += len(part) * (9 if p["hot"] else 1)
            if size > 8 * BLOCK:
                yield _cut_batch(out)
                out, size = [[] for _ in range(7)], 0
        yield _cut_batch(out)


CUT = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("doc", pa.int64()), ("lo", pa.int32()),
                 ("hi", pa.int32()), ("bytes", pa.binary()), ("wins", pa.list_(pa.int64()))])


def _cut_batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CUT)],
                                      schema=CUT)


def _doc() -> Column:
    """A document's key: a hash of its id and text."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.col("doc_id").isNull())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), _doc().alias("doc"), "text")


def repeated_starts(docs: DataFrame, keep: str) -> DataFrame:
    """(doc, lo, hi): starts of windows that are removed. A row may come more than once."""
    if keep not in ("first", "none"):
        raise ValueError(f"keep is first or none, not {keep!r}")
    texts = _texts(docs).filter(F.length("text") >= WIDTH // 4)
    found = texts.mapInArrow(_find, CONTEXT)
    place = F.struct("id", "doc", "lo", "hi")
    # written, so that the join's large side stands on its own shuffle and can be split
    seen = stored(found.groupBy("anchor")
            .agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"),
                 *([F.min(place).alias("first")] if keep == "first" else []))
            .filter("n > 1"), "repeated-anchors")
    hits = stored(found.join(seen.drop("n").withColumnRenamed("anchor", "k"), F.col("anchor") == F.col("k"))
                  .select("id", "doc", "lo", "hi", "anchor", "digest", (F.col("a") == F.col("b"))
                          .alias("same"), *(["first"] if keep == "first" else [])), "hits")
    marks = ["doc", "lo", "hi"]
    later = ((F.col("doc") != F.col("first.doc")) | (F.col("lo") != F.col("first.lo"))
             if keep == "first" else F.lit(True))
    settled = hits.filter("same").filter(later).select(*marks)
    mixed = hits.filter("not same")
    reps = stored(mixed.groupBy("anchor", "digest")
                  .agg(F.count("*").alias("n"), F.min(place).alias("first")), "representatives")
    equal = (mixed.drop("first").join(reps.filter("n > 1"), ["anchor", "digest"])
             .filter(later).select(*marks))
    hot = (reps.groupBy("anchor").agg(F.count("*").alias("m")).filter(F.col("m") > HOT)
           .select("anchor", F.lit(True).alias("hot")))
    todo = (reps.join(hot, "anchor", "left")
            .groupBy(F.col("first.doc").alias("doc"))
            .agg(F.collect_set(F.struct("anchor", F.col("first.lo").alias("lo"),
                                        F.col("first.hi").alias("hi"),
                                        F.coalesce("hot", F.lit(False)).alias("hot"))).alias("todo")))
    cut = stored(texts.join(todo, "doc").select("id", "doc", "text", "todo")
                 .mapInArrow(_cut_out, "anchor bigint, id bigint, doc bigint, lo int, hi int, "
                                       "bytes binary, wins array<bigint>"), "cut")
    decided = (cut.filter("bytes is not null").drop("wins").dropDuplicates(["anchor", "doc", "lo"])
               .repartition("anchor").sortWithinPartitions("anchor", "doc", "lo")
               .mapInArrow(_decide(keep == "none"), "doc bigint, lo int, hi int"))
    wins = (cut.filter("wins is not null").dropDuplicates(["anchor", "doc", "lo"])
            .select("anchor", "id", "doc", "lo", F.posexplode("wins").alias("i", "win"))
            .select("anchor", "win", "id", "doc", (F.col("lo") + F.col("i")).alias("lo")))
    where = F.struct("id", "doc", "lo")
    counted = wins.groupBy("anchor", "win").agg(F.count("*").alias("n"),
                                                F.min(where).alias("first")).filter("n > 1")
    frequent = (wins.join(counted, ["anchor", "win"]).filter(later)
                .select("doc", "lo", F.col("lo").alias("hi")))
    return settled.unionByName(equal).unionByName(decided).unionByName(frequent)


def spans(docs: DataFrame, keep: str) -> DataFrame:
    """(doc, spans): sorted runs of window starts of each document that loses something, those that
    touch or overlap once their ``WIDTH`` bytes are covered joined in the row."""
    return (repeated_starts(docs, keep).distinct().groupBy("doc")
            .agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")))


def _rest(text: bytes, parts: list[dict]) -> tuple[bytes, int, int]:
    """What is left, how many bytes were removed, in how many maximal runs."""
    out, removed, runs, end = [], 0, 0, -1
    for p in parts:
        lo, hi = p["lo"], p["hi"] + WIDTH
        if lo > end:
            out.append(text[max(end, 0):lo])
            runs += 1
            removed += hi - lo
            end = hi
        elif hi > end:
            removed += hi - end
            end = hi
    out.append(text[max(end, 0):])
    return b"".join(out), removed, runs


DIGEST = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                       T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


@F.arrow_udf(DIGEST)
def _digest(text: pa.Array, parts: pa.Array) -> pa.Array:
    rows = []
    for t, p in zip(text.cast(pa.large_binary()), parts.to_pylist()):
        t = t.as_py() or b""
        kept, removed, runs = _rest(t, p or [])
        rows.append((len(t), removed, runs, hashlib.sha256(kept).hexdigest()))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows) if rows else [()] * 4
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


@F.arrow_udf(T.StringType())
def _cut_text(text: pa.Array, parts: pa.Array) -> pa.Array:
    """Characters that are cut through go as a whole."""
    return pa.array([None if t.as_py() is None else
                     _rest(t.as_py(), p or [])[0].decode("utf-8", "ignore")
                     for t, p in zip(text.cast(pa.large_binary()), parts.to_pylist())], pa.string())


def digests(docs: DataFrame, keep: str = "none") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return (_texts(docs).join(spans(docs, keep), "doc", "left")
            .select(F.col("id").alias("doc_id"), _digest("text", "spans").alias("_r"))
            .select("doc_id", "_r.*"))


def without(docs: DataFrame, keep: str = "first") -> DataFrame:
    """``docs`` without the repeated passages. Documents of which nothing is left go; ``n_chars``,
    where there is one, is counted anew."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d")
    rows = docs.select(own, _doc().alias("_key")).join(
        spans(docs, keep).select(F.col("doc").alias("_key"), "spans"), "_key", "left")
    text, cut = F.col("_d.text"), F.col("spans").isNotNull()
    rows = rows.select("_d", "spans", F.when(cut, _cut_text(text, "spans")).otherwise(text).alias("_new"))
    rows = rows.filter(~cut | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    anew = F.when(cut, F.length("_new").cast("bigint"))
    return rows.select(*[F.col("_new").alias(c) if c == "text" else
                         F.coalesce(anew, F.col("_d.n_chars")).alias(c) if c == "n_chars" else
                         F.col(f"_d.`{c}`").alias(c) for c in docs.columns])
