r"""SimHash near-duplicates: all pairs of fingerprints at ``RADIUS`` or fewer bits, by bit planes.

Fingerprints are collapsed first, so that exact copies cost one row. Of the four 16-bit blocks of
two fingerprints at three bits or fewer one is equal, and of the four 12-bit parts of the other 48
bits again one; 16 keys per distinct fingerprint therefore miss nothing. Within a key the members'
bits stand in 64 vertical planes, so one 64-bit word holds one bit of 64 members. For each shift s
member i is compared with member i+s for all i at once: planes are XORed with the shifted planes and
added up by carry-save counters (ones, twos, and a sticky "four or more"); words in which all pairs
have gone beyond the radius are abandoned after every eight planes. A key with more than ``TILE``
members is cut into tiles, and every pair of tiles is a task of its own. Of the links found, each
task emits a spanning forest; the components of these links are the near-duplicate classes.

Defined cases. Null and empty texts have fingerprint 0 and are linked like any other. Fewer than
three words make one shingle. A null id never names a class unless all its ids are null. Repeated
rows fall into one class. Empty tables give empty results. Only ``doc_id`` and ``text`` are read;
``keep_one`` returns all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from codeaudit.llm.components import components
from codeaudit.sources.work import stored

RADIUS, SEED, SHINGLE = 3, 42, 3
TILE, BATCH = 2048, 65_536


def fingerprint(text: bytes) -> int:
    """64 majority bits over the XXH64 of all shingles (repeats count)."""
    words = text.lower().split()  # bytes: A-Z; space and U+0009-U+000D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BATCH):
        h = np.array([digest(joined[a:b], SEED)
                      for a, b in zip(starts[at:at + BATCH], ends[at:at + BATCH])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_of(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t or b"") for t in text.cast(pa.large_binary()).to_pylist()],
                    pa.int64())


def _planes(fps: np.ndarray, words: int) -> np.ndarray:
    """(64, words): bit i of plane b is bit b of member i."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out = np.zeros((64, words * 8), np.uint8)
    out[:, :packed.shape[1]] = packed
    return out.view("<u8")


def _close(planes: np.ndarray, shift: int, same: np.ndarray) -> np.ndarray:
    """Members i whose distance to member i + shift is within the radius; ``same``: i may pair."""
    words = planes.shape[1] - 1 - shift // 64
    allowed = np.zeros(words * 8, np.uint8)
    packed = np.packbits(same, bitorder="little")
    allowed[:len(packed)] = packed
    allowed = allowed.view("<u8")
    alive = np.flatnonzero(allowed)
    q, r = divmod(shift, 64)
    ones = np.zeros(len(alive), np.uint64)
    twos, over = ones.copy(), ~allowed[alive]
    for first in range(0, 64, 8):
        a, b = planes[first:first + 8, alive], planes[first:first + 8, alive + q]
        if r:
            b = (b >> np.uint64(r)) | (planes[first:first + 8, alive + q + 1] << np.uint64(64 - r))
        for d in a ^ b:
            carry = ones & d
            ones ^= d
            over |= twos & carry
            twos ^= carry
        going = over != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not going.all():
            alive, ones, twos, over = alive[going], ones[going], twos[going], over[going]
            if not len(alive):
                return alive
    word, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1,
                                         bitorder="little"))
    return alive[word] * 64 + bit


def forest(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among members of equal keys (sorted together)."""
    n = len(keys)
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(cut, n))
    by_size = np.argsort(-size, kind="stable")  # large keys first: later shifts see a shorter list
    size, cut = size[by_size], cut[by_size]
    order = np.repeat(cut - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(n)
    fps, until = np.ascontiguousarray(fps[order]), np.repeat(np.cumsum(size), size)
    parent, at = np.arange(n), np.arange(n)
    for shift in range(1, int(size[0]) if n else 0):
        m = int(size[size > shift].sum())
        if shift == 1 or m < 0.7 * held:
            held, planes = m, _planes(fps[:m], m // 64 + 2 + int(size[0]) // 64)
        near = _close(planes, shift, at[:m] + shift < until[:m])
        near = near[parent[near] != parent[near + shift]]
        for i, j in zip(near.tolist(), (near + shift).tolist()):
            while parent[i] != i:
                i = parent[i]
            while parent[j] != j:
                j = parent[j]
            parent[max(i, j)] = min(i, j)
        while len(near) and (parent[parent] != parent).any():
            parent = parent[parent]
    child = np.flatnonzero(parent != at)
    return fps[child], fps[parent[child]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key: links, for runs of whole keys of about BATCH rows."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        u, v = forest(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        kept.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(k) for k, _ in kept) < BATCH:
            continue
        keys, fps = (np.concatenate(x) for x in zip(*kept))
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        kept = [(keys[cut:], fps[cut:])]
        if cut:
            yield out(keys[:cut], fps[:cut])
    if kept:
        yield out(*(np.concatenate(x) for x in zip(*kept)))


def links(fps: DataFrame) -> DataFrame:
    """(u, v) of distinct ``fp``s that link: enough of them to span every class."""
    turned = [F.when(F.lit(i == 0), F.col("fp")).otherwise(
        F.shiftleft("fp", 16 * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * i)))
        for i in range(4)]
    keys = [F.shiftrightunsigned(t, 48) * (1 << 12) + F.shiftrightunsigned(t, 12 * j) % (1 << 12)
            + ((4 * i + j) << 28) for i, t in enumerate(turned) for j in range(4)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = (keyed.groupBy("key").count().filter(F.col("count") > TILE)
           .select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    other = F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("tiles") - 1, F.lit(0))),
        lambda x: F.struct(F.least(x, F.col("tile")).alias("a"), F.greatest(x, F.col("tile")).alias("b"))))
    spread = (keyed.join(hot, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
              .withColumn("tile", tile.cast("int"))
              .select("key", "fp", other.alias("pair"))
              .select(F.when((F.col("pair.a") == 0) & (F.col("pair.b") == 0), F.col("key"))
                      .otherwise(F.xxhash64("key", "pair.a", "pair.b")).alias("key"), "fp"))
    return (spread.repartition("key").sortWithinPartitions("key")
            .mapInArrow(_link, "u bigint, v bigint"))


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``prints`` (doc_id, fp): the class
    itself, named by one of its fingerprints, and its smallest id."""
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fps")
    roots = components(links(fps)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = fps.join(roots, "fp", "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = stored(docs.select("doc_id", fingerprint_of("text").alias("fp")), "prints")
    return prints.join(classes(prints), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class the document with the smallest id (then the smallest hash of its text)."""
    texts = [F.xxhash64("text").alias("h1"), F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("h2")]
    prints = stored(docs.select("doc_id", *texts, fingerprint_of("text").alias("fp")), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2"))
    firsts = (prints.join(classes(prints).select("fp", "root"), "fp").groupBy("root")
              .agg(first.alias("first")).select("first.h1", "first.h2"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d")
    return (docs.select(own, *texts).join(firsts, ["h1", "h2"], "left_semi")
            .dropDuplicates(["h1", "h2"]).select("_d.*"))  # stays where the join has put it
