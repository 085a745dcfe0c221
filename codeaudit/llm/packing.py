"""Best-fit packing of token sequences under several capacities at once.

A sequence has capacities for tokens, for documents and for attention cost (the sum of squared
lengths). Pieces are placed longest first. A bin is open for a piece if it has room in every
dimension; among the open bins the ``rule`` selects: ``"norm"`` takes the least weighted norm of
what would remain (best fit), ``"dot"`` the largest weighted dot product of the piece with what
remains. All in shares of the capacities.

Tokenising writes one narrow row per piece. Whole sequences stand alone. The others are dealt
evenly into groups of about ``GROUP`` pieces by a hash of their row number, which no frequent
source, document or repeated row can make uneven, and each group is packed on its own; a second
round packs the groups' bins that are at most half full among each other, group by group again.

Defined cases. Null text is empty and gives the end token alone. Repeated rows are packed each. A
null id stays null. A piece that exceeds a capacity on its own (documents or cost) gets a bin of its
own. Empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from codeaudit.sources.work import stored

CAPACITY, GROUP, END = 4096, 16_384, 1
WEIGHTS = (1.0, 0.05, 0.05)
CACHED, SLICE = 300_000, 1024

#: Words of these characters are what the tokenizer makes of them letter by letter: it lower-cases
#: them, composes nothing, and cuts them by the pattern below (its own, with the classes of these
#: characters written out). All others go through the tokenizer as a whole, fractions among them:
#: ``\w`` holds them, but the tokenizer cuts each off as a number.
PLAIN = re.compile("[\x21-\x7eµ-¸»¿-ſ]*")
CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|\\d|(?:[^\\w\\s]|_)+")


class WordIds:
    """Token ids of whole texts, word by word. A word's ids don't depend on its neighbours, since
    the tokenizer never joins across white space; ids of words met lately are kept, in two
    generations of ``CACHED`` words, so that frequent ones stay."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        table = {i: i for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        rest = (b for b in range(256) if b not in table)
        self.letters = table | {b: 256 + k for k, b in enumerate(rest)}  # the byte-level alphabet
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of_word(self, word: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not PLAIN.fullmatch(word) or "<|" in word:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        word, ids = word.lower(), []
        for part in (word,) if word.isascii() and word.isalpha() else CUT.findall(word):
            if not part.isascii():
                part = part.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def known(self, word: str) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            if (ids := self.old.get(word)) is None:
                ids = self.of_word(word)
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def of_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another with END after each text, and where texts end."""
        words = pc.ascii_split_whitespace(texts)
        ends = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
        coded = words.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        ids = list(map(self.known, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        n = sizes[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(upto[-1]) + np.repeat(begins[which] - upto[:-1], n)
        ends = upto[ends] if len(which) else np.zeros(len(ends), np.int64)
        return np.insert(flat[at], ends, END), ends + np.arange(1, len(ends) + 1)


_loaded: dict[str, WordIds] = {}


def _tokenise(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = WordIds(path)
        for b in batches:
            texts = b.column(1)
            for at in range(0, len(texts), SLICE):
                yield pieces(b.column(0).slice(at, SLICE), texts.slice(at, SLICE))

    def pieces(docs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, ends = _loaded[path].of_batch(pc.fill_null(texts, ""))
        begin, out = 0, [[] for _ in range(5)]
        for k, end in enumerate(ends.tolist()):
            for piece, at in enumerate(range(begin, end, capacity)):
                own = ids[at:min(at + capacity, end)]
                for c, v in zip(out, (k, piece, at - begin, len(own), zlib.crc32(own.tobytes()))):
                    c.append(v)
            begin = end
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [docs.take(pa.array(out[0], pa.int64())),
             *(pa.array(c, t) for c, t in zip(out[1:], kinds))],
            ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _tokenise(path, capacity),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, capacities: np.ndarray, weights: np.ndarray,
             rule: str = "norm") -> np.ndarray:
    """Bin of each row of ``sizes`` (one column per dimension), rows taken in order."""
    need = sizes / capacities
    smallest = np.minimum.accumulate(need[::-1, 0])[::-1]
    bins = np.zeros(len(need), np.int64)
    left, names, used, made = np.empty((256, need.shape[1])), np.empty(256, np.int64), 0, 0
    for i, want in enumerate(need):
        room = left[:used] - want
        fits = np.flatnonzero(room.min(axis=1) >= -1e-12) if used else ()
        if len(fits):
            room = room[fits]
            if rule == "norm":
                best = fits[np.argmin((room * room) @ weights)]
            else:
                best = fits[np.argmax((left[fits] * want) @ weights)]
        else:
            if used == len(left):
                left = np.concatenate((left, np.empty_like(left)))
                names = np.concatenate((names, np.empty_like(names)))
            best = used
            left[used], names[used] = 1.0, made
            used, made = used + 1, made + 1
        left[best] -= want
        bins[i] = names[best]
        if i + 1 < len(need) and left[best, 0] < smallest[i + 1] - 1e-12:
            used -= 1  # nothing to come fits any more
            left[best], names[best] = left[used], names[used]
    return bins


def _pack(capacities: tuple, weights: tuple, rule: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """(g, row, tokens, documents, cost) to (row, bin, place)."""
        group = group.sort_values(["tokens", "row"], ascending=[False, True], kind="stable")
        sizes = group[["tokens", "documents", "cost"]].to_numpy(np.float64)
        bins = best_fit(sizes, np.array(capacities, np.float64), np.array(weights), rule)
        place = group.tokens.groupby(bins).cumsum() - group.tokens
        return pd.DataFrame({"row": group.row, "bin": (np.int64(group.g.iloc[0]) << 32) + bins,
                             "place": place})
    return run


def _in_groups(rows: DataFrame, per_group: int, *how) -> DataFrame:
    groups = max(1, -(-rows.count() // per_group))
    return (rows.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
            .groupBy("g").applyInPandas(_pack(*how), "row bigint, bin bigint, place bigint"))


def packed(pieces: DataFrame, capacity: int = CAPACITY, most_documents: int | None = None,
           most_cost: float | None = None, weights: tuple = WEIGHTS, rule: str = "norm",
           per_group: int = GROUP) -> DataFrame:
    """``pieces`` (with ``length``) with sequence_id and offset. Without a limit of its own, a
    sequence may hold as many documents as tokens, at the cost of one document of that length."""
    how = ((capacity, most_documents or capacity, most_cost or float(capacity) ** 2), weights, rule)
    pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    length = F.col("length")
    single = pieces.filter(length >= capacity)
    loose = pieces.filter(length < capacity).select(
        F.col("_row").alias("row"), length.alias("tokens"), F.lit(1).cast("bigint").alias("documents"),
        (length * length).alias("cost"))
    first = stored(_in_groups(loose, per_group, *how), "first-round")
    filled = (first.join(loose, "row").groupBy("bin")
              .agg(*[F.sum(c).alias(c) for c in ("tokens", "documents", "cost")]))
    half = stored(filled.filter(2 * F.col("tokens") <= capacity).withColumnRenamed("bin", "row"),
                  "half-full")
    second = _in_groups(half, per_group, *how).select(
        F.col("row").alias("bin"), F.col("bin").alias("_bin"), F.col("place").alias("_place"))
    placed = first.join(second, "bin", "left").select(
        F.col("row").alias("_row"),
        F.when(F.col("_bin").isNull(), 4 * F.col("bin")).otherwise(4 * F.col("_bin") + 1)
        .alias("sequence_id"),
        (F.col("place") + F.coalesce("_place", F.lit(0))).alias("offset"))
    out = pieces.join(placed, "_row").unionByName(single.select(
        "*", (4 * F.col("_row") + 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    return out.drop("_row")
