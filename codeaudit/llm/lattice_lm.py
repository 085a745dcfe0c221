r"""Language-model scores: the marginal probability of a text over all its segmentations.

The units are the pieces of an existing subword vocabulary, and its 256 bytes, so that every text
has a segmentation. A word is written with its leading blank as part of the first piece, so lattices
of words can be summed on their own and added up. For a word, ``forward[e]`` is the log-sum over all
pieces ending at e of ``forward[start] + log p(piece)``; its last entry is the word's marginal log
probability over all segmentations. The vocabulary's own scores (ranks, taken as a Zipf law) weight
the pieces at first; expected counts over the training words (forward and backward) then replace
them, ``ROUNDS`` times. That gives ``lattice_score``. For ``score`` the lattice of a word seen in training
has one more arc, over the whole word, with the word's share of the training tokens; the arcs of the
pieces share 1 - weight, the weight being fitted so that words predict themselves with one occurrence
left out. Both are distributions over all texts. A text's probability is the product over its words
and the end.

Words are scored once each, not once per occurrence: all words of all documents are counted, the
distinct ones go through the lattice, thousands of equal length at a time. The ``FREQUENT`` most
frequent words (a bounded table) are looked up where a document is read; of a document's other words
hash and number are joined to the scored words and summed by document.

Defined cases. Null and empty texts have the end only. A null id counts as the empty text when the
held-out fold is taken. Repeated rows are documents each. Empty tables give empty results; without
training documents pieces keep the vocabulary's weights. Bytes and words of any length are allowed.
Words are told apart by 64 bits of hash when joined. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codeaudit.sources.work import stored

FOLDS, HELD_OUT = 5, 1
ROUNDS, FREQUENT, CHUNK = 2, 32_768, 4096
END = b""
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = _U(int(_rng.integers(1, 1 << 62)) | 1)


def held_out() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == HELD_OUT


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces that a lower-cased word with its leading blank can hold, and their log weights."""
    model = sentencepiece.SentencePieceProcessor(
        model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    ranks: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece == piece.lower() and b" " not in piece[1:]:
            ranks[piece] = 1 - model.get_score(i)
    last = max(ranks.values(), default=1.0)
    for b in range(256):
        ranks.setdefault(bytes([b]), last + 1)
    pieces = sorted(ranks)
    weights = -np.log(np.array([ranks[p] for p in pieces]) + 10.0)
    return pieces, weights - np.logaddexp.reduce(weights)


class Lattice:
    """All pieces within many words of equal length."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.longest = max(map(len, pieces))
        keys = np.array([self._sums(np.frombuffer(p, np.uint8)[None, :])[-1][0] for p in pieces], _U)
        order = np.argsort(keys)
        self.keys, self.logp, self.at = keys[order], logp[order], order
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys * _U(0x9E3779B97F4A7C15)) >> _U(44)] = True
        self.lengths = sorted({len(p) for p in pieces})

    @staticmethod
    def _sums(words: np.ndarray) -> np.ndarray:
        """(length + 1, words) sums of a polynomial hash."""
        n, size = words.shape
        power = np.cumprod(np.concatenate((np.ones(1, _U), np.full(size - 1, _BASE, _U))), dtype=_U)
        sums = np.zeros((size + 1, n), _U)
        np.cumsum((_TABLE[words] * power).T, axis=0, out=sums[1:])
        return sums

    def edges(self, words: np.ndarray) -> list[list[tuple]]:
        """By end: (start, which words have a piece there, index of the piece)."""
        size, sums = words.shape[1], self._sums(words)
        inverse = np.cumprod(np.concatenate((np.ones(1, _U), np.full(
            size - 1, _U(pow(int(_BASE), -1, 1 << 64)), _U))), dtype=_U)
        found: list[list[tuple]] = [[] for _ in range(size + 1)]
        for end in range(1, size + 1):
            for length in self.lengths:
                if length > end:
                    break
                start = end - length
                h = (sums[end] - sums[start]) * inverse[start]
                rows = np.flatnonzero(self.maybe[(h * _U(0x9E3779B97F4A7C15)) >> _U(44)])
                if len(rows):
                    at = np.searchsorted(self.keys, h[rows])
                    at[at == len(self.keys)] = 0
                    same = self.keys[at] == h[rows]
                    if same.any():
                        found[end].append((start, rows[same], at[same]))
        return found

    def forward(self, n: int, edges: list[list[tuple]]) -> np.ndarray:
        a = np.full((len(edges), n), -np.inf)
        a[0] = 0.0
        for end, into in enumerate(edges):
            for start, rows, at in into:
                a[end, rows] = np.logaddexp(a[end, rows], a[start, rows] + self.logp[at])
        return a

    def expected(self, n: int, edges: list[list[tuple]], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each of which comes ``times``."""
        a, b = self.forward(n, edges), np.full((len(edges), n), -np.inf)
        b[-1] = 0.0
        pieces, amounts = [], []
        for end in range(len(edges) - 1, 0, -1):
            for start, rows, at in edges[end]:
                rest = self.logp[at] + b[end, rows]
                b[start, rows] = np.logaddexp(b[start, rows], rest)
                pieces.append(at)
                amounts.append(times[rows] * np.exp(a[start, rows] + rest - a[-1, rows]))
        if not pieces:
            return np.zeros(len(self.keys))
        return np.bincount(self.at[np.concatenate(pieces)], np.concatenate(amounts),
                           minlength=len(self.keys))


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, matrix of bytes) of words of equal length with their leading blank, by chunks of
    bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        size = int(lengths[same[0]]) if len(same) else 0
        if not size:
            continue  # the end is no word
        step = max(1, min(CHUNK, (CHUNK * 64) // size))
        for at in range(0, len(same), step):
            some = same[at:at + step]
            flat = np.frombuffer(b"".join(b" " + words[i] for i in some), np.uint8)
            yield some, flat.reshape(len(some), size + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_out, text) to (word, c): how often in training texts, which may be never."""
    for b in batches:
        counts: Counter = Counter()
        other: set = set()
        for held, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
            words = text.lower().split() if text else []
            words.append(END)
            if held:
                other.update(words)
            else:
                counts.update(words)
        for w in other:
            counts.setdefault(w, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            ["word", "c"])


def _expect(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.keys))
        for b in batches:
            words, times = b.column(0).to_numpy(zero_copy_only=False).tolist(), b.column(1).to_numpy().astype(np.float64)
            for some, matrix in _by_length(words):
                total += lattice.expected(len(some), lattice.edges(matrix), times[some])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])
    return run


def fit(words: DataFrame, documents: int, path: str | None = None,
        rounds: int = ROUNDS) -> Lattice:
    """The lattice with weights from all training words. Where a word ends, a blank or the end of
    the text follows; the end's share of the tokens is its probability there."""
    pieces, logp = vocabulary(path)
    lattice = Lattice(pieces, logp)
    used = words.filter("c > 0").select("word", "c")
    for _ in range(rounds if documents else 0):
        rows = (used.mapInArrow(_expect(lattice), "piece bigint, n double")
                .groupBy("piece").agg(F.sum("n").alias("n")).collect())  # the vocabulary's size
        n = np.full(len(pieces), 0.01)
        for r in rows:
            n[r.piece] += r.n
        lattice = Lattice(pieces, np.log(n / (n.sum() + documents)))
    return lattice


def whole_word_weight(known: DataFrame, tokens: int, steps: int = 4) -> float:
    """Weight of the arcs over whole words: expectation and maximisation over all training words,
    each predicted by the counts without itself."""
    weight = 0.5
    left = F.lit(1 - 1e-9) * (F.col("c") - 1) / max(1, tokens - 1)
    for _ in range(steps if tokens > 1 else 0):
        whole = weight * left
        share = whole / (whole + (1 - weight) * F.pow(F.lit(10.0), F.col("lattice")) + 1e-300)
        weight = known.filter("c > 0").agg(F.sum(F.col("c") * share) / tokens).first()[0]
        weight = min(max(weight, 1e-6), 1 - 1e-6)
    return weight if tokens > 1 else 1e-6


def frequent_from(words: DataFrame, most: int | None = None) -> int:
    """The smallest count, by quarters of powers of two, that at most ``most`` words reach."""
    most = FREQUENT if most is None else most
    step = F.floor(4 * F.log2("c")).cast("int")
    rows = words.filter("c > 0").groupBy(step.alias("step")).agg(
        F.count("*").alias("n"), F.min("c").alias("c")).collect()  # 4 rows per power of two
    held, least = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r.step):
        held += r.n
        if held > most:
            break
        least = r.c
    return least


def word_key(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 0)
    return h - (1 << 64) if h >> 63 else h


def _score(lattice: Lattice, end: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, c) with key and log10 probability."""
        for b in batches:
            words = b.column(0).to_numpy(zero_copy_only=False).tolist()
            logp = np.full(len(words), end)
            for some, matrix in _by_length(words):
                logp[some] = lattice.forward(len(some), lattice.edges(matrix))[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([word_key(w) for w in words], pa.int64()),
                 pa.array(logp / math.log(10))], ["word", "c", "key", "lattice"])
    return run


def _look_up(frequent: dict[bytes, tuple[float, float, float, int]]):
    """(doc_id, held_out, text): sums over frequent words, the others' keys and numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column(2).cast(pa.large_binary()):
                words = (text.as_py() or b"").lower().split()
                words.append(END)
                base = score = lattice = 0.0
                known, keys, numbers = 0, [], []
                for w, n in Counter(words).items():
                    if (f := frequent.get(w)) is None:
                        keys.append(word_key(w))
                        numbers.append(n)
                    else:
                        base += n * f[0]
                        score += n * f[1]
                        lattice += n * f[2]
                        known += n * f[3]
                for c, v in zip(out, (len(words), known, base, score, lattice, keys, numbers)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(),
                     pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score", "lattice", "keys", "numbers"])
    return run


def scored(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    told = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"),
                       "text")
    words = stored(told.select("held_out", "text").mapInArrow(_count, "word binary, c bigint")
                   .groupBy("word").agg(F.sum("c").alias("c")), "words")
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"),
                     F.coalesce(F.max(F.when(F.length("word") == 0, F.col("c"))), F.lit(0)).alias("docs")
                     ).first()
    lattice = fit(words, size.docs, path, rounds)
    end = math.log((size.docs or 1) / (size.n or 2))
    known = stored(words.mapInArrow(_score(lattice, end),
                                    "word binary, c bigint, key bigint, lattice double"), "known-words")
    weight = whole_word_weight(known, size.n)
    base = F.log10((F.col("c") + 0.5) / (size.n + 0.5 * (size.v + 1)))
    whole = F.log10(weight * F.col("c") / (size.n or 1))
    pieces = F.lit(math.log10(1 - weight)) + F.col("lattice")
    most = F.greatest(whole, pieces)
    ten = F.lit(10.0)
    score = F.when(F.col("c") == 0, pieces).otherwise(
        most + F.log10(F.pow(ten, whole - most) + F.pow(ten, pieces - most)))
    known = known.withColumn("base", base).withColumn("score", score)
    top = known.filter(F.col("c") >= frequent_from(known))
    frequent = {bytes(r.word): (r.base, r.score, r.lattice, int(r.c > 0)) for r in top.collect()}
    rows = stored(told.mapInArrow(
        _look_up(frequent), "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, "
                            "score double, lattice double, keys array<bigint>, numbers array<bigint>")
        .withColumn("row", F.monotonically_increasing_id()), "documents")
    rare = rows.select("row", F.inline(F.arrays_zip("keys", "numbers")))
    n = F.col("numbers")
    sums = [F.sum(n * F.col(c)).alias(f"rare_{c}") for c in ("base", "score", "lattice")]
    found = (rare.join(known.select("key", "base", "score", "lattice", "c"),
                       F.col("keys") == F.col("key"))
             .groupBy("row").agg(*sums, F.sum(F.when(F.col("c") > 0, n)).alias("rare_known")))

    def total(c: str) -> Column:
        return F.col(c) + F.coalesce(f"rare_{c}", F.lit(0))
    return rows.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", total("known").alias("n_known"),
        F.lit(size.n).cast("bigint").alias("train_tokens"), total("base").alias("base_score"),
        total("score").alias("score"), total("lattice").alias("lattice_score"))
