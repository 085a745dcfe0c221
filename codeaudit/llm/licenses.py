"""License scan: MinHash bands over overlapping windows, then exact containment.

Words are runs of a-z and 0-9 of the lower-cased text, shingles five words. For a template of n
shingles windows of ``n + n/4`` shingles start every ``n/4`` (rounded; at least every one), plus
what a step adds, so every passage of up to 1.25 n shingles lies in one window. A window that holds
the share ``LEAST`` = 0.8 of a template then has a Jaccard similarity of at least 0.8 / 1.7 with it.
With ``BANDS`` = 20 bands of one row a band collides with probability 1 - (1 - 0.47) ** 20, all but
3 in a million (of a whole copy, similarity at least 2/3, all but 3 in ten thousand million). Minima
of all window lengths come from the same doubling minima. Windows and templates that collide are
compared by their exact sets of shingles.

The templates are bounded by the library of licenses, not by the corpus, and travel with the tasks.
A document is scanned where it is read, without a shuffle, in slices of documents.

Defined cases. Null and empty texts, and those below five words, match nothing and give no row.
Repeated rows are scanned each. Several passages of a document that match a template give one row:
the best containment, then the first place. Empty tables give empty results. A template of fewer
than five words is refused (ValueError). Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from codeaudit.llm.license_texts import LICENSES

SHINGLE, LEAST, BANDS, SLICE = 5, 0.8, 20, 128
_U = np.uint64
_NONE = ~_U(0)
_rng = np.random.Generator(np.random.PCG64(5))
_SALTS = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64) | _U(1)
_PLACE = [_U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(SHINGLE)]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the five words at each word of all texts (the largest number where a text ends
    sooner), and where texts end."""
    clean = pc.replace_substring_regex(pc.ascii_lower(texts), "[^a-z0-9]+", " ")
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(clean))
    ends = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
    coded = words.flatten().dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w, 1) for w in coded.dictionary.to_numpy(zero_copy_only=False)], _U)
    h = known[coded.indices.to_numpy()] if len(known) else known
    n = len(h)
    out = np.full(n, _NONE)
    if n >= SHINGLE:
        sums = np.zeros(n - SHINGLE + 1, _U)
        for k in range(SHINGLE):
            sums += h[k:n - SHINGLE + 1 + k] * _PLACE[k]
        out[:n - SHINGLE + 1] = sums ^ (sums >> _U(29))
    begins = np.concatenate(([0], ends[:-1]))
    for k in range(1, SHINGLE):
        out[(ends - k)[ends - begins >= k]] = _NONE
    return out, ends


class Templates:
    """Templates by their number of shingles."""

    def __init__(self, texts: dict[str, str]):
        self.groups: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, text in texts.items():
            own = np.unique(shingles(pa.array([text]))[0])
            own = own[own != _NONE]
            if not len(own):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.groups.setdefault(len(own), []).append((name, own))
        self.minima = {n: np.stack([((own ^ _SALTS[:, None]) * _ODD[:, None]).min(1)
                                    for _, own in group]) for n, group in self.groups.items()}

    @staticmethod
    def window(n: int) -> tuple[int, int]:
        """Length and step of the windows for templates of n shingles."""
        step = max(1, n // 4)
        return n + n // 4 + step - 1, step

    def candidates(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(n, template among those of n, start of window): some band collides."""
        found, size = set(), len(h)
        for band in range(BANDS):
            low = [np.where(h == _NONE, _NONE, (h ^ _SALTS[band]) * _ODD[band])]
            for n in self.groups:
                length, step = self.window(n)
                length = min(length, size)
                level = length.bit_length() - 1
                while len(low) <= level:
                    half = 1 << (len(low) - 1)
                    low.append(np.minimum(low[-1][:-half], low[-1][half:]))
                m = low[level]
                if step > 1:
                    starts = np.append(np.arange(0, size - length, step), size - length)
                    least = np.minimum(m[starts], m[starts + length - (1 << level)])
                else:
                    starts = None
                    least = np.minimum(m[:size - length + 1], m[length - (1 << level):])
                for t, own in enumerate(self.minima[n][:, band]):
                    for at in np.flatnonzero(least == own):
                        found.add((n, t, int(at if starts is None else starts[at])))
        return found

    def scan(self, texts: pa.Array) -> list[tuple]:
        """(document, license, containment, first word, words) of all matches, best per pair."""
        h, ends = shingles(texts)
        best: dict[tuple[int, str], tuple] = {}
        if not len(h):
            return []
        for n, t, start in self.candidates(h):
            name, own = self.groups[n][t]
            stop = start + self.window(n)[0]
            doc = int(np.searchsorted(ends, start, "right"))
            while doc < len(ends) and start < stop:
                begin = int(ends[doc - 1]) if doc else 0
                a, b = max(start, begin), min(stop, int(ends[doc]))
                part = h[a:b]
                hit = np.flatnonzero(np.isin(part, own))
                share = len(np.unique(part[hit])) / n
                if share >= LEAST:
                    place = (-share, int(a + hit[0] - begin), int(hit[-1] - hit[0] + SHINGLE))
                    best[doc, name] = min(best.get((doc, name), place), place)
                start, doc = int(ends[doc]), doc + 1
        return [(doc, name, -p[0], p[1], p[2]) for (doc, name), p in sorted(best.items())]


def _scan(templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), SLICE):
                rows = templates.scan(pc.fill_null(b.column(1).slice(at, SLICE), ""))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([at + d for d in cols[0]], pa.int64())),
                     pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    ["doc_id", "license", "containment", "first_word", "n_words"])
    return run


def licenses(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, first_word, n_words) of every license a document holds."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _scan(Templates(texts or LICENSES)),
        "doc_id bigint, license string, containment double, first_word bigint, n_words bigint")
