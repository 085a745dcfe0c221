"""Periodic runs against a scan of all lags."""

import hashlib
import random
import zlib

from hypothesis import given, settings, strategies as st
from llm_cases import CLASHES, SF

from codeaudit.llm import word_runs as q


def slow(words):
    """Every lag, every stretch; of equal stretches the smallest lag."""
    best = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            first = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - first + p >= max(6, 4 * p):
                best.setdefault((first, i - first + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in best.items())


def answer(doc_id, text):
    words = q_words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else q_words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 20), st.integers(1, 8))
def test_any_words(words, period, times):
    tail = words + words[-period:] * times + words[:3]
    for w in (words, tail):
        found = q.runs(w)
        assert found == slow(w)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        assert q.without_repeats(w, found) == [x for i, x in enumerate(w) if i not in gone]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, q.digests(q.collapsed(docs, q.damaged())).collect()))
    assert got == sorted(answer(r.doc_id, r.text) for r in docs.collect())


def test_edges(spark, docs_of):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b " * 9), (None, None), (7, "x " * 50_000), (8, "é ß " * 4), (8, "é ß " * 4)]
    rows += [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(20, 120)]
    docs = docs_of(rows, CLASHES)
    got = list(map(tuple, q.digests(q.collapsed(docs, q.damaged())).collect()))
    assert sorted((g for g in got if g[0] != 7), key=repr) == sorted((answer(d, t) for d, t in rows if d != 7), key=repr)
    assert [g[1] for g in got if g[0] == 7] == [1]
    out = q.collapsed(docs)
    assert out.select("_d.*").columns == docs.columns
    assert q.collapsed(docs.limit(0)).count() == 0


def test_long_runs_stay_cheap():
    words = ["a"] * 200_000 + ["b", "c"] * 50_000
    assert q.runs(words) == [(0, 200_000, 1), (200_000, 100_000, 2)]
