"""SimHash classes against all pairs."""

import numpy as np
import pytest
import xxhash
from llm_cases import CLASHES, SF

from codeaudit.llm import simhash as q
from codeaudit.llm.components import components


def slow(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest id reachable, by all pairs."""
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    fp = np.array([f for _, f in prints], np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1:]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(n)]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = q.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in rows]
    assert all(slow(texts[i]) == f for i, f in prints[:200])
    assert [r.component_id for r in rows] == classes(prints)


def test_edges(spark, docs_of):
    rows = [(5, None), (4, ""), (3, " \n"), (None, "A b"), (9, "a B"), (8, "one two three four"), (7, "one two three four"),
            (7, "one two three four"), (None, "alone in here with no id"), (2, "é ß x")]
    docs = docs_of(rows, CLASHES)
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in q.near_duplicates(docs).collect())
    want = [(d, slow(t)) for d, t in rows]
    assert got == sorted((d or -1, f"{f:016x}", c or -1) for (d, f), c in zip(want, classes(want)))
    kept = q.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 7, 9]
    assert q.near_duplicates(docs.limit(0)).count() == 0 and q.keep_one(docs.limit(0)).count() == 0


def test_keep_one_tells_classes_of_one_id_apart(spark, docs_of):
    """Different texts without an id, and one id with two texts: none goes."""
    rows = [(None, "first text without any id"), (None, "something else entirely, no id either"),
            (None, "first text without any id"), (7, "one id has this text here"),
            (7, "and also quite another one"), (8, "One id has this text here")]
    kept = sorted((r.doc_id or -1, r.text) for r in q.keep_one(docs_of(rows)).collect())
    assert kept == sorted((d or -1, t) for d, t in {rows[0], rows[1], rows[3], rows[4]})


@pytest.mark.parametrize("tile", [4, 2048])
def test_tiles_and_hot_keys(spark, monkeypatch, tile):
    """Many fingerprints in a small ball and some far ones: the same classes however they are cut."""
    monkeypatch.setattr(q, "TILE", tile)
    rng = np.random.default_rng(3)
    centre, prints = int(rng.integers(1 << 62)), []
    for i in range(300):
        f = centre if i % 3 else int(rng.integers(1 << 62))
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            f ^= 1 << int(b)
        prints.append((i, f))
    signed = [(i, int(np.uint64(f).astype(np.int64))) for i, f in prints]
    df = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    got = {r.fp: r.component_id for r in q.classes(df).collect()}
    assert [got[f] for _, f in signed] == classes(prints)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 80), (7, 7), (200, 201), (201, 200)]
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 80, 90: 80, 201: 200}
