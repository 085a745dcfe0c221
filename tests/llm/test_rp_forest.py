"""Forest search against brute force."""

import numpy as np
import pytest
from llm_cases import CLASHES, SF

from codeaudit.llm import rp_forest as q


def brute(rows, every, nearest=20):
    """rows: (id, vector) that take part, distinct ids."""
    m, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = q.exact(m[k], m)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:nearest]
        out[int(ids[k])] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, rows):
    extra = "".join(f", `{c}` string" for c in CLASHES if c != "key")
    return spark.createDataFrame([(i, v, *["x"] * (len(CLASHES) - 1)) for i, v in rows],
                                 "vec_id bigint, embedding array<float>" + extra)


def test_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, 20)
    got = found(q.neighbours(vectors, 20, leaf=64, look=6000).collect())
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    hits = sum(len({i for i, _ in g} & {i for i, _ in want[k]}) for k, g in got.items())
    assert hits >= 0.9 * 20 * len(want)
    by = {i: np.array(v, float) for i, v in rows}
    for k, g in got.items():
        for i, s in g:
            assert s == pytest.approx(float(by[k] @ by[i]), abs=1e-12)
        assert g == sorted(g, key=lambda x: (-x[1], x[0]))


def test_all_looked_at_is_exact(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert found(q.neighbours(vectors, 20).collect()) == brute(rows, 20)


@pytest.mark.parametrize("leaf_rows", [3, 4096])
def test_edges(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(q, "LEAF_ROWS", leaf_rows)
    rng = np.random.default_rng(6)
    good = [(i, [float(x) for x in np.float32(rng.standard_normal(4) * rng.uniform(.2, 3))]) for i in range(60)]
    good += [(i, [0.5, 0.5, 0.25, 0.0]) for i in range(100, 160)]  # ties of equal vectors
    bad = [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 0.0, 1.0]), (280, [1.0, float("nan"), 0.0, 1.0]),
           (300, [1.0, float("inf"), 0.0, 1.0]), (None, [1.0] * 4), (320, [1.0] * 3)]
    got = found(q.neighbours(frame(spark, good + bad + good[:3]), 20, leaf=8).collect())
    assert got == brute(good, 20)


def test_look_grows_until_the_recall_is_met(spark):
    """Vectors without structure and a look far too small for them."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.float32(rng.standard_normal((3000, 32))))]
    got, want = found(q.neighbours(frame(spark, rows), 20, leaf=32, look=200).collect()), brute(rows, 20)
    hits = sum(len({i for i, _ in g} & {i for i, _ in want[k]}) for k, g in got.items())
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)


def test_equal_queries_and_cut_leaves(spark, monkeypatch):
    """Leaves of few queries each, and a vector with many ids that ask."""
    monkeypatch.setattr(q, "LEAF_QUERIES", 2)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.float32(rng.standard_normal((90, 4))))]
    rows += [(i, [0.5, 0.5, 0.25, 0.0]) for i in range(100, 400)]
    assert found(q.neighbours(frame(spark, rows), 5, leaf=8).collect()) == brute(rows, 5)


def test_few_and_none(spark):
    two = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 2.0])])
    assert found(q.neighbours(two, 20).collect()) == {0: [(1, 0.0)]}
    assert q.neighbours(two.filter("vec_id = 0"), 20).count() == 0
    assert q.neighbours(two.limit(0), 20).count() == 0


def test_queue_is_shared():
    """The branch with the smallest crossing comes first, whichever tree it is in."""
    rng = np.random.default_rng(0)
    forest = q.Forest(rng.standard_normal((64, 3)), 10.0, 2, 3)
    held = np.ones((3, 4), np.int64)
    query = rng.standard_normal(3)
    order = forest.search(query, held, 12)
    assert sorted(order) == list(range(12))
    assert {x // 4 for x in order[:3]} == {0, 1, 2}  # each tree's own leaf first
    cost = {}
    row = np.append(query, 0.0).astype(np.float32)
    for t, tree in enumerate(forest.trees):
        m = tree.normals @ row - tree.cuts
        for leaf in range(4):
            node, worst = leaf + 3, 0.0
            while node:
                parent, right = (node - 1) // 2, node % 2 == 0
                if right != (m[parent] > 0):
                    worst = max(worst, abs(m[parent]))
                node = parent
            cost[t * 4 + leaf] = worst
    assert [cost[x] for x in order] == sorted(cost.values())
