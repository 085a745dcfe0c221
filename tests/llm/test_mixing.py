"""Mixing against its SQL and by its definition."""

import math
from collections import Counter

import duckdb
import pytest
from llm_cases import CLASHES, SF

from codeaudit.llm import mixing as q


def planned(docs, **goal):
    rows = q.stored(q.narrow(docs), "narrow")
    goals = q.quotas(rows, **goal)
    return q.plan(rows, goals), goals


def sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().convert_dtypes(dtype_backend="pyarrow"))
    got = con.execute(q.plan_sql())
    return [d[0] for d in got.description], Counter(got.fetchall())


CASES = [(i, "w " * (i % 9), "big" if i % 3 else None if i % 2 else "small") for i in range(240)]
CASES += [(7, "same row", "big")] * 5 + [(None, "no id", "x"), (8, None, "x"), (9, "", "empty"), (10, "long " * 3000, "x")]


@pytest.mark.parametrize("piece", [3, 4096])
def test_plan_equals_sql(docs_of, monkeypatch, piece):
    monkeypatch.setattr(q, "PIECE_ROWS", piece)
    docs = docs_of(CASES, CLASHES[4:])
    plan, _ = planned(docs)
    names, want = sql(docs)
    assert Counter(tuple(r[n] for n in names) for r in plan.collect()) == want
    copies = Counter()
    for r in plan.collect():
        copies[r.doc_id, r.source] += r.times
    out = q.mixed(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == copies


def test_exponent_meets_the_goal(spark):
    shares = spark.createDataFrame([("a", 900, .9), ("b", 60, .06), ("c", 40, .04)], "source string, tokens bigint, share double")

    def weights(a):
        p = [s ** a for s in (.9, .06, .04)]
        return [x / sum(p) for x in p]

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a))
    a, step = q.exponent(shares, entropy=0.8, repetitions=None), 1 / q.GRID
    assert entropy(a) >= 0.8 * math.log(3) > entropy(a + step)
    a = q.exponent(shares, repetitions=2.0)
    from pyspark.sql import functions as F
    a = q.exponent(shares, repetitions=2.0, budget=F.lit(1000))

    def most(a):
        return max(w * 1000 / t for w, t in zip(weights(a), (900, 60, 40)))
    assert most(a) <= 2.0 < most(a - step)
    assert q.exponent(shares, entropy=0.0) == 1.0
    assert q.exponent(shares.limit(1)) == 1.0


def test_budget_and_blocks(docs_of):
    docs = docs_of([(i, "w " * 10, "big" if i % 10 else "small") for i in range(1000)])
    plan, goals = planned(docs, budget=20_000, block_tokens=1000)
    rows, quota = plan.collect(), {r.source: r.quota for r in goals.collect()}
    for s, n in quota.items():
        own = [r for r in rows if r.source == s]
        assert n <= sum(r.n_tokens for r in own) < n + 10
        per_block = Counter(r.block for r in own)
        assert set(per_block) == set(range(20)) and max(per_block.values()) - min(per_block.values()) <= 2
        by_epoch = Counter((r.epoch, r.doc_id) for r in own)
        assert max(by_epoch.values()) == 1


def test_empty(docs_of):
    docs = docs_of([(1, "", "a"), (2, None, None)])
    for d in (docs, docs.limit(0)):
        assert planned(d)[0].count() == 0 and q.mixed(d).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, want = sql(docs)
    assert Counter(tuple(r[n] for n in names) for r in planned(docs)[0].collect()) == want


TINY = [(i, f"{i} " * 1000, "big") for i in range(200)] + [(999, "one", "tiny"), (998, "two words " * 40, "little")]


def test_tiny_source_is_bounded(docs_of):
    """The entropy goal alone would copy it some 70,000 times."""
    docs = docs_of(TINY)
    copies = Counter(r.doc_id for r in q.mixed(docs).collect())
    assert max(copies.values()) <= math.ceil(q.REPETITIONS) and copies[999] >= 1
    plan, goals = planned(docs)
    assert all(r.quota <= q.REPETITIONS * r.tokens + 1 for r in goals.collect())
    names, want = sql(docs)
    assert Counter(tuple(r[n] for n in names) for r in plan.collect()) == want
    free = q.quotas(q.narrow(docs), repetitions=None).collect()
    assert max(r.quota / r.tokens for r in free) > 1000
