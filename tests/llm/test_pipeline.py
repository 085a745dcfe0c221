"""The pipeline: each stage against what its operator says of the stage's own input."""

import math
from collections import Counter

import corpus_pipeline
import pytest
from llm_cases import CLASHES, SF
from pyspark.sql import functions as F
from test_quality_rules import base
from test_simhash import classes, slow
from test_suffix_dedup import brute

from codeaudit.llm import mixing, packing, quality_rules
from codeaudit.sources.work import stored


@pytest.fixture(scope="module")
def steps(spark):
    """Documents, then what each stage makes of them."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), "stage"))
    return docs


def test_stages_and_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for out in steps[1:-1]:
        assert out.columns == steps[0].columns
    assert all(out.count() > 0 for out in steps)


def test_quality_stage(spark, steps):
    kept = {r.doc_id for r in steps[1].collect()}
    told = {r.doc_id: r.kept for r in quality_rules.judged(
        steps[0], spark.read.parquet(f"{SF}/labels.parquet"), only=["doc_id"]).select("_d.doc_id", "kept").collect()}
    assert kept == {d for d, k in told.items() if k}
    assert not any(base(r.text)[-1] for r in steps[1].collect())


def test_simhash_stage(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    ids = classes([(d, slow(t)) for d, t in rows])
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(set(ids))


def test_suffix_stage(spark, steps):
    order = {r.doc_id: r.h for r in steps[2].select(
        "doc_id", F.xxhash64("doc_id", "text", F.col("doc_id").isNull()).alias("h")).collect()}
    rows = sorted(((r.doc_id, r.text.encode()) for r in steps[2].collect()), key=lambda r: (r[0], order[r[0]]))
    want = {d: n - gone for d, n, gone, _, _ in brute(rows, "first")}
    got = {r.doc_id: (len(r.text.encode()), r.n_chars, len(r.text)) for r in steps[3].collect()}
    for d, left in want.items():
        if d in got:
            size, told, chars = got[d]
            assert left - 6 <= size <= left and told == chars  # characters cut through go as a whole
        else:
            assert left < 200


def test_mixing_stage(steps):
    rows = stored(mixing.narrow(steps[3]), "narrow")
    plan = mixing.plan(rows, mixing.quotas(rows)).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.times
    assert Counter(r.doc_id for r in steps[4].collect()) == want


def test_packing_stage(steps):
    docs = Counter(r.doc_id for r in steps[4].collect())
    rows = steps[5].collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == docs
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY


def test_run_equals_stages(spark, steps):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect())) == Counter(
        map(tuple, steps[5].select(*key).collect()))


def test_odd_rows_go_through(spark, docs_of):
    long = " ".join(f"word{i}" for i in range(90))
    docs = docs_of([(1, None), (2, ""), (None, long + " null id"), (3, long, None), (3, long, None), (4, long)],
                   CLASHES[:4] + CLASHES[-11:])
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "odd")
    assert docs.count() >= 1
    empty = docs_of([(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SF), "empty")
    assert empty.count() == 0


def test_tiny_source_in_the_mixing_stage(spark, docs_of):
    rows = [(i, f"word{i} " * 500, "big") for i in range(60)] + [(99, "only one", "tiny")]
    out = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs_of(rows), SF).collect())
    assert max(out.values()) <= math.ceil(mixing.REPETITIONS)
