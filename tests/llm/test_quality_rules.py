"""Quality rules against a brute-force version."""

import math
import re
from collections import Counter

import pytest
from llm_cases import CLASHES, SF
from pyspark.sql import functions as F

from codeaudit.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    rep = {j for i, x in enumerate(wins) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark, docs_of):
    texts = [None, "", "   \n\t", "one", "a b a b a b a b", "x y z\nx y z\n\n \nx y z\r\n", "#<|>$ %&*",
             "é ü\u00a0ü ſ\x0bq\x0cr", "word " * 70, " ".join(f"w{i % 60}" for i in range(200)),
             " ".join(f"w{i}" for i in range(60)), "a  b\n" * 3000]
    docs = docs_of(texts + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    got = {r.id: r for r in q.with_counts(docs, only=["doc_id"]).select(F.col("_d.doc_id").alias("id"), *NAMES).collect()}
    for r in docs.collect():
        assert tuple(got[r.doc_id][n] for n in NAMES) == base(r.text), r.doc_id


def test_ratio_and_verdict_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.judged(docs, labels, only=["doc_id"]).select("_d.doc_id", "base_failed", "score",
                                                          "threshold", "kept").collect()
    hashes = {r.doc_id: (r.h, r.p) for r in docs.select(
        "doc_id", F.transform(q.words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).select(
        "doc_id", "h", F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1))).alias("p")).collect()}
    fitted = {r["_id"] for r in q.trusted_ids(labels, q.MAX_TRUSTED).filter(q.FITTED).collect()}
    every, good = Counter(), Counter()
    for i, (h, p) in hashes.items():
        cells = [x % q.BUCKETS for x in h + p]
        every.update(cells)
        if i in fitted:
            good.update(cells)
    a, b = (sum(c.values()) + q.SMOOTHING * q.BUCKETS for c in (good, every))
    for r in rows:
        h, p = hashes[r.doc_id]
        each = [math.log((good[x % q.BUCKETS] + q.SMOOTHING) / a)
                - math.log((every[x % q.BUCKETS] + q.SMOOTHING) / b) for x in h + p]
        want = sum(each) / len(each) if each else 0.0
        assert r.score == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= r.threshold)


def test_clean_documents_stay_and_junk_goes(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = (q.judged(docs, labels, only=["doc_id"]).select("_d.doc_id", "base_failed", "kept")
            .join(labels, "doc_id").collect())
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) < 0.35 * len(junk)


def test_no_labels_no_documents_and_other_columns(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = docs_of([(None, " ".join(f"w{i}" for i in range(60))), (1, None), (1, "few")], CLASHES)
    assert [r.doc_id for r in q.keep(docs, labels).collect()] == [None]
    assert q.keep(docs, labels).columns == docs.columns
    one = spark.createDataFrame([(None, 1, None), (7, 1, None), (1, None, None)], labels.schema)
    assert q.keep(docs, one).count() == 1
    assert q.keep(docs.limit(0), one).count() == 0


def test_all_trusted_documents_count(spark):
    """More of them than any bound that was ever set: ids, ratios and threshold are of all."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr(
        "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', pmod(hash(id, i), 97 + i % 7))))").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert q.trusted_ids(labels, q.MAX_TRUSTED).count() == 20_000
    rows = q.judged(docs, labels, only=["doc_id"]).select(
        F.col("_d.doc_id").alias("_id"), "base_failed", "score", "threshold")
    assert rows.filter("base_failed").count() == 0
    r = rows.filter(f"NOT ({q.FITTED})").agg(F.avg("score"), F.stddev("score"), F.max("threshold")).first()
    assert r[2] == pytest.approx(r[0] - q.SPREADS * r[1], rel=1e-9)
