"""Line dedup against counting every key."""

import hashlib
import random
from collections import Counter, defaultdict

from llm_cases import CLASHES, SF
from pyspark.sql import functions as F

from codeaudit.llm import line_dedup as q

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def slow(rows):
    docs, top = defaultdict(set), {}
    order = lambda d: (d is not None, d or 0)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(d)
    for k, own in docs.items():
        if len(own) >= 3:
            top[k] = max(own, key=order)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if top.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow([(r.doc_id, r.text) for r in docs.collect()])
    assert any(n for _, _, n, _ in want)
    assert Counter(map(tuple, q.digests(q.deduplicated(docs)).collect())) == want


def test_random_and_odd(spark, docs_of):
    rng = random.Random(2)
    lines = [f"A line of text that is common {i}" for i in range(12)] + ["short", "", "É" * 20, "é" * 20, "ÉABC" * 4 + "  "]
    rows = [(rng.randrange(60), "\n".join(rng.choice(lines) + rng.choice(["", " ", "\t\r"]) for _ in range(rng.randrange(8))))
            for _ in range(150)]
    rows += [(None, None), (None, lines[0] + "\n" + lines[0].upper()), (None, lines[1]), (61, ""), (62, None), (63, "x" * 400_000)]
    rows += [rows[0]] * 3
    docs = docs_of(rows, CLASHES + ("docs", "top", "gone", "batch"))
    out = q.deduplicated(docs)
    assert Counter(map(tuple, q.digests(out).collect())) == slow(rows)
    assert out.select("_d.*").columns == docs.columns
    assert q.deduplicated(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    """Batches of any order give the same index; settled keys aren't written again."""
    rng = random.Random(4)
    seen = sorted({(rng.randrange(30), d) for d in range(90) for _ in range(6)} | {(99, d) for d in range(90)})
    index = q.LineRuns(spark, buckets=2, fan=3)
    for b in range(9):
        rows = [(h, h, d) for h, d in seen if d % 9 == 8 - b]
        index.add(spark.createDataFrame(rows, "h1 bigint, h2 bigint, doc_id bigint"))
        assert all(len(level) < 3 for level in index.levels)
    assert [len(level) for level in index.levels] == [0, 0, 1]
    want = {h: max(d for k, d in seen if k == h) for h, n in Counter(h for h, _ in seen).items() if n >= 3}
    rows = index.settled().collect()
    assert {r.h1: r.top for r in rows} == want
    assert next(r.docs for r in rows if r.h1 == 99) <= 90
    index.close()
    again = q.LineRuns(spark, buckets=2)
    again.add(spark.createDataFrame([(1, 1, d) for d in (7, 8, 9)], "h1 bigint, h2 bigint, doc_id bigint"))
    again.add(spark.createDataFrame([(1, 1, 5), (2, 2, 5)], "h1 bigint, h2 bigint, doc_id bigint"))
    assert spark.table(again.levels[0][1]).select("h1").collect()[0].h1 == 2 and spark.table(again.levels[0][1]).count() == 1
    again.add(spark.createDataFrame([(1, 1, 12)], "h1 bigint, h2 bigint, doc_id bigint"))
    assert again.settled().select(F.max("top")).first()[0] == 12
    again.close()
