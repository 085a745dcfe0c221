"""Conversation repair against a plain programme over edit strings, also over several tasks."""

import hashlib
import random

import pytest
from llm_cases import CLASHES
from pyspark.sql import functions as F

from codeaudit.llm import repair as q

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def slow(rows):
    """Everything asked of one conversation's (turn, role, text), by keeping for each state the least
    (cost, edits, said) of all ways forward."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    seen, faults = set(), []
    for _, r, x in rows:
        bare = x.rstrip(q.BLANKS)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    first = [r[:1] for _, r, _ in rows]
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    def insert(ways):
        for _ in range(3):
            for s, (c, e, m) in list(ways.items()):
                for n in after[s]:
                    if n != "s":
                        way = (c + 5, e + "I", m + [full[n] + ":"])
                        ways[n] = min(ways.get(n, way), way)
        return ways
    ways = insert({"": (0, "", [])})
    for (_, r, x), fault in zip(rows, faults):
        new = {}
        for s, (c, e, m) in ways.items():
            new[s] = min(new.get(s, (c + 2, e + "D", m)), (c + 2, e + "D", m))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                for n in after[s]:
                    tries = [(c + more, e + "K", m + [f"{r}:{x}"])] if r[:1] == n else []
                    if n != "s":
                        tries.append((c + more + 1, e + "R", m + [f"{full[n]}:{x}"]))
                    for way in tries:
                        new[n] = min(new.get(n, way), way)
        ways = insert(new)
    cost, edits, said = min(ways[s] for s in ("", "a") if s in ways)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, edits,
            hashlib.sha256("\n".join(said).encode()).hexdigest())


def random_rows(rng, n, ties=False):
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["a.", "b?", "cut", "", " \t", None, "c! "]
    out = []
    for i in range(n):
        own = (rng.choice(roles), f"{i}." if rng.random() < 0.5 else rng.choice(texts))
        out.append((None if i == 0 and rng.random() < 0.3 else i * 2 if rng.random() < 0.9 else i * 2 + 1, *own))
        if ties and rng.random() < 0.2:
            out += [out[-1]] * rng.randrange(1, 4)
    return out


def answers(spark, rows, convs=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.conv_id: tuple(r)[1:] for r in q.digests(*q.repaired(df), df if convs is None else convs).collect()}


def test_many_small(spark):
    rng = random.Random(5)
    convs = {i: random_rows(rng, rng.randrange(1, 9), ties=True) for i in range(300)}
    convs[None] = random_rows(rng, 5)
    got = answers(spark, [(c, *r) for c, rows in convs.items() for r in rows])
    assert got == {c: slow(rows) for c, rows in convs.items()}


def test_one_over_many_tasks(spark):
    rng = random.Random(6)
    convs = {1: random_rows(rng, 700, ties=True), 2: random_rows(rng, 9), 0: random_rows(rng, 3), 7: random_rows(rng, 90)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = [(c, *r) for c, own in convs.items() for r in own]
        df = spark.createDataFrame(rows, SCHEMA)
        parts = q.narrow(q.keyed(df)).filter("conv_id = 1").select("part").distinct().count()
        assert parts > 5
        assert answers(spark, rows) == {c: slow(own) for c, own in convs.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_and_starts():
    """Checkpoints don't change the walk, and a table of costs agrees with it."""
    rng = random.Random(7)
    for _ in range(200):
        rows = [(rng.randrange(4), rng.random() < 0.2, rng.random() < 0.3, rng.choice([1, 1, 3])) for _ in range(rng.randrange(1, 40))]
        costs, v = q.table(rows), q.LAST
        for r in reversed(rows):
            v = q.back(v, r)
        assert v == [min(costs[4 * s + e] + q.LAST[e] for e in range(4)) for s in range(4)]
        ways = list(q.walk(rows, q.LAST, [0, 1, 2, 3]))
        assert ways == list(map(list, zip(*[[w[0] for w in q.walk(rows, q.LAST, [s])] for s in range(4)])))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert answers(spark, [(1, 0, "user", "x" * 300_000 + ".")])[1][5:7] == (2, "D")
    some = spark.createDataFrame([(4, 0, "user", "a."), (None, 1, "user", "b.")], SCHEMA)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in q.digests(*q.repaired(empty), some).collect()}
    assert got == {4: none, None: none}
    wide = some.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in ("conv_id", "turn", "role", "text")])
    edits, counts = q.repaired(wide)
    assert counts.count() == 2 and edits.count() == 2
    assert q.damaged(empty).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_damage(spark, k):
    import zlib
    turn = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == k)
    rows = spark.createDataFrame([(3, turn, "system", "A. b! c?")], SCHEMA)
    want = [[], [("system", "")], [("system", "A b c")], [("system", "A. b! c?")] * 2, [("user", "A. b! c?")]][k]
    assert [(r.role, r.text) for r in q.damaged(rows).collect()] == want
