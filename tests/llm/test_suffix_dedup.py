"""Repeated passages against every 200-byte string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import CLASHES, SF

from codeaudit.llm import suffix_dedup as q


def brute(rows, keep):
    """rows in order: (id, bytes); what each loses."""
    count, first = Counter(), {}
    for k, (_, t) in enumerate(rows):
        for i in range(len(t) - 199):
            count[t[i:i + 200]] += 1
            first.setdefault(t[i:i + 200], (k, i))
    out = []
    for k, (d, t) in enumerate(rows):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i:i + 200]] > 1 and (keep == "none" or first[t[i:i + 200]] != (k, i)):
                gone[i:i + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long = text(60), text(900)
    near = long.split()
    near[400] = "changed"
    rows = [text(80), long, long, " ".join(near), text(20) + passage + text(30), passage, text(5) + passage[3:],
            "ab" * 700, "ab" * 100, "x" * 199, "x" * 200, "x" * 5000, None, "", text(300)]
    return rows + [text(rng.randint(5, 20)) + passage + text(8) for _ in range(30)] + [rows[-1], rows[-1]]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [3, 512])
def test_made_texts(docs_of, monkeypatch, keep, hot):
    monkeypatch.setattr(q, "HOT", hot)
    rows = made()
    got = sorted(tuple(r) for r in q.digests(docs_of(rows, CLASHES), keep).collect())
    assert got == brute([(i, (t or "").encode()) for i, t in enumerate(rows)], keep)


def test_pieces_give_the_same_window_starts(monkeypatch):
    """Documents that are cut into pieces own every window start once, under the same anchors."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (9000, 150, 3000, 200, 0, 1999)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(range(6)), pa.array(texts)],
                                       ["id", "doc", "text"])

    def owners():
        out = {}
        for b in q._find(iter([batch])):
            for i, lo, hi, anchor in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                for start in range(lo, hi + 1):
                    assert (i, start) not in out
                    out[i, start] = anchor
        return out
    whole = owners()
    assert set(whole) == {(i, k) for i, t in enumerate(texts) for k in range(len(t.encode()) - 199)}
    for size in (700, 2000):
        monkeypatch.setattr(q, "PIECE", size)
        assert owners() == whole


def test_factors_against_all_pairs():
    rng = np.random.default_rng(5)
    x = rng.choice(np.frombuffer(b"ab", np.uint8), 1500)
    x[900:1250] = x[100:450]
    x[1290:1500] = x[150:360]
    padded = np.concatenate((x, np.zeros(512, np.uint8)))
    starts = np.arange(len(x) - 199)
    got = q.previous_factors(q._ranks(padded), starts, starts) >= 200
    seen, want = set(), []
    for s in starts:
        w = x[s:s + 200].tobytes()
        want.append(w in seen)
        seen.add(w)
    assert got.tolist() == want and any(want)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text.encode()) for r in docs.collect()]
    assert sorted(tuple(r) for r in q.digests(docs).collect()) == brute(rows, "none")


def test_without(docs_of):
    rows = [(2, "ä" * 300), (1, "ä" * 300 + "tail"), (None, None), (3, "short"), (4, " ")]
    docs = docs_of(rows, CLASHES)
    out = q.without(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[None] == (None, 0) and got[3] == ("short", 5) and 2 not in got
    assert got[1][0].endswith("tail") and got[1][1] == len(got[1][0]) < 304
    assert q.without(docs.limit(0)).count() == 0 and q.digests(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(docs_of):
    rows = [(1, "y" + "x" * 250), (1, "y" + "x" * 250), (None, "z" * 210)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in q.digests(docs_of(rows)).collect())
    assert got == [(0, 210), (1, 251), (1, 251)]
    with pytest.raises(ValueError):
        q.digests(docs_of(rows), "last")
