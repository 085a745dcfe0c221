"""Lattice likelihood against an enumeration of all segmentations, and its sums."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import CLASHES, SF

from codeaudit.llm import lattice_lm as q


def marginal(word, logp):
    """log-sum over all segmentations, one by one."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(word[at:i + 1])
                at = i + 1
        if all(p in logp for p in parts):
            total += math.exp(sum(logp[p] for p in parts))
    return math.log(total)


def test_forward_sums_all_segmentations():
    pieces, logp = q.vocabulary()
    assert np.exp(logp).sum() == pytest.approx(1)
    lattice, by = q.Lattice(pieces, logp), dict(zip(pieces, logp))
    words = [b"the", b"ation", "ñé".encode(), b"x", b"\xff\xfe", b"there", b"thnting"]
    for some, matrix in q._by_length(words):
        got = lattice.forward(len(some), lattice.edges(matrix))[-1]
        for i, g in zip(some, got):
            assert g == pytest.approx(marginal(b" " + words[i], by))


def test_expected_counts_are_posteriors():
    pieces, logp = q.vocabulary()
    lattice, by, word = q.Lattice(pieces, logp), dict(zip(pieces, logp)), b" tion"
    (_, matrix), = q._by_length([word[1:]])
    got = lattice.expected(1, lattice.edges(matrix), np.array([3.0]))
    bytes_covered = sum(n * len(p) for n, p in zip(got, pieces))
    assert bytes_covered == pytest.approx(3 * len(word))
    whole = math.exp(by[word] - marginal(word, by)) if word in by else 0.0
    assert got[pieces.index(word)] == pytest.approx(3 * whole) if word in by else True


def base(texts):
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, (_, t) in enumerate(texts)}
    held = {i: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for i, (d, _) in enumerate(texts)}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(texts[i][0], held[i], len(ws), sum(c[w] > 0 for w in ws), n,
             sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in ws)) for i, ws in tokens.items()]


def same(rows, texts):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r)[:6] for r in rows), key=key), sorted(base(texts), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = q.scored(docs).collect()
    same(rows, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    per_token = sum(r.lattice_score for r in held) / sum(r.n_tokens for r in held)
    flat = q.scored(docs, rounds=0).collect()
    assert per_token > sum(r.lattice_score for r in flat if r.held_out) / sum(r.n_tokens for r in held) + 1
    assert sum(r.score for r in held) > sum(r.lattice_score for r in held)
    assert all(r.score < 0 for r in rows)


@pytest.mark.parametrize("frequent", [2, 1000])
def test_edges_are_the_same_with_any_number_of_frequent_words(docs_of, monkeypatch, frequent):
    monkeypatch.setattr(q, "FREQUENT", frequent)
    rows = [(i, t) for i, t in enumerate(["A b a", None, "", " \n", "a a c", "zz " * 50, "y" * 5000, "é ß", "new words here"])]
    rows += [(None, "no id"), (2, "a"), (2, "a")]
    got = q.scored(docs_of(rows, CLASHES)).collect()
    same(got, rows)
    assert all(math.isfinite(r.score) for r in got)
    assert q.scored(docs_of(rows).limit(0)).count() == 0


def test_words_and_end_sum_to_one(docs_of):
    """Weights of one-byte words with one-byte pieces: whole and spelled ways add up."""
    got = q.scored(docs_of([(0, "a b"), (2, "a")])).collect()
    assert 0 < sum(10 ** r.score for r in got) < 1
