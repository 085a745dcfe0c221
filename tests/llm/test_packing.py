"""Packing: token ids against the tokenizer, and every constraint on the bins."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_cases import CLASHES, SF
from tokenizers import Tokenizer

from codeaudit.llm import packing as q

ODD = ["don't we'll I'M x's", "a<|endoftext|>b <|startoftext|>", "İstanbul ΑΣ ﬁ é é x y \u0085 ª º ß ǅ 1²³½ ⅷ",
       "a_b__c '' 's'd 12ab34 _", "日本語 テスト \x1c \x1d a\x00b", "µ· ¸¼ ¾¿ ¡ Ŀ ŉ ſ", None, "", " \n", "word " * 9000, "x" * 3000]


def test_words_equal_the_tokenizer():
    """Every plain character and those next to them, beside letters, digits and itself."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), q.WordIds(path)
    for c in map(chr, [*range(0x21, 0x7f), *range(0xa1, 0x180)]):
        for word in (c, f"a{c}b", f"2{c}in", f"a{c}2", c + c, f"a{c}{c}", f"{c}{c}é", f"½{c}¼", f"{c}_'s"):
            want = tokenizer.encode(word, add_special_tokens=False).ids
            assert np.frombuffer(words.of_word(word), "<u4").tolist() == want, word


def check(rows, texts, capacity=4096):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, k, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes()))
                 for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
                  for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_odd_texts_nulls_and_repeats(docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, ODD[3]), (3, ODD[3])]
    docs = docs_of(rows, CLASHES)
    rows = [(-1 if d is None else d, t) for d, t in rows]
    check(q.packed(q.tokenised(docs)).collect(), rows)
    check(q.packed(q.tokenised(docs, capacity=64), capacity=64, per_group=8).collect(), rows, 64)
    assert q.packed(q.tokenised(docs.limit(0))).count() == 0


@pytest.mark.parametrize("per_group,slack,some", [(q.GROUP, 1.01, 300), (50, 1.06, 1024)])
def test_documents_fill_sequences(spark, monkeypatch, per_group, slack, some):
    monkeypatch.setattr(q, "SLICE", some)
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = q.packed(q.tokenised(docs), per_group=per_group).collect()
    bins, tokens = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert bins <= -(-tokens // 4096) * slack + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(spark, rule):
    rng = np.random.default_rng(2)
    sizes = [int(n) for n in rng.integers(1, 90, 400)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id bigint, length bigint")
    rows = q.packed(pieces, capacity=100, most_documents=4, most_cost=5000.0, rule=rule, per_group=90).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert len(rows) == 400
    for own in bins.values():
        assert len(own) == 1 or (sum(own) <= 100 and len(own) <= 4 and sum(n * n for n in own) <= 5000)


def test_best_fit_takes_the_tightest_open_bin():
    sizes = np.array([[60, 1, 0], [50, 1, 0], [35, 1, 0], [5, 1, 0]], float)
    assert q.best_fit(sizes, np.array([100.0, 9, 1]), np.array([1.0, 0, 0])).tolist() == [0, 1, 0, 0]
    # one document a bin
    assert len(set(q.best_fit(sizes, np.array([100.0, 1, 1]), np.array([1.0, 0, 0])))) == 4
