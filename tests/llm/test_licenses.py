"""License scan against containment at every place."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import CLASHES, SF

from codeaudit.llm import licenses as q
from codeaudit.llm.license_texts import LICENSES


def grams(text):
    w = re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in text)).split()
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute(rows):
    """(id, license) whose windows of 1.25 times the template hold enough of it."""
    out, own = set(), {n: set(grams(t)) for n, t in LICENSES.items()}
    for d, text in rows:
        s = grams(text or "")
        for name, t in own.items():
            if len(t & set(s)) >= q.LEAST * len(t):
                wide = len(t) + len(t) // 4
                if any(len(t & set(s[i:i + wide])) >= q.LEAST * len(t) for i in range(max(1, len(s) - wide + 1))):
                    out.add((d, name))
    return out


def made():
    rng, rows = random.Random(2), []
    filler = lambda n: " ".join(rng.choice(["the", "of", "license", "under", "this", "work", "is", "software", "né"])
                                for _ in range(n))
    for k, (name, text) in enumerate(list(LICENSES.items()) * 4):
        w = text.split()
        for _ in range(k // len(LICENSES)):  # whole first, then with one, two, three words changed
            w[rng.randrange(len(w))] = "zzz"
        rows.append((k, f"{filler(rng.randint(0, 90))} {' '.join(w)} {filler(rng.randint(0, 90))}"))
    whole = list(LICENSES.values())
    return rows + [(900, " ".join(whole)), (901, whole[6].upper().replace(" ", "\n * ")), (902, None), (903, ""),
                   (904, "licensed under the"), (905, filler(3000)), (None, whole[0]), (907, whole[0]), (907, whole[0])]


def test_made_texts(docs_of):
    rows = made()
    docs = docs_of(rows, CLASHES)
    got = q.licenses(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == brute(rows)
    assert sum(r.doc_id == 907 and r.license == "mit-line" for r in got) == 2
    texts = dict(rows)
    for r in got:
        words = re.sub("[^a-z0-9]+", " ", (texts[r.doc_id] or "").lower()).split()
        part = words[r.first_word:r.first_word + r.n_words]
        own = set(grams(LICENSES[r.license]))
        assert len(own & {tuple(part[i:i + 5]) for i in range(len(part) - 4)}) == round(r.containment * len(own))
    assert q.licenses(docs.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert want and {(r.doc_id, r.license) for r in q.licenses(docs).collect()} == want


def test_band_settings():
    """The promised collision probability holds for a window with the least similarity."""
    assert 1 - (1 - q.LEAST / (1 + 1.5 - q.LEAST)) ** q.BANDS > 0.99999
    t = q.Templates(LICENSES)
    for n in t.groups:
        length, step = t.window(n)
        assert length >= n + n // 4 and length <= 1.5 * n + 1 and step >= 1
    with pytest.raises(ValueError):
        q.Templates({"short": "only four words here"})


def test_windows_keep_to_their_document():
    h, ends = q.shingles(pa.array(["a b c d e f", "g h", "", "a b c d e"]))
    assert ends.tolist() == [6, 8, 9, 14] or ends.tolist() == [6, 8, 8, 13]
    assert (h != np.uint64(0xFFFFFFFFFFFFFFFF)).sum() == 3
