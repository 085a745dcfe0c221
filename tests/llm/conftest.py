import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or (doc_id, text[, source]) rows, with columns whose names
    operators use inside."""
    def make(rows, extra=()):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else tuple(r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""),
                         *(["x"] * len(extra))))
        return spark.createDataFrame(full, DOCS + "".join(f", `{c}` string" for c in extra))
    return make
