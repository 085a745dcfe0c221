"""Verdicts: which reply decides, and for which finding."""

import pytest
from pyspark.sql import functions as F

from codeaudit.model import FINDING_SCHEMA, finding_key
from codeaudit.operators import review

HARMLESS, SURE = '{"is_vulnerable": false}', '{"is_vulnerable": true, "confidence": 0.9}'


def findings(spark, *rows):
    """(id, title) as findings."""
    full = [{f.name: None for f in FINDING_SCHEMA} | {"repo_id": "r", "id": i, "title": t, "confidence": 0.6}
            for i, t in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in FINDING_SCHEMA) for r in full], FINDING_SCHEMA)


@pytest.mark.parametrize("by", ["id", "key"])
def test_readable_reply_decides(spark, by):
    found = findings(spark, ("VA-1", "a"), ("VA-2", "b"))
    key = finding_key() if by == "key" else F.col("id")
    bodies = F.explode(F.array(F.lit("Here is none"), F.when(F.col("title") == "a", HARMLESS).otherwise(SURE),
                               F.lit(None)))
    got = review.apply_verdicts(found, found.select(key.alias(by), bodies.alias("body")))
    assert [(r.title, r.confidence) for r in got.collect()] == [("b", 0.9)]
    assert got.columns == found.columns


def test_findings_that_share_an_id(spark):
    found = findings(spark, ("VA-1", "a"), ("VA-1", "b"), ("VA-2", "c"))
    keyed = found.filter("title = 'a'").select(finding_key().alias("key"), F.lit(HARMLESS).alias("body"))
    assert sorted(r.title for r in review.apply_verdicts(found, keyed).collect()) == ["b", "c"]
    by_id = spark.createDataFrame([("VA-1", HARMLESS), ("VA-2", HARMLESS)], "id string, body string")
    assert sorted(r.title for r in review.apply_verdicts(found, by_id).collect()) == ["a", "b"]
