"""Batches that the tree's writer gets."""

import re

import pytest

from codeaudit.sources import tree

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_writers_batches_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
    seen = str(tmp_path)

    class Sizes(DataSourceArrowWriter):
        def write(self, batches):
            from pyspark.sql.datasource import WriterCommitMessage
            with open(f"{seen}/sizes", "w") as f:
                f.writelines(f"{b.num_rows} {b.nbytes}\n" for b in batches)
            return WriterCommitMessage()

    class Spy(DataSource):
        @classmethod
        def name(cls):
            return "code_tree"

        def writer(self, schema, overwrite):
            return Sizes()

    monkeypatch.setattr(tree, "CodeTree", Spy)
    before = spark.conf.get(KEY)
    texts = spark.range(40).selectExpr("'r' AS repo_id", "cast(id AS string) AS path", "repeat('word ', 200000) AS content")
    tree.write_tree(texts.coalesce(1), str(tmp_path / "none"))
    spark.dataSource.register(monkeypatch.undo() or tree.CodeTree)
    sizes = [tuple(map(int, line.split())) for line in open(f"{seen}/sizes")]
    assert sum(n for n, _ in sizes) == 40 and max(b for _, b in sizes) <= 8 << 20
    assert spark.conf.get(KEY) == before


def test_a_failed_write_leaves_the_setting(spark, tmp_path):
    before = spark.conf.get(KEY)
    (tmp_path / "file").write_text("x")
    rows = spark.createDataFrame([("r", "a", "x")], "repo_id string, path string, content string")
    with pytest.raises(Exception, match=re.compile("file", re.I)):
        tree.write_tree(rows, str(tmp_path / "file"))
    assert spark.conf.get(KEY) == before
