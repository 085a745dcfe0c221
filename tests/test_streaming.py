"""Streams against batch: several micro-batches, late rows, a second run."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from codeaudit.model import as_findings
from codeaudit.operators import review, scoring
from codeaudit.streaming import jobs


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def found_rows(spark, numbers):
    rows = spark.createDataFrame(
        [(f"r{i % 3}", i, ["high", "low", "medium"][i % 3 - i % 2]) for i in numbers],
        "repo_id string, i long, severity string")
    return as_findings(rows, analyzer="sast", ord=F.col("i"), title=F.col("i").cast("string"),
                       severity=F.col("severity"), category="sast", description="",
                       remediation="", tool="", confidence=0.1 + F.col("i") % 5 / 100)


def test_scores_over_batches(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    found = found_rows(spark, range(90))
    for k in range(3):
        found.filter(F.col("ord") % 3 == k).coalesce(1).write.mode("append").parquet(path)
    jobs.use_rocksdb(spark)
    for run in range(3):  # the second run finds nothing new, the third the same findings once more
        if run == 2:
            found.coalesce(1).write.mode("append").parquet(path)
        jobs.refresh_scores(stream_of(spark, path, found.schema), checkpoint).awaitTermination()
        got = jobs.latest_scores(spark, checkpoint)
        want = scoring.graded(scoring.composite(scoring.group_scores(found)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scores_read_no_history(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = found_rows(spark, [0]).schema
    for k in range(50):
        found_rows(spark, range(k * 6, k * 6 + 6)).coalesce(1).write.mode("append").parquet(path)
    jobs.use_rocksdb(spark)
    query = jobs.refresh_scores(stream_of(spark, path, schema), checkpoint)
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 50 and {p["numInputRows"] for p in batches} == {6}
    parts = [[o for o in p["stateOperators"] if "transformWithState" in o["operatorName"]][0]
             for p in batches]
    assert max(o["numRowsUpdated"] for o in parts) <= 6
    got = jobs.latest_scores(spark, checkpoint)
    want = scoring.graded(scoring.composite(scoring.group_scores(found_rows(spark, range(300)))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_budget_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    calls = spark.createDataFrame([(i % 4, i, 10 + i % 7) for i in range(400)],
                                  "client long, seq long, tokens long")
    for k in range(4):
        (calls.filter((F.col("seq") >= k * 100) & (F.col("seq") < k * 100 + 100))
         .repartition(3).write.parquet(f"{path}/{k}"))
    jobs.use_rocksdb(spark)
    source = (spark.readStream.schema(calls.schema).option("recursiveFileLookup", "true")
              .parquet(path))
    got = jobs.run_to_table(jobs.token_budget(source, 500), str(tmp_path / "out"),
                            str(tmp_path / "cp"))
    want = review.token_budget(calls, 500).drop("used_before")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_budget_files_calls_without_tokens(spark, tmp_path):
    rows = [(1, i, 0 if i % 40 else 9) for i in range(60000)] + [(2, i, 0) for i in range(30000)]
    calls = spark.createDataFrame(rows, "client long, seq long, tokens long")
    path = str(tmp_path / "in")
    for k in (1, 0):  # the later half comes first
        half = F.col("seq") % 2 == k
        calls.filter(half).orderBy(F.desc("seq")).coalesce(1).write.mode("append").parquet(path)
    jobs.use_rocksdb(spark)
    source = spark.readStream.schema(calls.schema).parquet(path)
    got = jobs.run_to_table(jobs.token_budget(source, 4000), str(tmp_path / "out"),
                            str(tmp_path / "cp"))
    want = review.token_budget(calls, 4000).drop("used_before")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_budget_memory_is_flat():
    held = []

    class Map(dict):
        def updateValue(self, k, v): self[k] = v
        def getValue(self, k): return self[k]
        def removeKey(self, k): del self[k]

    class Value:
        def get(self): return None
        def update(self, v): held.append(v)

    job = jobs._Budget(100)
    job.used, job.free = Value(), Map()
    chunks = (pd.DataFrame({"client": 1, "seq": range(k * 10000, k * 10000 + 10000), "tokens": 0})
              for k in range(100))
    sizes = [len(out) for out in job.handleInputRows((1,), chunks, None)]
    assert sum(sizes) == 1000000 and max(sizes) == 10000 and not job.free and held == [(0,)]


def test_gate_drops_late_rows(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    schema = "repo_id string, seen_at timestamp, severity string"
    path = str(tmp_path / "in")
    batches = [[("r", at(1, 5), "high"), ("r", at(1, 10), "low")], [("r", at(5, 0), "critical")],
               [("r", at(1, 20), "high")], [("r", at(9, 0), "high")]]
    gate = None
    for rows in batches:  # a run per arrival, so that the order of batches is certain
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        source = stream_of(spark, path, spark.createDataFrame([], schema).schema)
        gate = jobs.run_to_table(jobs.windowed_gate(source, "high", "1 hour"),
                                 str(tmp_path / "out"), str(tmp_path / "cp"))
    got = gate
    counts = {r.window_start.hour: r.n for r in got.collect()}
    assert counts[1] == 1 and counts[5] == 1 and 9 not in counts


def test_first_seen(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    schema = "repo_id string, id string, seen_at timestamp"
    path = str(tmp_path / "in")
    for rows in ([("r", "a", at), ("r", "b", at)], [("r", "a", at), ("s", "a", at)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    got = jobs.run_to_table(
        jobs.first_seen(stream_of(spark, path, spark.createDataFrame([], schema).schema)),
        str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r.repo_id, r.id) for r in got.collect()} == {("r", "a"), ("r", "b"), ("s", "a")}
    assert got.count() == 3
