"""The audit on streams: arriving files, repeat findings, windowed gates, budgets, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from codeaudit.model import SEVERITIES, finding_key, severity_rank
from codeaudit.operators import scoring


IDENTITY = ["repo_id", "id", "analyzer", "ord", "file", "line", "title", "evidence"]


def scan(files: DataFrame, checks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings of arriving files: the batch checks unchanged, as each needs one file's row."""
    return checks(files)


def first_seen(findings: DataFrame, delay: str = "7 days") -> DataFrame:
    """Findings without repeats across pushes: ``findings`` carry ``seen_at``. The displayed id is
    short, so what makes a finding (its check, place, title, evidence) is compared itself. State is
    kept for the watermark delay."""
    return (findings.withWatermark("seen_at", delay)
            .dropDuplicatesWithinWatermark([c for c in IDENTITY if c in findings.columns]))


def windowed_gate(findings: DataFrame, min_severity: str, window: str, slide: str | None = None,
                  delay: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, repo_id, n): findings at or above a severity per window; rows
    later than the watermark are dropped."""
    if min_severity not in SEVERITIES:
        raise ValueError(f"unknown severity {min_severity!r}")
    least = SEVERITIES.index(min_severity) + 1
    span = F.window("seen_at", window, slide) if slide else F.window("seen_at", window)
    return (findings.filter(severity_rank(F.col("severity")) >= least)
            .withWatermark("seen_at", delay).groupBy(span.alias("w"), "repo_id")
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "repo_id", "n"))


class _Budget(StatefulProcessor):
    """One running total per client; the calls of a batch are charged in order of their number.

    Calls come in chunks and in any order. A call that is refused in view of the chunks so far
    stays refused, as further calls before it can only add tokens. Of the others, those with
    tokens are held, no more than fit into the budget; those without tokens, of which any number
    fits, are filed in the state store chunk by chunk and read back one chunk at a time when the
    end of the batch has settled where the budget runs out.
    """

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "used long")
        self.free = handle.getMapState("free", "chunk long", "calls binary")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        state = self.used.get()
        used = state[0] if state else 0
        pending, chunks, cut = None, 0, np.iinfo(np.int64).min if used >= self.budget else None
        for calls in rows:
            costs = calls["tokens"] != 0
            both = calls[costs] if pending is None else pd.concat([pending, calls[costs]])
            both = both.sort_values("seq", kind="stable")
            before = used + both["tokens"].cumsum() - both["tokens"]
            refused = both[before >= self.budget]
            pending = both[before < self.budget]
            if len(pending) and used + int(pending["tokens"].sum()) >= self.budget:
                cut = pending["seq"].iloc[-1]
            free = calls["seq"][~costs].to_numpy()
            late = free > cut if cut is not None else np.zeros(len(free), bool)
            if len(refused):
                yield self._out(key, refused["seq"], refused["tokens"], False)
            if late.any():
                yield self._out(key, free[late], 0, False)
            if not late.all():
                self.free.updateValue((chunks,), (free[~late].astype("<i8").tobytes(),))
                chunks += 1
        for chunk in range(chunks):
            free = np.frombuffer(bytes(self.free.getValue((chunk,))[0]), "<i8")
            self.free.removeKey((chunk,))
            late = free > cut if cut is not None else np.zeros(len(free), bool)
            for which, admitted in ((late, False), (~late, True)):
                if which.any():
                    yield self._out(key, free[which], 0, admitted)
        if pending is not None and len(pending):
            used += int(pending["tokens"].sum())
            yield self._out(key, pending["seq"], pending["tokens"], True)
        self.used.update((used,))

    def _out(self, key, seq, tokens, admitted: bool) -> pd.DataFrame:  # noqa: ANN001
        return pd.DataFrame({"client": key[0], "seq": np.asarray(seq), "tokens": np.asarray(tokens),
                             "admitted": admitted})

    def close(self) -> None:
        pass


def token_budget(calls: DataFrame, budget: int) -> DataFrame:
    """Running budget per client over ``calls(client, seq, tokens)``. Calls of one micro-batch
    are charged in order, one that arrives in a later batch is charged on arrival. The session
    needs the RocksDB state store, see ``use_rocksdb``."""
    schema = "client long, seq long, tokens long, admitted boolean"
    return calls.groupBy("client").transformWithStateInPandas(
        statefulProcessor=_Budget(budget), outputStructType=schema, outputMode="Append",
        timeMode="None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _GroupState(StatefulProcessor):
    """What the score of one part of a group depends on: sum, count and the five dearest findings.
    A batch adds its rows; what it reads and writes is one small value per part it touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", scoring.PART_STATE)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        cost, n, first = self.totals.get() or (0, 0, [])
        first = [tuple(f) for f in first]
        for part in rows:
            best = part[scoring.PART_ORDER].sort_values(scoring.PART_ORDER, kind="stable").head(5)
            first = sorted([*first, *(tuple(r) for r in best.astype(object).to_numpy().tolist())])[:5]
            cost, n = cost + int(part["cost"].sum()), n + len(part)
        self.totals.update((cost, n, first))
        yield pd.DataFrame({"repo_id": [key[0]], "grp": [key[1]], "salt": [key[2]],
                            "n_findings": [n]})

    def close(self) -> None:
        pass


def score_parts(findings: DataFrame, strict_groups: bool = False) -> DataFrame:
    """(repo_id, grp, salt, n_findings) per part that a micro-batch touches.

    A finding that was seen before, by all that makes it, counts once: its full key is kept in the
    state store. A group is dealt into parts, so that a hot one is many keys; parts merge into
    scores in ``latest_scores``. Nothing of earlier batches is read but the state of the keys that
    come up. The session needs the RocksDB state store, see ``use_rocksdb``.
    """
    new = findings.withColumn("_key", finding_key()).dropDuplicates(["_key"])
    schema = "repo_id string, grp string, salt long, n_findings long"
    return (scoring.part_rows(new, strict_groups).groupBy("repo_id", "grp", "salt")
            .transformWithStateInPandas(statefulProcessor=_GroupState(), outputStructType=schema,
                                        outputMode="Append", timeMode="None"))


def refresh_scores(findings: DataFrame, checkpoint: str,
                   strict_groups: bool = False) -> StreamingQuery:
    """Keep scores up to date: the state store below ``checkpoint`` holds them, there is no other
    table to rewrite or to compact. ``latest_scores`` reads it, also while the query runs on."""
    return (score_parts(findings, strict_groups).writeStream.format("noop").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_scores(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Score, grade and verdict of each repository as of the last finished micro-batch."""
    operators = spark.read.format("state-metadata").load(checkpoint)
    number = operators.filter(F.col("operatorName").startswith("transformWithState")).first()[
        "operatorId"]
    parts = (spark.read.format("statestore").option("operatorId", number)
             .option("stateVarName", "totals").load(checkpoint)
             .select("key.repo_id", "key.grp", "value.*"))
    return scoring.graded(scoring.composite(scoring.scores_of(scoring.merge_parts(parts))))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what is available now to a parquet table and read it."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
