"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeaudit.llm import (
    lattice_lm, licenses, line_dedup, mixing, packing, quality_rules, repair, rp_forest, simhash,
    suffix_dedup, tool_calls, url_rules, word_runs,
)
from codeaudit.sources.work import stored

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                only=["doc_id"])
    return rows.select("_d.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept", "score", "threshold")


@query("op8_url_filter", url_rules.judge_sql())
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


@query("op9_simhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_suffix_dedup")
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query("op1_packing")
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.tokenised(table(spark, sf_dir, "documents")))


@query("op4_lattice_lm")
def likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scored(table(spark, sf_dir, "documents"))


@query("op5_mixing", mixing.plan_sql())
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(mixing.narrow(table(spark, sf_dir, "documents")), "narrow")
    return mixing.plan(rows, mixing.quotas(rows))


@query("op7_rp_forest")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.neighbours(table(spark, sf_dir, "embeddings"), every=20)


@query("op10_license_scan")
def licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


@query("op3_tool_calls", tool_calls.linked_sql())
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked(tool_calls.derived_messages(table(spark, sf_dir, "conversations")),
                             tool_calls.tool_table(spark))


@query("op11_repair", repair.repair_sql())
def conversations_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.digests(*repair.repaired(repair.damaged(rows)), rows)


@query("op12_word_runs", word_runs.runs_sql())
def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digests(word_runs.collapsed(table(spark, sf_dir, "documents"), word_runs.damaged()))


@query("op13_line_dedup", line_dedup.lines_sql())
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.deduplicated(table(spark, sf_dir, "documents")))
