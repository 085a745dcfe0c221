"""Tables written between jobs into the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def _own_dir() -> str:
    """One temporary folder per local session, removed when the program ends."""
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="codeaudit-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only a local session may do without the
    setting and gets a temporary folder; on a cluster that would be lost with its machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what several later steps read is computed once, and a
    lost executor costs no recomputation of the scan behind it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
