"""Compare registered queries with their SQL: python tests/compare.py [sf_dir] [name prefix ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from codeaudit.plans.catalog import ORACLE, QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cpus: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("codeaudit")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str,
                name: str) -> tuple[list[str], int]:
    """What differs between the two engines (nothing: an empty list), and the row count."""
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in ORACLE:
        return ([] if got else ["no rows"]), len(got)
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return [f"columns {sorted(names)} vs {cols}"], len(got)
    at = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    a, b = sorted(map(repr, got)), sorted(map(repr, want))
    if a == b:
        return [], len(got)
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return [f"rows {len(a)} vs {len(b)}", *[f"spark {x[:600]}" for x in sorted(only_a)[:4]],
            *[f"sql   {x[:600]}" for x in sorted(only_b)[:4]]], len(got)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, bad = session(), duck(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in QUERIES:
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            diff, n = differences(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            diff, n = [f"{type(e).__name__}: {str(e)[:1500]}"], -1
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} rows={n} {time.time() - t:.1f}s"
              f"{'' if name in ORACLE else ' (rows only)'}", *diff, sep="\n    ", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
