"""Run the catalog against its DuckDB SQL: python tests/compare.py [scale] [query ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    values = [
        tuple(None if pd.api.types.is_scalar(v) and pd.isna(v) else v for v in row)
        for row in frame.astype(object).itertuples(index=False)
    ]
    return sorted(values, key=lambda row: tuple((v is not None, str(v)) for v in row))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What tells the two frames apart; None if they hold the same rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for one, other in zip(rows(got), rows(want)):
        if [str(v) for v in one] != [str(v) for v in other]:
            return f"{str(one)[:600]} against {str(other)[:600]}"
    return None


def main() -> None:
    import __spark_entry__ as entry

    scale, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/sf{scale}"
    spark, connection = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
        except Exception as error:
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        middle = time.time()
        if name not in oracle:
            print(f"rows {name}: {len(got)} rows {middle - start:.1f}s", flush=True)
            continue
        try:
            want = connection.execute(oracle[name]).df()
        except Exception as error:
            print(f"SQL  {name}: {str(error)[:700]}", flush=True)
            continue
        try:
            told = difference(got, want)
        except Exception as error:
            told = f"cannot compare: {error}"
        print(
            f"{'DIFF' if told else 'ok  '} {name}: {len(got)} rows, Spark {middle - start:.1f}s, "
            f"DuckDB {time.time() - middle:.1f}s {told or ''}",
            flush=True,
        )
    spark.stop()


if __name__ == "__main__":
    main()
