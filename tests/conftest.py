"""One session for all tests, and how a Spark result is held against DuckDB's."""

from __future__ import annotations

import math
import tempfile
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-checkpoint-"))
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(DATA).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return f"{value:.9g}" if type(value).__name__ == "Decimal" else value


def rows_of(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[c]) for c in names) for r in df.collect())


def rows_of_sql(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
