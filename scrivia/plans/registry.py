"""Every registered query of the report engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrivia.sources.tables import applications, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

APP = """WITH app AS (SELECT o_orderkey AS application_id, o_custkey AS participant_id, o_orderpriority AS competition_key,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'judge_in_review' ELSE 'submitted' END AS status,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 END AS judge_id, o_totalprice AS amount, o_orderdate AS updated_at FROM orders)
"""


class Tables:
    """The tables of one size, read on demand: t.orders, and t.app for applications."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return applications(self.spark, self.sf_dir) if name == "app" else table(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Registers a function of Tables under its own name, with its SQL; SQL that reads `app` gets its definition."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = (APP if " app" in sql and not sql.lstrip().startswith("WITH") else "") + sql
        return f

    return add


from scrivia.plans import checks, evaluation, lifecycle, ordered, relational, reports, scalars, search  # noqa: E402, F401
