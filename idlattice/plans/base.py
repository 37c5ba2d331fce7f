"""Where queries are registered, each over one derived input or plain table, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import SQL, source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, input_name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over one derived input; in its SQL {src} stands for that input."""
    QUERIES[name] = lambda spark, sf_dir: make(source(spark, sf_dir, input_name))
    if sql is not None:
        ORACLE_SQL[name] = sql.replace("{src}", f"({SQL[input_name]}) src")


def register_table(name: str, make: Callable[[DataFrame], DataFrame], table: str, sql: str | None = None) -> None:
    """A query over a plain table."""
    QUERIES[name] = lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if sql is not None:
        ORACLE_SQL[name] = sql


def register_many(name: str, inputs: tuple[str, ...], make: Callable[..., DataFrame], sql: str | None = None) -> None:
    """A query over several derived inputs; in its SQL {src0}, {src1} ... stand for them."""
    QUERIES[name] = lambda spark, sf_dir: make(*[source(spark, sf_dir, i) for i in inputs])
    if sql is not None:
        for k, i in enumerate(inputs):
            sql = sql.replace(f"{{src{k}}}", f"({SQL[i]}) src{k}")
        ORACLE_SQL[name] = sql
