"""Screenings kept exactly once in a parent table and its children, in folders or a database.

A batch is written under the name of an attempt, table by table, and counts only from the moment a row of the table
``commits`` names that attempt. A batch that fails half-way leaves rows that nobody sees; run again it gets another
attempt; a batch that has been committed is passed over. So a stream's batches may be run any number of times, and parents and
children appear together. One writer a stream; several streams may share the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import settled

COMMITS = "commits"
#: Columns of each table, besides the screening's id; the first is the parent.
TABLES = {
    "screenings": ("created_at", "claimed_nationality", "status", "risk", "category", "verdict", "is_valid"),
    "passport_records": ("passport_number", "passport_name", "passport_dob", "passport_expiry", "passport_nationality", "mrz_ok"),
    "visa_records": ("visa_number", "visa_type", "visa_until", "stay_days"),
    "national_id_records": ("nid_number", "nid_name", "nid_dob"),
    "verification_scores": ("face_score", "photo_score", "metadata_anomaly"),
}
REASONS = "flagged_reasons"


@dataclass(frozen=True)
class Folders:
    """Tables as Parquet folders below a path."""

    path: str

    def append(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{table}")

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        """The table, None where it isn't there yet."""
        try:
            return spark.read.parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error.getCondition()):
                return None
            raise


@dataclass(frozen=True)
class Database:
    """Tables of a database by JDBC; ``commits`` must be there (``prepare``)."""

    url: str
    properties: dict[str, str] = field(default_factory=dict)

    def prepare(self, spark: SparkSession) -> Database:
        """Make the tables that are lacking."""
        self._write(spark.createDataFrame([], _COMMIT), COMMITS, "ignore")
        return self

    def append(self, rows: DataFrame, table: str) -> None:
        self._write(rows, table, "append")

    def _write(self, rows: DataFrame, table: str, mode: str) -> None:
        # columns that are compared: some databases can't compare the type they get otherwise
        types = ", ".join(f"{c} VARCHAR({n})" for c, n in _KEYS.items() if c in rows.columns)
        rows.write.jdbc(self.url, table, mode, self.properties | {"createTableColumnTypes": types})

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        return spark.read.jdbc(self.url, table, properties=self.properties)


_KEYS = {"screening_id": 128, "attempt": 32, "stream": 128}
Store = Folders | Database
_COMMIT = "stream string, batch long, attempt string"


def parts(assessed: DataFrame) -> dict[str, DataFrame]:
    """The parent and child tables of assessed screenings; reasons stand one a row, in order from 0."""
    out = {table: assessed.select("screening_id", *columns) for table, columns in TABLES.items()}
    out[REASONS] = assessed.select("screening_id", F.posexplode("reasons").alias("ordinal", "reason"))
    return out


def _committed(spark: SparkSession, store: Store) -> DataFrame:
    found = store.read(spark, COMMITS)
    return spark.createDataFrame([], _COMMIT) if found is None else found.toDF("stream", "batch", "attempt")


def persist(assessed: DataFrame, batch: int, store: Store, stream: str = "screenings", cut: Callable[[DataFrame], dict[str, DataFrame]] = parts) -> bool:
    """Write a batch unless it has been written; True if it was written now."""
    spark = assessed.sparkSession
    if not _committed(spark, store).where((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    for table, rows in cut(settled(assessed, "batch")).items():
        store.append(rows.withColumn("attempt", F.lit(attempt)), table)
    store.append(spark.createDataFrame([(stream, batch, attempt)], _COMMIT).coalesce(1), COMMITS)
    return True


def sink(store: Store, stream: str = "screenings", prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch, as ``prepare`` makes it, is kept exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        persist(prepare(batch) if prepare else batch, number, store, stream)

    return write


def visible(spark: SparkSession, store: Store, table: str) -> DataFrame:
    """The rows of a table whose batch is committed."""
    rows = store.read(spark, table)
    if rows is None:
        raise ValueError(f"{table} has not been written yet")
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    return rows.join(_committed(spark, store).select("attempt"), "attempt", "left_semi").drop("attempt")
