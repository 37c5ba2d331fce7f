"""The review queue as a clustered table: pages by key or number that read a few row groups, numbers found by Bloom filter.

Screenings lie by status, newest first, then by id, in files and row groups that follow this order, so the
least and largest time of a row group tell whether a page can touch it. Beside them lies an index of the number of
rows of each status and day, from which the days that a page falls in are known before the table is read; it grows with
days, not with screenings. Passport and national id numbers bear Parquet Bloom filters.

A page's key is the (created_at, screening_id) of the last row of the page before. Rows without created_at come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLAGGED = ("FLAGGED_FOR_ADMIN", "SUSPICIOUS")
NUMBERS = ("passport_number", "nid_number")
#: Bytes of a row group, small enough that a page reads little.
ROW_GROUP = 8 << 20
#: created_at in microseconds: row groups know the range of whole numbers, however the session writes timestamps.
_AT, _DAY = "created_us", 86_400_000_000


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def write_queue(screenings: DataFrame, path: str, numbers: tuple[str, ...] = NUMBERS, files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Write the table and its index below ``path``, over what is there."""
    spark = screenings.sparkSession
    key = [F.col("status"), F.col(_AT).desc_nulls_last(), F.col("screening_id")]
    timed = screenings.withColumn(_AT, _micros(F.col("created_at")))
    placed = timed.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)
    writer = placed.write.mode("overwrite").option("parquet.block.size", row_group).partitionBy("status")
    for number in numbers:
        writer = writer.option(f"parquet.bloom.filter.enabled#{number}", "true")
    writer.parquet(f"{path}/screenings")
    counts = _rows(spark, path).groupBy("status", F.floor(F.col(_AT) / _DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/days")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/screenings")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).drop(_AT)


def _days(spark: SparkSession, path: str, statuses: tuple[str, ...]) -> DataFrame:
    """day, n, before (rows of newer days) of the flagged rows, newest first."""
    days = spark.read.parquet(f"{path}/days").where(F.col("status").isin(*statuses)).groupBy("day").agg(F.sum("n").alias("n"))
    upto = Window.orderBy(F.col("day").desc_nulls_last())  # one row a day
    return days.withColumn("before", F.sum("n").over(upto) - F.col("n"))


def _within(rows: DataFrame, newest: int | None, oldest: int | None) -> DataFrame:
    """Rows of the days between the two, both included; no day stands for the rows without a time, which come last."""
    if newest is None:
        return rows.where(F.col(_AT).isNull())
    until = F.col(_AT) < (newest + 1) * _DAY
    return rows.where(until | F.col(_AT).isNull() if oldest is None else until & (F.col(_AT) >= oldest * _DAY))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col(_AT).desc_nulls_last(), "screening_id").drop(_AT)


def page_by_number(spark: SparkSession, path: str, page: int, size: int = 20, statuses: tuple[str, ...] = FLAGGED) -> DataFrame:
    """Page ``page`` (from 0), of the flagged rows in order; only its days are read."""
    queue, first = _rows(spark, path).where(F.col("status").isin(*statuses)), page * size
    span = _days(spark, path, statuses).where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first))
    ends = span.agg(F.max_by("day", "before"), F.min_by("day", "before"), F.min("before")).first()
    if ends[2] is None:
        return queue.drop(_AT).limit(0)
    return _sorted(_within(queue, ends[1], ends[0])).offset(first - ends[2]).limit(size)


def page_after(spark: SparkSession, path: str, created_at, screening_id, size: int = 20, statuses: tuple[str, ...] = FLAGGED) -> DataFrame:
    """The ``size`` rows that follow the row with this key, whether or not that is still there."""
    queue = _rows(spark, path).where(F.col("status").isin(*statuses))
    number = F.lit(screening_id)
    if created_at is None:
        return _sorted(queue.where(F.col(_AT).isNull() & (F.col("screening_id") > number))).limit(size)
    time = spark.range(1).select(_micros(F.lit(created_at))).first()[0]
    day, days = time // _DAY, _days(spark, path, statuses)
    seen = days.where(F.col("day") >= day).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    enough = days.where(F.col("before") + F.col("n") >= seen + size).agg(F.min("before"), F.min_by("day", "before")).first()
    after = (F.col(_AT) < time) | ((F.col(_AT) == time) & (F.col("screening_id") > number))
    rows = _within(queue, day, enough[1])  # without enough days all the rest is read, rows without a time included
    return _sorted(rows.where(after | F.col(_AT).isNull())).limit(size)


def by_number(spark: SparkSession, path: str, number: str, column: str = "passport_number") -> DataFrame:
    """Screenings that bear a number, of any status; row groups whose filter lacks it are not read."""
    return read_queue(spark, path).where(F.col(column) == number)
