"""Queries over submissions as they arrive: the stream with its state, exactly-once tables, the clustered queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records, screening
from ..sources import persist, queue
from ..sources.tables import fresh_path
from ..streaming import events, submissions
from .base import ORACLE_SQL, register

AS_OF = "2024-06-01"
_DAY = "2024-03-01"
_WAIT = 60
_KEEP = 1440
SCHEMAS = {
    "claim": "created_at timestamp_ntz, claimed_nationality string",
    "passport": "passport_number string, full_name string, date_of_birth date, expiry_date date, nationality string, mrz_ok boolean",
    "visa": "visa_number string, visa_text string, valid_until date, stay_days int",
    "national_id": "id_number string, full_name string, date_of_birth date",
    "portrait": "path string",
}


def _minute(kind: int) -> str:
    """Minutes into the day at which a screening's document of a kind arrives; some visas come hours later."""
    late = " + case when k % 11 = 0 then 240 when k % 13 = 0 then 2000 else 0 end" if submissions.KINDS[kind] == "visa" else ""
    return f"k % 1440 + (k * 7 + {31 * kind}) % 100{late}"


def _arrivals(d: DataFrame) -> DataFrame:
    """Documents of each screening with the times at which they come, every fifth passport twice; national ids of stays of 7 days never do."""
    key = F.col("screening_id")
    tables = {
        "claim": d.select(key, "created_at", "claimed_nationality"),
        "passport": d.select(key, "passport_number", F.col("passport_name").alias("full_name"), F.col("passport_dob").alias("date_of_birth"), F.col("passport_expiry").alias("expiry_date"), F.col("passport_nationality").alias("nationality"), "mrz_ok"),
        "visa": d.select(key, "visa_number", "visa_text", F.col("visa_until").alias("valid_until"), "stay_days"),
        "national_id": d.where("stay_days <> 7").select(key, F.concat(F.lit("N"), key).alias("id_number"), F.col("nid_name").alias("full_name"), F.col("nid_dob").alias("date_of_birth")),
        "portrait": d.select(key, F.concat(key, F.lit(".png")).alias("path")),
    }
    at = lambda minutes: F.expr(f"timestamp_seconds(unix_seconds(timestamp '{_DAY} 00:00:00') + 60 * ({minutes.replace('k', 'cast(screening_id as bigint)')}))")
    again = tables["passport"].where("cast(screening_id as bigint) % 5 = 0").withColumn("passport_number", F.lit("SECOND"))
    out = submissions.arrivals_of(again, "passport", at(f"{_minute(1)} + 1"))
    for kind, table in tables.items():
        out = out.unionByName(submissions.arrivals_of(table, kind, at(_minute(submissions.KINDS.index(kind)))))
    return out


def _streamed(d: DataFrame) -> DataFrame:
    """The arrivals through a stream of several batches, closed by a heartbeat."""
    spark, folder = d.sparkSession, fresh_path(d.sparkSession, "arrivals")
    arrivals = _arrivals(d)
    arrivals.repartition(4).write.parquet(folder)
    end = spark.createDataFrame([(None, submissions.HEARTBEAT, None)], "screening_id string, kind string, document string")
    end.withColumn("arrived_at", F.expr(f"timestamp '{_DAY} 00:00:00' + interval 30 days")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return events.drain(submissions.track(stream, f"{_WAIT} minutes", f"{_KEEP} minutes", "10 days"), "append")


def _told(tracked: DataFrame) -> DataFrame:
    minute = lambda c: ((F.unix_seconds(c) - F.expr(f"unix_seconds(timestamp '{_DAY} 00:00:00')")) / 60).cast("int").alias(c.removesuffix("_at"))
    return tracked.select("screening_id", "status", F.array_join("missing", ",").alias("missing"), minute("told_at"), minute("first_at"), F.get_json_object("passport", "$.passport_number").alias("passport_number"))


_AT = [_minute(k) if kind != "national_id" else f"case when stay_days <> 7 then {_minute(k)} end" for k, kind in enumerate(submissions.KINDS)]
_TOLD_SQL = f"""
with a as (select screening_id, passport_number, [{', '.join(_AT)}] as ats from (select *, cast(screening_id as bigint) as k from {{src}}) s),
b as (select *, list_min(ats) as first, list_min(ats) + {_WAIT} as deadline, case when len(list_filter(ats, lambda x: x is null)) = 0 then list_max(ats) end as last from a),
c as (
 select *, last as told, 'complete' as status from b where last <= deadline
 union all select *, deadline, 'incomplete' from b where last is null or last > deadline
 union all select *, last, 'completed_late' from b where last > deadline and last <= deadline + {_KEEP})
select screening_id, status, array_to_string([x for x in [{', '.join(f"case when ats[{k + 1}] is null or ats[{k + 1}] > told then '{kind}' end" for k, kind in enumerate(submissions.KINDS))}] if x is not null], ',') as missing,
 cast(told as int) as told, cast(first as int) as first, case when ats[2] <= told then passport_number end as passport_number from c"""
register("submission_stream", "screening_src", lambda d: _told(_streamed(d)), _TOLD_SQL)
register("submission_arrivals", "screening_src", lambda d: _told(submissions.tracked_whole(_arrivals(d), f"{_WAIT} minutes", f"{_KEEP} minutes")), _TOLD_SQL)


def _assessed(d: DataFrame) -> DataFrame:
    rows = d.withColumn("nid_number", F.concat(F.lit("N"), "screening_id")).withColumn("visa_type", screening.visa_type(F.col("visa_text"))).withColumn("anomalies", F.array().cast("array<string>"))
    return screening.assess(screening.validate(rows, AS_OF))


def _stream_verdict(d: DataFrame) -> DataFrame:
    """Complete submissions of the stream, joined with the image checks and assessed."""
    whole = submissions.submitted(_streamed(d), SCHEMAS)
    rows = records.screening_rows(whole, d.select("screening_id", "face_score", "photo_score", "metadata_anomaly"))
    assessed = screening.assess(screening.validate(rows.withColumn("anomalies", F.array().cast("array<string>")), AS_OF))
    return assessed.select("screening_id", "risk", "category", "verdict", "status")


register("submission_stream_verdict", "screening_src", _stream_verdict, f"select v.* from ({ORACLE_SQL['verdict']}) v join ({_TOLD_SQL}) t using (screening_id) where t.status <> 'incomplete'")


def _twice(d: DataFrame) -> tuple:
    """Two batches kept, the first of them twice."""
    store = persist.Folders(fresh_path(d.sparkSession, "kept"))
    rows = _assessed(d)
    for batch in (0, 1, 0):
        persist.persist(rows.where(F.pmod(F.col("screening_id").cast("long"), F.lit(2)) == batch), batch, store)
    return d.sparkSession, store


register("persisted_reasons", "screening_src", lambda d: persist.visible(*_twice(d), persist.REASONS).groupBy("screening_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reason"))), lambda r: r["reason"]), "; ").alias("reasons")), f"select screening_id, reasons from ({ORACLE_SQL['flagged_reasons']}) r where reasons <> ''")
register("persisted_screenings", "screening_src", lambda d: persist.visible(*_twice(d), "screenings").select("screening_id", "risk", "category", "verdict", "status"), ORACLE_SQL["verdict"])


def _queued(d: DataFrame) -> tuple:
    path = fresh_path(d.sparkSession, "queue")
    queue.write_queue(_assessed(d), path)
    return d.sparkSession, path


def _third_page(d: DataFrame) -> DataFrame:
    spark, path = _queued(d)
    last = queue.page_by_number(spark, path, 1).orderBy("created_at", F.col("screening_id").desc()).first()
    return queue.page_after(spark, path, last["created_at"], last["screening_id"]).select("screening_id", "risk", "status", "created_at")


_FLAGGED = ORACLE_SQL["review_queue"]
register("review_queue_after", "screening_src", _third_page, f"{_FLAGGED} offset 40")
register("review_queue_page", "screening_src", lambda d: queue.page_by_number(*_queued(d), 3).select("screening_id", "risk", "status", "created_at"), f"{_FLAGGED} offset 60")
register("find_by_clustered_number", "screening_src", lambda d: queue.by_number(*_queued(d), "P00000007").select("screening_id", "passport_number", "passport_name"), ORACLE_SQL["find_by_passport"])
