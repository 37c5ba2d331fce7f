"""Submissions as they arrive, exactly-once tables and the clustered queue."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from idlattice.operators import screening
from idlattice.sources import persist, queue
from idlattice.streaming import submissions

ARRIVAL = "screening_id string, kind string, arrived_at timestamp, document string"
START = dt.datetime(2024, 1, 1)


def minutes(n):
    return START + dt.timedelta(minutes=n)


def arrivals(seed, n=60):
    """Whole, lacking, late and repeated submissions in random order."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        for kind in submissions.KINDS:
            if rng.random() < 0.06:
                continue
            at = k * 5 + rng.choice((0, 3, 7, 59, 61, 300, 2000))
            rows.append((f"s{k}", kind, minutes(at), '{"n":%d}' % at))
            if rng.random() < 0.3:
                rows.append((f"s{k}", kind, minutes(at + rng.choice((0, 5, 100))), '{"n":-1}'))
    rng.shuffle(rows)
    return rows


def expected(rows, wait=60, keep=1440):
    """The rows told, from the rules read one by one."""
    out = []
    for key in {r[0] for r in rows}:
        first = {}
        for kind in submissions.KINDS:
            mine = sorted((r[2], r[3]) for r in rows if r[0] == key and r[1] == kind)
            if mine:
                first[kind] = mine[0]
        begun = min(t for t, _ in first.values())
        deadline = begun + dt.timedelta(minutes=wait)
        last = max(t for t, _ in first.values()) if len(first) == 5 else None

        def told(at, status, first=first, key=key, begun=begun):
            here = {k: d for k, (t, d) in first.items() if t <= at}
            out.append((key, status, [k for k in submissions.KINDS if k not in here], at, begun, *[here.get(k) for k in submissions.KINDS]))

        if last is not None and last <= deadline:
            told(last, "complete")
        else:
            told(deadline, "incomplete")
            if last is not None and last <= deadline + dt.timedelta(minutes=keep):
                told(last, "completed_late")
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.screening_id, r.status, r.missing, r.told_at, r.first_at, *[r[k] for k in submissions.KINDS]) for r in df.collect()), key=str)


def add(spark, rows, folder):
    spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, folder, out, state, **options):
    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(str(folder))
    tracked = submissions.track(stream, "60 minutes", "1440 minutes", **options)
    tracked.writeStream.option("checkpointLocation", str(state)).trigger(availableNow=True).format("parquet").option("path", str(out)).start().awaitTermination()
    return spark.read.parquet(str(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_restarted_from_its_checkpoint(spark, tmp_path, seed):
    """Arrivals in three runs, each of some files; what is told in all equals what the table says."""
    rows = arrivals(seed)
    parts = [rows[k::5] for k in range(5)]
    for part in parts[:2]:
        add(spark, part, tmp_path / "in")
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", late="20 days")
    for part in parts[2:]:
        add(spark, part, tmp_path / "in")
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", late="20 days")
    add(spark, [(None, submissions.HEARTBEAT, minutes(60 * 24 * 60), None), (None, "claim", START, "{}"), ("s1", "letter", START, "{}")], tmp_path / "in")
    told = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", late="20 days")
    assert rows_of(told) == expected(rows)
    odd = spark.createDataFrame([*rows, (None, "claim", START, "{}"), ("s1", "letter", START, "{}"), ("s1", "visa", None, "{}")], ARRIVAL)
    assert rows_of(submissions.tracked_whole(odd, "60 minutes", "1440 minutes")) == expected(rows)


def test_nothing_is_told_before_its_time(spark, tmp_path):
    whole = [("a", kind, minutes(0), "{}") for kind in submissions.KINDS]
    add(spark, [*whole, ("b", "claim", minutes(10), None), ("c", "claim", minutes(30), "{}")], tmp_path / "in")
    told = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", late="20 minutes")
    assert [(r.screening_id, r.status) for r in told.collect()] == [("a", "complete")]  # the watermark stands at 10
    add(spark, [("c", "passport", minutes(91), "{}")], tmp_path / "in")  # 71 passes b's deadline, not c's
    told = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", late="20 minutes")
    assert {(r.screening_id, r.status) for r in told.collect()} == {("a", "complete"), ("b", "incomplete")}
    assert [r.claim for r in told.where("screening_id = 'b'").collect()] == ["{}"]
    # a document that comes too late for the watermark is dropped, repeats of told ones are swallowed
    add(spark, [("b", kind, minutes(20), "{}") for kind in submissions.KINDS] + [("a", "visa", minutes(95), "{}")], tmp_path / "in")
    add(spark, [(None, submissions.HEARTBEAT, minutes(400), None)], tmp_path / "in")
    told = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", late="20 minutes")
    assert sorted((r.screening_id, r.status) for r in told.collect()) == [("a", "complete"), ("b", "incomplete"), ("c", "incomplete")]


def test_state_is_held_by_buckets(spark, tmp_path):
    """Python is called for a bucket and not for each screening; what is told is the same."""
    rows = arrivals(3, 200)
    for k in range(2):
        add(spark, rows[k::2], tmp_path / "in")
    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tracked = submissions.track(stream, "60 minutes", "1440 minutes", "20 days", buckets=5)
    query = tracked.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 5
    add(spark, [(None, submissions.HEARTBEAT, minutes(60 * 24 * 60), None)], tmp_path / "in")
    assert rows_of(run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", late="20 days", buckets=5)) == expected(rows)


def test_submissions_of_buckets_are_read_back(spark, tmp_path):
    """The complete ones of a stream, in few groups, equal those of the table."""
    rows = arrivals(4, 120)
    add(spark, rows, tmp_path / "in")
    add(spark, [(None, submissions.HEARTBEAT, minutes(60 * 24 * 60), None)], tmp_path / "in")
    told = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state", late="20 days", buckets=3)
    whole = submissions.tracked_whole(spark.createDataFrame(rows, ARRIVAL), "60 minutes", "1440 minutes")
    read = [sorted(r.screening_id for r in submissions.submitted(x, dict.fromkeys(submissions.KINDS, "n int")).select("screening_id").collect()) for x in (told, whole)]
    assert read[0] == read[1] and len(read[0]) > 20


def test_documents_read_back(spark):
    rows = [("a", k, START, d) for k, d in zip(submissions.KINDS, ('{"created_at":"2024-01-01T00:00:00","claimed_nationality":"UTO"}', '{"passport_number":"P1"}', '{"stay_days":3}', '{"id_number":"N1"}', '{"path":"x.png"}'), strict=True)]
    schemas = {"claim": "created_at timestamp_ntz, claimed_nationality string", "passport": "passport_number string", "visa": "stay_days int", "national_id": "id_number string", "portrait": "path string"}
    out = submissions.submitted(submissions.tracked_whole(spark.createDataFrame([*rows, ("b", "claim", START, "{}")], ARRIVAL)), schemas).collect()
    assert len(out) == 1 and (out[0].claimed_nationality, out[0].passport.passport_number, out[0].visa.stay_days, out[0].national_id.id_number) == ("UTO", "P1", 3, "N1")


# --- exactly once -----------------------------------------------------------------------------


def assessed(spark, ids):
    base = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "screening_id string, n int")
    rows = base.selectExpr("screening_id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, n div 3) as created_at", "'UTO' as claimed_nationality", "'P' || n as passport_number", "'ANNA' as passport_name", "date '1990-01-01' as passport_dob", "date '2020-01-01' as passport_expiry", "'UTO' as passport_nationality", "true as mrz_ok", "'V' || n as visa_number", "'TOURIST' as visa_type", "date '2030-01-01' as visa_until", "n as stay_days", "'N' || n as nid_number", "'Anna' as nid_name", "date '1990-01-01' as nid_dob", "0.1 * (n % 10) as face_score", "n", "0.9 as photo_score", "n % 2 = 0 as metadata_anomaly", "cast(array() as array<string>) as anomalies")
    return screening.assess(screening.validate(rows, "2024-06-01"))


def counts(spark, store):
    return {table: persist.visible(spark, store, table).count() for table in (*persist.TABLES, persist.REASONS)}


def stores(spark, tmp_path):
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    return persist.Folders(str(tmp_path / "tables")), persist.Database(f"jdbc:derby:{tmp_path}/derby;create=true", driver).prepare(spark)


@pytest.mark.parametrize("kind", [0, 1])
def test_a_batch_is_kept_once(spark, tmp_path, kind):
    store = stores(spark, tmp_path)[kind]
    rows = assessed(spark, ["a", "b", "c"])
    reasons = rows.selectExpr("sum(size(reasons))").first()[0]
    assert persist.persist(rows, 7, store) and not persist.persist(rows, 7, store)
    assert persist.persist(rows.limit(0), 8, store)
    assert counts(spark, store) == dict.fromkeys(persist.TABLES, 3) | {persist.REASONS: reasons}
    assert persist.persist(assessed(spark, ["d"]), 7, store, "another stream")
    parents = {r.screening_id for r in persist.visible(spark, store, "screenings").collect()}
    assert parents == {"a", "b", "c", "d"} == {r.screening_id for r in persist.visible(spark, store, persist.REASONS).collect()}


@pytest.mark.parametrize("kind", [0, 1])
def test_half_a_batch_is_never_seen(spark, tmp_path, kind):
    store, rows = stores(spark, tmp_path)[kind], assessed(spark, ["a", "b"])

    def breaking(df):
        yes = persist.parts(df)
        yes["visa_records"] = yes["visa_records"].withColumn("visa_type", F.raise_error(F.lit("the disk is full")).cast("string"))
        return yes

    persist.persist(assessed(spark, ["z"]), 0, store)
    with pytest.raises(Exception, match="the disk is full"):
        persist.persist(rows, 1, store, cut=breaking)
    assert {x for t in (*persist.TABLES, persist.REASONS) for x in {r.screening_id for r in persist.visible(spark, store, t).collect()}} == {"z"}
    persist.persist(rows, 1, store)
    assert set(counts(spark, store).values()) >= {3} and persist.visible(spark, store, "passport_records").count() == 3


def test_stream_into_tables(spark, tmp_path):
    """Batches of a stream that are run again after a lost checkpoint commit repeat nothing."""
    assessed(spark, [f"s{k}" for k in range(20)]).repartition(4).write.parquet(str(tmp_path / "in"))
    store = persist.Folders(str(tmp_path / "tables"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for state in ("one", "two"):  # the second stream begins anew and gives the same batch numbers
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).foreachBatch(persist.sink(store)).start().awaitTermination()
    assert persist.visible(spark, store, "screenings").count() == 20


# --- queue ------------------------------------------------------------------------------------


def read_rows(df):
    """Rows that the scan of a Parquet table gave on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan).collectLeaves()
    return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()) if "Scan" in leaves.apply(k).nodeName())


def test_pages_of_the_queue(spark, tmp_path):
    ids = [f"{k:05d}" for k in range(3000)]
    random.Random(2).shuffle(ids)
    rows = assessed(spark, ids).withColumn("created_at", F.when(F.col("n") % 500 != 0, F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, n div 60, n % 5)")))
    queue.write_queue(rows, str(tmp_path / "q"), files=6, row_group=4096)
    whole = rows.where(F.col("status").isin(*queue.FLAGGED)).orderBy(F.col("created_at").desc_nulls_last(), "screening_id").select("created_at", "screening_id").collect()
    assert len(whole) > 1000
    for page in (0, 1, 7, len(whole) // 20, len(whole) // 20 + 1):
        mine = queue.page_by_number(spark, str(tmp_path / "q"), page)
        assert [tuple(r) for r in mine.select("created_at", "screening_id").collect()] == [tuple(r) for r in whole[page * 20 : page * 20 + 20]]
    for k in range(19, len(whole) - 1, 331):  # ties of many rows a second; the rows without a time at the end
        mine = queue.page_after(spark, str(tmp_path / "q"), *whole[k]).select("created_at", "screening_id").collect()
        assert [tuple(r) for r in mine] == [tuple(r) for r in whole[k + 1 : k + 21]]
    last = whole[-3]
    assert [tuple(r) for r in queue.page_after(spark, str(tmp_path / "q"), *last).select("created_at", "screening_id").collect()] == [tuple(r) for r in whole[-2:]]


def test_a_page_reads_little(spark, tmp_path):
    rows = assessed(spark, [f"{k:05d}" for k in range(20_000)]).withColumn("created_at", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, n div 50)"))
    queue.write_queue(rows, str(tmp_path / "q"), files=4, row_group=16_384)
    flagged = rows.where(F.col("status").isin(*queue.FLAGGED)).count()
    middle = rows.where(F.col("status").isin(*queue.FLAGGED)).orderBy(F.col("created_at").desc()).offset(flagged // 2).first()
    assert read_rows(queue.page_by_number(spark, str(tmp_path / "q"), flagged // 40)) < flagged / 4
    assert read_rows(queue.page_after(spark, str(tmp_path / "q"), middle.created_at, middle.screening_id)) < flagged / 4
    assert queue.by_number(spark, str(tmp_path / "q"), "P777").count() == 1
    assert read_rows(queue.by_number(spark, str(tmp_path / "q"), "P777")) < 20_000 / 4
    assert read_rows(queue.by_number(spark, str(tmp_path / "q"), "N31", "nid_number")) < 20_000 / 4
