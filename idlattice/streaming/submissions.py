"""Submissions as they arrive: documents of one screening gathered in state, told when complete or when time is up.

An arrival is a row (screening_id, kind, arrived_at, document): kind names one of ``KINDS``, document holds its
record as JSON. Times are event times, so what comes out depends on the arrivals and not on how they were cut into
batches:

* of several documents of one kind the first to arrive counts, of equal times the smaller text;
* once all kinds are there, at the time of the last, a row ``complete`` follows;
* ``wait`` after the first arrival, if some are missing, a row ``incomplete`` names them; should they come within
  ``keep`` more, a row ``completed_late`` follows at the time of the last;
* ``keep`` after the deadline the state goes; what comes then is a submission of its own.

A row is told when the watermark has passed its time. Documents more than ``late`` behind the newest are dropped
by Spark, which counts them. A source that falls silent needs rows of kind ``HEARTBEAT``: they only move time on.
Rows with a null id, kind or time, or of another kind, are never looked at; a null document counts as an empty record.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("claim", "passport", "visa", "national_id", "portrait")
HEARTBEAT = "heartbeat"
_OUT = "screening_id string, status string, missing array<string>, told_at timestamp, first_at timestamp, " + ", ".join(f"{k} string" for k in KINDS)
_STATE = "held binary"
#: Buckets that screenings are dealt to: a call of Python costs about a millisecond, so it serves a bucket, not a screening.
BUCKETS = 1024


def arrivals_of(table: DataFrame, kind: str, arrived_at: Column) -> DataFrame:
    """Rows of one kind's table (screening_id and its own columns) as arrivals."""
    own = [c for c in table.columns if c != "screening_id"]
    return table.select(F.col("screening_id").cast("string").alias("screening_id"), F.lit(kind).alias("kind"), arrived_at.cast("timestamp").alias("arrived_at"), F.to_json(F.struct(*[f"`{c}`" for c in own])).alias("document"))


class Submission:
    """What has arrived of one screening; times in milliseconds."""

    def __init__(self, wait: int, keep: int, told: bool = False, done: bool = False, at: Iterable[int | None] = (), documents: Iterable[str | None] = ()) -> None:
        self.wait, self.keep, self.told, self.done = wait, keep, told, done
        self.at = list(at) or [None] * len(KINDS)
        self.documents = list(documents) or [None] * len(KINDS)

    def add(self, kind: str, at: int, document: str) -> None:
        k = KINDS.index(kind)
        if not self.done and (self.at[k] is None or (at, document) < (self.at[k], self.documents[k])):
            self.at[k], self.documents[k] = at, document

    @property
    def first(self) -> int:
        return min(x for x in self.at if x is not None)

    @property
    def deadline(self) -> int:
        return self.first + self.wait

    @property
    def end(self) -> int:
        return self.deadline + self.keep

    def next(self) -> tuple[int, str]:
        """The next thing to happen if nothing more arrives: its time and status, "" for the end."""
        last = None if None in self.at else max(self.at)
        if not self.done:
            if not self.told:
                return (last, "complete") if last is not None and last <= self.deadline else (self.deadline, "incomplete")
            if last is not None and last <= self.end:
                return last, "completed_late"
        return self.end, ""

    def tell(self, status: str, time: int) -> dict:
        """The row of a status; the state afterwards knows of it."""
        here = [x is not None and x <= time for x in self.at]
        self.told, self.done = True, status != "incomplete"
        return {"status": status, "missing": [k for k, x in zip(KINDS, here, strict=True) if not x], "told_at": time, "first_at": self.first, **{k: d if x else None for k, d, x in zip(KINDS, self.documents, here, strict=True)}}


def _packed(held: dict[str, tuple]) -> bytes:
    raw = pickle.dumps(held, 4)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> dict[str, tuple]:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def _step(wait: int, keep: int) -> Callable:
    """A bucket's state is a table of its screenings: when the next thing happens to each, and its ``Submission``."""

    def step(key: tuple[int], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = _unpacked(state.get[0]) if state.exists else {}
        touched: dict[str, Submission] = {}
        for frame in frames:
            for name, kind, at, document in zip(*[frame[c].tolist() for c in ("screening_id", "kind", "at", "document")], strict=True):
                if name not in touched:
                    touched[name] = Submission(wait, keep, *held.get(name, (0,))[1:])
                touched[name].add(kind, at, document)
        passed, rows = state.getCurrentWatermarkMs(), []
        for name, (time, *kept) in held.items():
            if time < passed and name not in touched:
                touched[name] = Submission(wait, keep, *kept)
        for name, submission in touched.items():
            time, status = submission.next()
            while time < passed and status:
                rows.append({"screening_id": name, **submission.tell(status, time)})
                time, status = submission.next()
            if time < passed:
                held.pop(name, None)
            else:
                held[name] = (time, submission.told, submission.done, submission.at, submission.documents)
        if held:
            state.update((_packed(held),))
            state.setTimeoutTimestamp(max(min(kept[0] for kept in held.values()), passed + 1))
        elif state.exists:
            state.remove()
        if rows:
            made = pd.DataFrame(rows)
            yield made.assign(**{c: pd.to_datetime(made[c], unit="ms") for c in ("told_at", "first_at")})

    return step


def _known(arrivals: DataFrame) -> DataFrame:
    # one condition that names the time: others would be moved before the watermark, which heartbeats must reach
    return arrivals.where(F.when(F.col("screening_id").isNotNull() & F.col("kind").isin(*KINDS), F.col("arrived_at")).isNotNull())


def _milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def track(arrivals: DataFrame, wait: str = "1 hour", keep: str = "1 day", late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """A stream of arrivals -> screening_id, status, missing, told_at, first_at and the document of each kind.

    buckets: state is held by so many buckets of screenings, each a compressed table; a checkpoint is bound to their number.
    """
    marked = arrivals.withWatermark("arrived_at", late)
    bucket = F.pmod(F.xxhash64("screening_id"), F.lit(buckets)).alias("bucket")
    known = _known(marked).select(bucket, "screening_id", "kind", "arrived_at", F.unix_millis("arrived_at").alias("at"), F.coalesce("document", F.lit("{}")).alias("document"))
    return known.groupBy("bucket").applyInPandasWithState(_step(_milliseconds(wait), _milliseconds(keep)), _OUT, _STATE, "append", "EventTimeTimeout")


def tracked_whole(arrivals: DataFrame, wait: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """What ``track`` tells of a table of arrivals in the end, without a stream; a screening's rows count as one submission."""
    known = _known(arrivals).withColumn("document", F.coalesce("document", F.lit("{}")))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("arrived_at", "document"))).alias(kind)
    held = known.groupBy("screening_id").agg(F.min("arrived_at").alias("first_at"), *[first(k) for k in KINDS])
    span = lambda text: F.expr(f"interval {_milliseconds(text)} milliseconds")
    last = F.when(F.forall(F.array(*[F.col(k).isNotNull() for k in KINDS]), lambda x: x), F.greatest(*[f"{k}.arrived_at" for k in KINDS]))
    timed = held.withColumn("last", last).withColumn("deadline", F.col("first_at") + span(wait)).withColumn("end", F.col("deadline") + span(keep))
    told = lambda time, status: F.struct(F.col(time).alias("told_at"), F.lit(status).alias("status"))
    in_time = F.coalesce(F.col("last") <= F.col("deadline"), F.lit(False))
    rows = F.when(in_time, F.array(told("last", "complete"))).when(F.col("last") <= F.col("end"), F.array(told("deadline", "incomplete"), told("last", "completed_late"))).otherwise(F.array(told("deadline", "incomplete")))
    each = timed.withColumn("row", F.explode(rows))
    here = {k: F.coalesce(F.col(f"{k}.arrived_at") <= F.col("row.told_at"), F.lit(False)) for k in KINDS}
    missing = F.filter(F.array(*[F.when(~x, F.lit(k)) for k, x in here.items()]), lambda k: k.isNotNull())
    return each.select("screening_id", "row.status", missing.alias("missing"), "row.told_at", "first_at", *[F.when(x, F.col(f"{k}.document")).alias(k) for k, x in here.items()])


def submitted(tracked: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """The complete submissions (in time or late) as ``records.submissions`` has them: the claim's columns and a struct of each document.

    schemas: DDL of the record of each kind.
    """
    whole = tracked.where(F.col("status").isin("complete", "completed_late"))
    read = whole.select("screening_id", *[F.from_json(k, schemas[k]).alias(k) for k in KINDS])
    return read.select("screening_id", "claim.*", *[k for k in KINDS if k != "claim"])
