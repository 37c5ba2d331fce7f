"""Shared plumbing: row intake, materialised tables, Arrow passes and vectorised word kernels.

Conventions of every operator here:

* a null text counts as the empty text; nulls elsewhere are carried along;
* columns the caller adds are kept by the general operators and never looked at; helper columns bear
  names that the caller's table hasn't (``fresh``) and are dropped again;
* work in Python goes through Arrow in slices of bounded bytes, so memory follows the slice and the
  longest single text, not the table.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; one longer text forms a slice of its own.
SLICE_BYTES = 2 << 20
#: Entries that a worker's word or piece cache holds at most, and the bytes of the longest word kept.
CACHE_ENTRIES = 600_000
LONGEST = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z; every other byte of the UTF-8 text stays."""
    return text.translate(_LOWER)


# --- tables -----------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/idlattice/{uuid.uuid4().hex}-{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and go on from the file: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that nothing refers to any more, between the levels of a long job.

    Spark deletes them when the driver collects the frame; a driver with a roomy heap may not do so for
    half an hour, in which the disks of the executors fill up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/idlattice/" in folder:
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df bears, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- order statistics -------------------------------------------------------------------------


def order_statistics(rows: DataFrame, ranks: dict[int, list[int]], bins: int = 1024) -> dict[int, list[float]]:
    """The values at these ranks (from 0) among all finite values of each key; exact, by counts in ever narrower spans.

    rows: key int, value double, weight long (rows that this one stands for), read once a round, so better a
    table than a plan. A round counts ``bins`` cells of each span that still holds several values; the driver
    gets counts only, for the keys and ranks asked for.
    """
    ends = {r.key: (r.lo, r.hi) for r in rows.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    found = {(key, rank): (*ends[key], rank) for key, asked in ranks.items() for rank in asked}
    while spans := sorted({(key, lo, hi) for (key, _), (lo, hi, _) in found.items() if lo < hi}):
        asked = rows.sparkSession.createDataFrame(spans, "key int, lo double, hi double")
        cell = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        # bounded by the ranks asked for
        inside = rows.join(F.broadcast(asked), "key").where("value between lo and hi").groupBy("key", "lo", "hi", cell.alias("cell"))
        cells: dict[tuple, list] = {}
        for r in sorted(inside.agg(F.sum("weight").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).collect(), key=lambda r: r.least):
            cells.setdefault((r.key, r.lo, r.hi), []).append(r)
        for (key, rank), (lo, hi, left) in found.items():
            for r in cells.get((key, lo, hi), ()):
                if left < r.n:
                    found[key, rank] = r.least, r.most, left
                    break
                left -= r.n
    return {key: [found[key, rank][0] for rank in asked] for key, asked in ranks.items()}


# --- Arrow passes -----------------------------------------------------------------------------


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that their texts hold about ``size`` bytes; never within a text."""
    for batch in batches:
        texts = texts_of(batch.column(batch.schema.get_field_index(text)))
        begin = held = 0
        for k, x in enumerate(texts):
            if held and held + len(x) > size:
                yield batch.slice(begin, k - begin), texts[begin:k]
                begin, held = k, 0
            held += len(x)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def map_texts(df: DataFrame, text: str, kernel: Callable[[list[bytes]], dict[str, pa.Array]], added: str, keep: list[str] | None = None) -> DataFrame:
    """One row out for each row in: ``keep`` columns as they are, then what ``kernel`` makes of the texts.

    added: DDL of the new columns, which replace columns of the same name.
    """
    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    whole = fresh(df, "__text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(whole))
    schema = T.StructType([*source.select(*[f"`{c}`" for c in kept]).schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, whole):
            made = kernel(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[made[f.name] for f in new.fields]], names=[*kept, *[f.name for f in new.fields]])

    return source.mapInArrow(run, schema)


# --- words ------------------------------------------------------------------------------------


def flatten_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts joined by single spaces: (bytes, word starts, word lengths, words of each text)."""
    split = [x.split() for x in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    joined = b" ".join([b" ".join(x) for x in split if x])
    if not joined:
        none = np.zeros(0, np.int64)
        return joined, none, none, counts
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], blanks + 1])
    lengths = np.concatenate([blanks, [len(joined)]]) - starts
    return joined, starts, lengths, counts


#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_many(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many substrings of one byte string at once, as unsigned 64-bit integers.

    The substrings are taken in order of length, so that each round of the hash runs over a suffix.
    """
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    padded = data + b"\0" * 16
    eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,)).copy()
    four = np.ndarray((len(data) + 8,), "<u4", padded, strides=(1,))
    one = np.frombuffer(padded, np.uint8)
    order = np.argsort(lengths.astype(np.uint16) if lengths.max() < 65536 else lengths, kind="stable")
    size = lengths[order]
    at = starts[order].copy()
    acc = np.full(n, np.uint64(seed) + _P5, np.uint64)
    with np.errstate(over="ignore"):
        seed64 = np.uint64(seed)
        first = int(np.searchsorted(size, 32))
        if first < n:
            v = [np.full(n - first, x, np.uint64) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            stripes = size[first:] // 32
            for s in range(int(stripes[-1])):
                k = int(np.searchsorted(stripes, s + 1))
                where = at[first + k :]
                for lane in range(4):
                    v[lane][k:] = _rotl(v[lane][k:] + eight[where + 8 * lane] * _P2, 31) * _P1
                at[first + k :] += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ (_rotl(x * _P2, 31) * _P1)) * _P1 + _P4
            acc[first:] = h
        acc += size.astype(np.uint64)
        rest = size % 32
        for s in range(3):
            mine = np.flatnonzero(rest >= 8 * (s + 1)) if first < n else slice(int(np.searchsorted(size, 8 * (s + 1))), n)
            acc[mine] = _rotl(acc[mine] ^ (_rotl(eight[at[mine]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[mine] += 8
        mine = np.flatnonzero(rest & 4)
        acc[mine] = _rotl(acc[mine] ^ (four[at[mine]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[mine] += 4
        for s in range(3):
            mine = np.flatnonzero((rest & 3) > s)
            acc[mine] = _rotl(acc[mine] ^ (one[at[mine] + s].astype(np.uint64) * _P5), 11) * _P1
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        acc ^= acc >> np.uint64(32)
    out = np.empty(n, np.uint64)
    out[order] = acc
    return out


class Cache(dict):
    """word -> value, made on first sight. It keeps words of up to LONGEST bytes until it is full, so that its memory is bounded."""

    def __init__(self, make: Callable[[bytes], object], most: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes) -> object:
        value = self.make(word)
        if len(self) < self.most and len(word) <= LONGEST:
            self[word] = value
        return value
