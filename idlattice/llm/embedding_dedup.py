"""Embedding near-duplicates by spherical-cap filters: structured random product codes, list decoding, join, verification.

A code is a random rotation and two sets of random unit directions, one for each half of the rotated
space; a filter is a pair of them, and a vector lies in its cap if the two projections together exceed a
threshold. A code of B^2 filters costs 2 B products: both projections are sorted, and the pairs that exceed
are listed from the best downwards (Becker, Ducas, Gama & Laarhoven, "New directions in nearest neighbor
searching with applications to lattice sieving", 2016). Several independent codes are used; a vector also
takes the best filter of each, so that none is left without. Rows of equal label meet on their filters and are
verified by cosine in double precision; a pair is counted only at the least filter that both have.

Recall: caps and codes are dealt so that a pair right at the threshold shares ``COMMON`` filters on average; in
simulations (64 dimensions) 0.999 of such pairs shared one, and closer pairs more often.

Groups of near copies: a bounded sample gives pivots, rows with many others within half the linking angle.
Rows within that angle of a pivot form its ball; all pairs in a ball are linked by the triangle
inequality, so they are counted and connected through the ball and never compared. Buckets of a filter with
more than ``PIECE`` rows are dealt into pieces by ball, and pairs of pieces meet, but not pieces of one ball. What
leaves a task is a count for each row and links enough to connect what it found, never all pairs.
The pivots only spare work: without them the result is the same.

Defined cases: rows with a null id or label, a null or empty vector, a null or non-finite component, or only
zeros link with nothing: n_links 0, component_id their own vec_id, kept true. Vectors of different lengths
never link. Every row counts, repeated ones too, whatever ids repeat. An empty table gives no rows. Other columns
are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read
from .graphs import connected_components
from .vector_search import usable

COSINE = 0.93
#: Independent codes, and filters that a pair at the threshold shares on average in all of them.
CODES = 8
COMMON = 16
#: Rows of the largest label that a filter takes on average, and the largest share of rows that it may take.
CAP_ROWS = 64
LARGEST_CAP = 1 / 16
#: Rows of one piece of a bucket.
PIECE = 2048
#: Vectors from which pivots are chosen, and others of the sample that a pivot needs in its ball.
SAMPLE = 8192
BALL = 8


# --- filters ----------------------------------------------------------------------------------


def design(rows: int, cosine: float) -> tuple[float, int]:
    """(threshold in standard deviations, directions of a half) for so many rows of one label."""
    normal = NormalDist()
    share = min(LARGEST_CAP, CAP_ROWS / max(rows, 1))
    threshold = normal.inv_cdf(1 - share)
    x = np.linspace(threshold, threshold + 8, 4001)
    both = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * np.array([1 - normal.cdf((threshold - cosine * a) / math.sqrt(1 - cosine * cosine)) for a in x])
    shared = float(both.sum() * (x[1] - x[0]))  # of the filters, those that take both vectors of a pair at the threshold
    return threshold, math.ceil(math.sqrt(COMMON / CODES / shared))


@lru_cache(maxsize=64)
def code(dim: int, size: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation (dim, even dim) and the directions of both halves, of length so that a unit vector's projections add to variance 1."""
    rng = np.random.default_rng([dim, size, which])
    even = dim + dim % 2
    rotation = np.linalg.qr(rng.normal(size=(even, even)))[0][:dim]
    halves = rng.normal(size=(2, size, even // 2))
    halves *= math.sqrt(even / 2) / np.linalg.norm(halves, axis=2, keepdims=True)
    return rotation, halves[0], halves[1]


def decode(units: np.ndarray, threshold: float, size: int, codes: int = CODES) -> list[np.ndarray]:
    """The filters of each unit vector in ascending order: all that exceed the threshold, and the best of each code."""
    rows, names = [], []
    for which in range(codes):
        rotation, one, two = code(units.shape[1], size, which)
        turned = units @ rotation
        half = turned.shape[1] // 2
        a, b = turned[:, :half] @ one.T, turned[:, half:] @ two.T
        by_a, by_b = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        for i in range(size):
            alive = np.flatnonzero(a[:, i] + b[:, 0] > threshold) if i else np.arange(len(units))
            for j in range(size):
                if i or j:
                    alive = alive[a[alive, i] + b[alive, j] > threshold]
                if not len(alive):
                    break
                rows.append(alive)
                names.append(which * size * size + by_a[alive, i] * size + by_b[alive, j])
            if i and not np.any(a[:, i] + b[:, 0] > threshold):
                break
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return np.split(name[order], np.cumsum(np.bincount(row, minlength=len(units)))[:-1])


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def pivots_of(vectors: np.ndarray, half: float, least: int = BALL) -> np.ndarray:
    """Rows of the sample that take at least ``least`` others into their ball, greedily the largest ball first."""
    units, chosen = unit(vectors), []
    near = np.zeros((len(units), len(units)), bool)
    for a in range(0, len(units), 1024):
        near[a : a + 1024] = units[a : a + 1024] @ units.T >= half
    sizes = near.sum(axis=1)
    while len(units) and sizes.max() > least:
        best = int(sizes.argmax())
        chosen.append(best)
        taken = np.flatnonzero(near[best])
        sizes -= near[:, taken].sum(axis=1)
        near[:, taken] = False
        near[taken] = False
        sizes[taken] = 0
    return units[chosen]


# --- verification -----------------------------------------------------------------------------


def links_of_meeting(units: np.ndarray, ball: np.ndarray, piece: np.ndarray, lower: list[np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows, rows) of a meeting: of one piece all, of two those across; not within a ball, nor with an earlier common filter."""
    left = np.flatnonzero(piece == piece[0])
    right = np.flatnonzero(piece != piece[0])
    alone = not len(right)
    right = left if alone else right
    width = max(map(len, lower))
    names = np.full((len(units), width), -1, np.int64)
    for r, x in enumerate(lower):
        names[r, : len(x)] = x
    found = [], []
    for a in range(0, len(left), 1024):
        i, j = np.nonzero(units[left[a : a + 1024]] @ units[right].T >= cosine)
        i, j = left[a : a + 1024][i], right[j]
        good = ((ball[i] < 0) | (ball[i] != ball[j])) & ((i < j) if alone else True)
        i, j = i[good], j[good]
        for b in range(0, len(i), 8192):
            x, y = names[i[b : b + 8192]], names[j[b : b + 8192]]
            first = np.ones(len(x), bool)
            for k in range(width):
                first &= ~((x[:, k : k + 1] == y) & (y >= 0)).any(axis=1)
            found[0].append(i[b : b + 8192][first])
            found[1].append(j[b : b + 8192][first])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found[0]]), np.concatenate([none, *found[1]])


def roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each row's least row of its component."""
    root = np.arange(size)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (before == root).all():
            return root


def _verified(rows: DataFrame, cosine: float) -> DataFrame:
    """rows (label, dim, f, i, j; u, ball, piece, vector, lower) -> (u, n) pairs counted and (u, v) links, n null in links."""
    keys = ["label", "dim", "f", "i", "j"]
    placed = rows.repartition(*keys).sortWithinPartitions(*keys)

    def work(table: pa.Table) -> pa.RecordBatch:
        column = lambda n: table.column(n).to_numpy()
        u, ball, piece = column("u"), column("ball"), column("piece")
        key = np.stack([column(k) for k in keys])
        cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(u)]])
        counted, linked = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            part = table.slice(a, b - a)
            units = unit(np.frombuffer(b"".join(part.column("vector").to_pylist()), "<f8" if part.column("wide")[0].as_py() else "<f4").astype(np.float64).reshape(b - a, -1))
            lists = part.column("lower").combine_chunks()
            lower = np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())[:-1])
            i, j = links_of_meeting(units, ball[a:b], piece[a:b], lower, cosine)
            if len(i):
                n, root = np.bincount(np.concatenate([i, j]), minlength=b - a), roots(b - a, i, j)
                counted.append((u[a:b][n > 0], n[n > 0]))
                own = np.flatnonzero(root != np.arange(b - a))
                linked.append((u[a:b][own], u[a:b][root[own]]))
        none = (np.zeros(0, np.int64),) * 2
        c, e = (tuple(np.concatenate(x) for x in zip(none, *found, strict=True)) for found in (counted, linked))
        return pa.RecordBatch.from_pydict({"u": np.concatenate([c[0], e[0]]), "v": pa.array(np.concatenate([c[0], e[1]])), "n": pa.array(np.concatenate([c[1], np.zeros(len(e[0]), np.int64)]), mask=np.arange(len(c[0]) + len(e[0])) >= len(c[0]))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [table.column(k)[table.num_rows - 1].as_py() for k in keys]
            open_ = np.ones(table.num_rows, bool)
            for k, x in zip(keys, last, strict=True):
                open_ &= table.column(k).to_numpy() == x
            done = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
            if done:
                yield work(table.slice(0, done))
            held = table.slice(done)
        if held is not None:
            yield work(held)

    return placed.mapInArrow(run, "u long, v long, n long")


# --- operator ---------------------------------------------------------------------------------


def _coded(valid: DataFrame, threshold: float, size: int, pivots: dict[tuple[int, int], tuple[int, np.ndarray]], half: float, wide: bool) -> DataFrame:
    """valid (u, label, dim, x) -> u, label, dim, ball (-1: none), vector as bytes, filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, label, dims = (batch.column(k).to_numpy() for k in range(3))
            ball, filters = np.full(len(u), -1, np.int64), np.empty(len(u), object)
            lists = batch.column(3)
            for key in set(zip(label.tolist(), dims.tolist(), strict=True)):
                own = np.flatnonzero((label == key[0]) & (dims == key[1]))
                units = unit(lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1))
                filters[own] = np.array([*decode(units, threshold, size), None], object)[:-1]
                if key in pivots:
                    first, centres = pivots[key]
                    close = units @ centres.T >= half
                    ball[own] = np.where(close.any(axis=1), first + close.argmax(axis=1), -1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8" if wide else "<f4"), np.cumsum(dims)
            vectors = [flat[e - d : e].tobytes() for e, d in zip(ends.tolist(), dims.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ball), pa.array(vectors, pa.binary()), pa.array(filters.tolist(), pa.list_(pa.int64()))], names=["u", "label", "dim", "ball", "vector", "filters"])

    return valid.select("u", "label", "dim", "x").mapInArrow(run, "u long, label long, dim long, ball long, vector binary, filters array<long>")


def _dealt(coded: DataFrame, piece: int) -> DataFrame:
    """A row for every filter of a vector and every meeting that it goes to."""
    bucket = ["label", "dim", "f"]
    each = coded.select("label", "dim", "ball", F.explode("filters").alias("f"))
    balls = each.groupBy(*bucket, "ball").agg(F.count(F.lit(1)).alias("n"))
    large = balls.groupBy(*bucket).agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("ball", F.ceil(F.col("n") / piece).cast("long").alias("n")))).alias("balls")).where(F.col("rows") > piece)
    # written first: few buckets are large, and of a known size they need no shuffle of the vectors
    rows = coded.select("u", "label", "dim", "ball", "vector", "filters", F.explode("filters").alias("f")).join(materialize(large.drop("rows"), "large"), bucket, "left")
    # pieces are numbered through the balls of a bucket; a row's own are from ``first`` on
    before = lambda x: F.aggregate(F.filter("balls", lambda b: b["ball"] < x), F.lit(0).cast("long"), lambda s, b: s + b["n"])
    own = F.element_at(F.filter("balls", lambda b: b["ball"] == F.col("ball")), 1)["n"]
    whole = F.aggregate("balls", F.lit(0).cast("long"), lambda s, b: s + b["n"])
    placed = rows.withColumn("first", before(F.col("ball"))).withColumn("own", own).withColumn("whole", whole).withColumn("piece", F.coalesce(F.col("first") + F.pmod(F.xxhash64("u"), F.col("own")), F.lit(0)))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1), lambda p: (F.col("ball") < 0) | (p < F.col("first")) | (p >= F.col("first") + F.col("own")))
    met = placed.withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0).cast("long")))))
    lower = F.filter("filters", lambda x: x < F.col("f"))
    return met.select(*bucket, F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "u", "ball", "piece", "vector", lower.alias("lower"))


def near_duplicates(rows: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", piece: int = PIECE, sample: int = SAMPLE) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept."""
    half = math.sqrt((1 + cosine) / 2) + 1e-9
    wide = rows.schema[vector].dataType.simpleString() != "array<float>"
    named = materialize(rows.select(F.monotonically_increasing_id().alias("u"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>" if wide else "array<float>").alias("x")), "vectors")
    valid = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("x")).withColumn("dim", F.size("x").cast("long"))
    most = valid.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    threshold, size = design(most, cosine)

    picked: dict[tuple[int, int], list] = {}
    for r in valid.orderBy(F.xxhash64(F.lit(12), "u"), "u").limit(sample).select("label", "dim", "x").toLocalIterator():
        picked.setdefault((r["label"], r["dim"]), []).append(r["x"])
    pivots, n = {}, 0
    for key in sorted(picked):
        centres = pivots_of(np.array(picked[key], np.float64), half)
        if len(centres):
            pivots[key] = (n, centres)
            n += len(centres)

    coded = materialize(_coded(valid, threshold, size, pivots, half, wide), "filters")
    found = materialize(_verified(_dealt(coded, piece).withColumn("wide", F.lit(wide)), cosine), "links")
    balls = coded.where("ball >= 0").groupBy("ball").agg(F.min("u").alias("v"), (F.count(F.lit(1)) - 1).alias("n"))
    inside = coded.where("ball >= 0").select("u", "ball").join(balls, "ball")
    links = found.where("n is null").select("u", "v").unionByName(inside.select("u", "v"))
    counts = found.where("n is not null").select("u", "n").unionByName(inside.select("u", "n")).groupBy("u").agg(F.sum("n").alias("n_links"))

    stars = connected_components(links).select("u", F.col("v").alias("root"))
    rooted = materialize(named.select("u", "vec_id").join(stars, "u", "left").select("u", "vec_id", F.coalesce("root", "u").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    joined = rooted.join(least, "root").join(counts, "u", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE r AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM r a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
least AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
counted AS (SELECT u AS vec_id, count(*) AS n_links FROM link GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)"""
