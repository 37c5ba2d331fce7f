"""Hard negatives by a vector-approximation file: bounds from table lookups, exact scores only where they may matter.

Rows stand in blocks of bounded size. Each block cuts every dimension into 16 cells of its own and keeps
the cell numbers, two to a byte, with each cell's smallest and largest component (Weber, Schek & Blott, "A
quantitative analysis and performance study for similarity-search methods in high-dimensional spaces", 1998).
For an anchor a table holds, for each byte, the least and the most that its two dimensions can add to the
inner product; both sums come from one lookup, as halves of one integer. Rows whose bounds can't enter the
window, or can't beat the rows already scored, are never scored; all others are, in integers, so the result
is exact.

Two passes over the blocks: the first finds each anchor's positives among the rows of its label, the second,
for all its positives at once, the rows of other labels in the windows these set. Anchors stand in blocks
too; each meets every block of rows, which is one bounded piece of work. Rows are dealt evenly and lie by
label inside their block, so a label with a third of the rows is spread like any other.

Defined cases: rows with a null id, label or vector, a null or non-finite component, or a component of 2^18 or
more in size (whose products need not fit 64 bits) take no part, nor do vectors of another length than most
have (the shorter of two as frequent). Rows with an anchor's id are the anchor itself; if several bear it, the
one with the smallest label, then vector, asks. Repeated rows count one by one; equal scores go by id. A
window that holds nothing, as with a negative positive score, gives no row. An empty table gives none. Other
columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

SCALE = 256
CELLS = 16
BLOCK = 16_384
ANCHOR_BLOCK = 512
#: Rows that are scored first, for a score that rules out others.
FIRST = 24
LARGEST = 2.0**18


# --- cells and bounds -------------------------------------------------------------------------


def cells_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, high): two cells a byte (pairs of dimensions, rows); the least and largest component of each cell (dimensions, 16).

    Cells' edges lie halfway between quantiles and even steps: narrow where rows are many, and no cell very wide.
    """
    rows, dims = vectors.shape
    code = np.zeros((dims + dims % 2, rows), np.uint8)
    low, high = np.zeros((2, dims + dims % 2, CELLS), np.int64)
    for d in range(dims):
        values = np.sort(vectors[:, d])
        share = np.arange(1, CELLS) / CELLS
        edges = (values[(share * rows).astype(np.int64)] + values[0] + share * (values[-1] - values[0])) / 2
        ends = np.searchsorted(values, edges, "right")
        code[d] = np.searchsorted(edges, vectors[:, d], "left")
        first, last = np.concatenate([[0], ends]), np.concatenate([ends, [rows]]) - 1
        used = last >= first
        low[d, used], high[d, used] = values[first[used]], values[last[used]]
    return code[0::2] | (code[1::2] << 4), low, high


class Bounds:
    """An anchor's tables over one block: least and most inner product of rows, by lookup."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        wide = np.zeros(len(low), np.int64)
        wide[: len(anchor)] = anchor
        a, b = wide[:, None] * low, wide[:, None] * high
        least, most = np.minimum(a, b), np.maximum(a, b)
        reach = int(np.maximum(np.abs(least), np.abs(most)).max(axis=1).sum())
        self.shift = max(0, reach.bit_length() - 30)  # both sums must fit 32 bits; rounded outwards
        packed = (-(-most >> self.shift) << 32) + (least >> self.shift)
        self.table = (packed[1::2, :, None] + packed[0::2, None, :]).reshape(len(low) // 2, CELLS * CELLS)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(codes.shape[1], np.int64)
        found = np.empty_like(total)
        for table, code in zip(self.table, codes, strict=True):
            total += np.take(table, code, out=found, mode="clip")
        least = total.astype(np.int32).astype(np.int64)
        return least << self.shift, (total - least >> 32) << self.shift


def first_in_window(low: np.ndarray, high: np.ndarray, ids: np.ndarray, score: Callable[[np.ndarray], np.ndarray], k: int, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k highest scores from ``least`` to ``most``, ties by id; scores only rows whose bounds leave it open."""
    open_ = np.flatnonzero((high >= least) & (low <= most))
    scores = np.zeros(0, np.int64)
    if len(open_) > FIRST:
        middle = (low[open_] + high[open_]) / 2
        early = np.argpartition(np.abs(middle - min(most, float(high[open_].max()))), FIRST)[:FIRST]
        seen = score(open_[early])
        good = np.sort(seen[(seen >= least) & (seen <= most)])
        rest = np.ones(len(open_), bool)
        rest[early] = False
        if len(good) >= k:
            rest &= high[open_] >= good[-k]
        rest = open_[rest]
        open_, scores = np.concatenate([open_[early], rest]), np.concatenate([seen, score(rest)])
    else:
        scores = score(open_)
    inside = (scores >= least) & (scores <= most)
    open_, scores = open_[inside], scores[inside]
    order = np.lexsort((ids[open_], -scores))[:k]
    return open_[order], scores[order]


# --- blocks -----------------------------------------------------------------------------------


def _vectors(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _blocks(rows: DataFrame, size: int, count: int, pack: Callable[[pa.Table], dict[str, bytes]], names: list[str]) -> DataFrame:
    """Blocks of at most ``size`` rows: part (the partition, 0 to count - 1) and what ``pack`` makes of each, binary columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def made(table: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), **{k: [v] for k, v in pack(table).items()}})

        for batch in batches:
            held.append(batch)
            while sum(x.num_rows for x in held) >= size:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, size))
                held = table.slice(size).to_batches()
        if sum(x.num_rows for x in held):
            yield made(pa.Table.from_batches(held))

    return rows.repartition(count).mapInArrow(run, "part long, " + ", ".join(f"{n} binary" for n in names))


def _row_block(table: pa.Table) -> dict[str, bytes]:
    ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
    order = np.lexsort((ids, labels))
    vectors = _vectors(table.column("v"), len(ids))[order]
    codes, low, high = cells_of(vectors)
    return {"ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": vectors.astype("<i4").tobytes(), "codes": codes.tobytes(), "cells": np.stack([low, high]).tobytes()}


def _anchor_block(table: pa.Table) -> dict[str, bytes]:
    made = {f"a{c}": table.column(c).to_numpy().tobytes() for c in ("id", "label")} | {"av": _vectors(table.column("v"), table.num_rows).astype("<i4").tobytes()}
    if "positives" in table.column_names:
        lists = table.column("positives").combine_chunks()
        counts = lists.value_lengths().to_numpy()
        made |= {"an": counts.tobytes(), "ap": np.stack([lists.flatten().field(c).to_numpy() for c in ("id", "score")]).tobytes()}
    return made


def _met(anchors: DataFrame, blocks: DataFrame, parts: int, work: Callable[..., list[tuple[int, ...]]], out: list[str]) -> DataFrame:
    """Every block of anchors meets every block of rows; ``work`` gives rows of longs, columns ``out``."""
    met = anchors.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))).join(blocks, "part").drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"vectors": "<i4", "av": "<i4", "codes": np.uint8, "an": "<i4"}
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {n: np.frombuffer(batch.column(k)[r].as_buffer(), kinds.get(n, "<i8")) for k, n in enumerate(batch.schema.names)}
                found = np.array(work(**cell), np.int64).reshape(-1, len(out))
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(len(out))], names=out)

    return met.mapInArrow(run, ", ".join(f"{n} long" for n in out))


class _Block:
    """A block of rows as arrays: ids, labels in order, vectors, codes and cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, cells: np.ndarray) -> None:
        self.ids, self.labels = ids, labels
        self.vectors = vectors.reshape(len(ids), -1)
        self.codes = codes.reshape(-1, len(ids))
        self.low, self.high = cells.reshape(2, -1, CELLS)

    def rows(self, label: int, same: bool) -> list[slice]:
        a, b = (int(np.searchsorted(self.labels, label, side)) for side in ("left", "right"))
        return [slice(a, b)] if same else [slice(0, a), slice(b, len(self.ids))]

    def bounded(self, anchor: np.ndarray, where: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, low, high) of the rows that stand in ``where``."""
        bounds = Bounds(anchor, self.low, self.high)
        pairs = [bounds(self.codes[:, x]) for x in where]
        return np.concatenate([np.arange(x.start, x.stop) for x in where]), *(np.concatenate(x) for x in zip(*pairs, strict=True))


def positives_of_block(k: int, aid: np.ndarray, alabel: np.ndarray, av: np.ndarray, **block: np.ndarray) -> list[tuple[int, ...]]:
    rows, found = _Block(**block), []
    for q, (anchor_id, label, anchor) in enumerate(zip(aid, alabel, av.reshape(len(aid), -1).astype(np.int64), strict=True)):
        at, low, high = rows.bounded(anchor, rows.rows(label, True))
        other = rows.ids[at] != anchor_id
        at, low, high = at[other], low[other], high[other]
        near, scores = first_in_window(low, high, rows.ids[at], lambda x: rows.vectors[at[x]].astype(np.int64) @ anchor, k, -np.inf, np.inf)  # noqa: B023
        found += [(anchor_id, i, s) for i, s in zip(rows.ids[at[near]].tolist(), scores.tolist(), strict=True)]
    return found


def negatives_of_block(k: int, percent: tuple[int, int], aid: np.ndarray, alabel: np.ndarray, av: np.ndarray, an: np.ndarray, ap: np.ndarray, **block: np.ndarray) -> list[tuple[int, ...]]:
    rows, found = _Block(**block), []
    begin = np.cumsum(an) - an
    positive_ids, positive_scores = ap.reshape(2, -1)
    for q, (anchor_id, label, anchor) in enumerate(zip(aid, alabel, av.reshape(len(aid), -1).astype(np.int64), strict=True)):
        asked = range(int(begin[q]), int(begin[q] + an[q]))
        windows = {p: (-(-percent[0] * int(positive_scores[p]) // 100), percent[1] * int(positive_scores[p]) // 100) for p in asked}
        windows = {p: (a, b) for p, (a, b) in windows.items() if a <= b}
        if not windows:
            continue
        at, low, high = rows.bounded(anchor, rows.rows(label, False))
        some = np.flatnonzero((high >= min(a for a, _ in windows.values())) & (low <= max(b for _, b in windows.values())) & (rows.ids[at] != anchor_id))
        at, low, high = at[some], low[some], high[some]
        for p, (least, most) in windows.items():
            near, scores = first_in_window(low, high, rows.ids[at], lambda x: rows.vectors[at[x]].astype(np.int64) @ anchor, k, least, most)  # noqa: B023
            found += [(anchor_id, p - int(begin[q]), positive_ids[p], positive_scores[p], i, s) for i, s in zip(rows.ids[at[near]].tolist(), scores.tolist(), strict=True)]
    return found


# --- operator ---------------------------------------------------------------------------------


def integers(vector: Column) -> Column:
    """floor(256 x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: condition on the column ``id``. A negative's score lies between the two percentages of the positive's.
    """
    spark = rows.sparkSession
    good = F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))  # nan is larger than any number
    named = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    valid = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & good & (F.size("x") > 0))
    usual = valid.groupBy(F.size("x").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if usual is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    valid = valid.where(F.size("x") == usual["dim"]).select("id", "label", integers(F.col("x")).alias("v"))
    parts = -(-usual["count"] // block)
    blocks = materialize(_blocks(valid, block, parts, _row_block, ["ids", "labels", "vectors", "codes", "cells"]), "cells")
    anchors = materialize(valid.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v"), "anchors")
    groups = max(1, -(-anchors.count() // ANCHOR_BLOCK))

    near = _met(_blocks(anchors, ANCHOR_BLOCK, groups, _anchor_block, ["aid", "alabel", "av"]), blocks, parts, lambda **x: positives_of_block(positives, **x), ["id", "pid", "score"])
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "pid"))
    kept = near.withColumn("place", place).where(F.col("place") <= positives)
    lists = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("pid").alias("id"), "score"))).alias("positives"))
    asking = materialize(anchors.join(lists, "id").select("id", "label", "v", F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives")), "positives")

    out = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _met(_blocks(asking, ANCHOR_BLOCK, groups, _anchor_block, ["aid", "alabel", "av", "an", "ap"]), blocks, parts, lambda **x: negatives_of_block(negatives, percent, **x), out)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 50 == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 50 = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
WHERE rank <= 3"""
