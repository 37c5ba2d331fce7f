"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a seeded shuffle, passed through up to ``max_repeats`` times. An
occurrence's virtual finish time is the source's words up to its end, divided by the source's
weight. All occurrences are range-sorted by finish time and the mix is the prefix that fits the
budget. A source that runs out simply has no later occurrence, so what it leaves goes to the others
by weight: the prefix is the water level of the closed form that ``source_targets`` reports.

Sums over a source, over all sources or over everything are running totals over range partitions (a total per
partition, then an offset), so a source with a third of all rows is many partitions, not one group, and
there may be as many sources as documents. Documents are numbered and written once; what is sorted is a thin table of
numbers, sources, sizes and hashes, so no text is counted or moved twice.

Defined cases: null text or empty text has size 0 and is never taken; a null source is a source of
its own, last in order; equal rows are separate occurrences; an empty table gives an empty result; a
caller's columns of the names that ``mix`` adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, read

WORD = r"[^\x20\x09-\x0D]+"


def with_running_totals(df: DataFrame, order: list[Column], totals: dict[str, str], rid: str) -> DataFrame:
    """The rows in a written table, with ``rid`` (rises in ``order``) and, by name, the sum of a column up to and with each row.

    df should be a written table, as it is read twice. One row per range partition is gathered for the offsets.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(rid, F.monotonically_increasing_id())
    table = materialize(placed, "sorted").withColumn("part", F.shiftright(rid, 33))
    parts = table.groupBy("part").agg(*[F.sum(value).alias(f"{name}_part") for name, value in totals.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", *[F.coalesce(F.sum(f"{name}_part").over(before), F.lit(0)).alias(f"{name}_part") for name in totals])
    within = Window.partitionBy("part").orderBy(rid).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = table.withColumns({name: F.sum(value).over(within) for name, value in totals.items()})
    # as many rows as range partitions
    placed = own.join(F.broadcast(offsets), "part").withColumns({name: F.col(name) + F.col(f"{name}_part") for name in totals})
    return placed.drop("part", *[f"{name}_part" for name in totals])


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Of rows (source, size), per source: ``name, words, weight, before`` (words of the sources before it) and ``target``.

    Targets share all words by weight; none exceeds ``max_repeats`` times its source's words. Sorted by
    cap over weight, a source is capped exactly if the water level over the remaining ones reaches its cap.
    """
    per = materialize(sizes.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("words")).withColumn("one", F.lit(1).cast("long")), "sources")
    ranked = with_running_totals(per, [F.col("name").isNull(), F.col("name")], {"rank": "one", "upto": "words"}, "by_name")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    weighted = materialize(ranked.select("name", "words", "rank", (F.col("upto") - F.col("words")).alias("before"), weight.alias("weight"), (F.col("words") * max_repeats).alias("cap")), "weights")
    words, every_weight = (int(x or 0) for x in weighted.agg(F.sum("words"), F.sum("weight")).first())
    level = with_running_totals(weighted, [F.col("cap") / F.col("weight"), F.col("rank")], {"caps": "cap", "weights": "weight"}, "by_level")
    rest_words = F.lit(words) - (F.col("caps") - F.col("cap"))
    rest_weight = F.lit(every_weight) - (F.col("weights") - F.col("weight"))
    capped = F.col("cap").cast("decimal(19,0)") * rest_weight.cast("decimal(19,0)") <= rest_words.cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
    level = materialize(level.withColumn("capped", capped), "levels")
    gone_words, gone_weight = (int(x or 0) for x in level.where("capped").agg(F.sum("cap"), F.sum("weight")).first())
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.lit(float(words - gone_words)) * F.col("weight") / F.lit(max(1, every_weight - gone_weight)))
    return level.select("name", "words", "weight", "before", target.alias("target"))


def mix(docs: DataFrame, size: str, source: str = "source", shuffle_by: list[str] | None = None, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """docs with ``__source_size, __target, __taken``; ``__taken`` is a multiple of ``size``.

    weights: of the sources in code-point order, repeating. The budget is the sum of all sizes.
    shuffle_by: columns whose seeded hash gives a document's place among its source's documents.
    """
    keys = shuffle_by or [c for c, kind in docs.dtypes if kind in ("string", "bigint", "int")]
    row = fresh(docs, "__row")
    hashes = [F.xxhash64(F.lit(seed + k), *[f"`{c}`" for c in keys]) for k in (0, 1)]
    kept = [c for c in docs.columns if c.lower() not in ("__source_size", "__target", "__taken")]
    written = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mixing")
    thin = written.select(F.col(row).alias("row"), F.col(f"`{source}`").alias("source"), F.col(f"`{size}`").alias("size"), hashes[0].alias("a"), hashes[1].alias("b"))
    if shuffle_by is None or any(kind == "string" for c, kind in docs.dtypes if c in keys):
        thin = materialize(thin, "thin")  # long texts are hashed once
    per = source_targets(thin.select("source", "size"), weights, max_repeats)
    order = [F.col("source").isNull(), F.col("source"), F.col("a"), F.col("b"), F.col("row")]
    placed = with_running_totals(thin, order, {"upto": "size"}, "turn").join(per, F.col("source").eqNullSafe(F.col("name")))
    rows = materialize(placed.select("row", "turn", "size", (F.col("upto") - F.col("before")).alias("upto"), "words", "weight", "target"), "turns")

    def finish(pass_: Column) -> Column:
        return (F.col("upto") + pass_ * F.col("words")) / F.col("weight")

    budget = int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    queue = rows.where(F.col("size") > 0).select("turn", "size", "upto", "words", "weight", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("pass"))
    queued = with_running_totals(queue.select("turn", "size", finish(F.col("pass")).alias("finish")), [F.col("finish"), F.col("turn")], {"total": "size"}, "place")
    cut = queued.where(F.col("total") <= budget).agg(F.max(F.struct("finish", "turn")).alias("c")).first()["c"]
    if cut is None:
        taken = F.lit(0).cast("long")
    else:
        early = [((finish(F.lit(p)) < cut[0]) | ((finish(F.lit(p)) == cut[0]) & (F.col("turn") <= cut[1]))).cast("long") for p in range(max_repeats)]
        taken = sum(early[1:], early[0]) * F.col("size")
    found = rows.select(F.col("row").alias(row), F.col("words").alias("__source_size"), F.col("target").alias("__target"), taken.alias("__taken"))
    # as many rows as documents: a shuffle at every size, rather than a broadcast of a table that grows with them
    return written.select(*[f"`{c}`" for c in kept], row).join(found.hint("merge"), row).drop(row)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Mixing of the whole ``documents`` table: doc_id, size, source_size, target, taken."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text"))
    mixed = mix(docs, "size", "source", ["doc_id", "text"])
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, copies next to each other, with the columns of ``docs``."""
    own = [f"__own_{k}" for k in range(len(docs.columns))]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)], size.alias("__size"))
    source, doc_id, text = (own[docs.columns.index(c)] for c in ("source", "doc_id", "text"))
    mixed = mix(sized, "__size", source, [doc_id, text]).where(F.col("__taken") > 0)
    copies = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), (F.col("__taken") / F.col("__size")).cast("int"))))
    return copies.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])
