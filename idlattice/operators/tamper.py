"""Forensic signals: block statistics, box merging, copy-move clusters, metadata, cross-zone comparison, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import FIELD_PAIRS, HIGH_WEIGHT, LEAST_CONFIDENCE, NORMALIZERS, same_name

#: Weights of the signals and levels of risk.
WEIGHTS = {"ela": 0.35, "noise": 0.15, "edge_texture": 0.10, "copy_move": 0.15, "metadata": 0.10, "document_consistency": 0.35}
LOW, HIGH, VERY_STRONG = 0.30, 0.65, 0.80
#: Words that name image editors, in order of precedence.
EDITORS = ("adobe photoshop", "photoshop", "gimp", "gnu image manipulation program", "lightroom", "affinity photo", "paint.net", "photopea", "coreldraw", "pixelmator", "canva", "indesign", "picsart", "snapseed", "pixlr", "seashore")


def block_statistics(blocks: DataFrame, value: str) -> DataFrame:
    """blocks (doc_id, block, value) with the document's median and median absolute deviation, and the deviation from the median."""
    medians = blocks.groupBy("doc_id").agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n_blocks"))
    near = blocks.join(medians, "doc_id").withColumn("deviation", F.col(value) - F.col("median"))
    spread = near.groupBy("doc_id").agg(F.percentile(F.abs("deviation"), F.lit(0.5)).alias("mad"))
    return near.join(spread, "doc_id")


def _stands_out(noise: bool) -> Column:
    """Whether a block's deviation from the median is an outlier's: above it for recompression error, to either side for noise."""
    if noise:
        return F.abs("deviation") >= F.greatest(F.lit(14.0), 3.5 * F.greatest(F.lit(0.8), 1.4826 * F.col("mad")))
    return F.col("deviation") >= F.greatest(F.lit(2.5), 2.5 * F.greatest(F.lit(0.5), 1.4826 * F.col("mad")))


def outlier_regions(blocks: DataFrame, value: str, noise: bool = False, size: int = 32) -> DataFrame:
    """blocks (doc_id, block, x, y, value) -> doc_id, region (from 0), x1, y1, x2, y2: outlier blocks, those near each other merged."""
    far = block_statistics(blocks, value).where(_stands_out(noise))
    x, y = F.col("x").cast("int"), F.col("y").cast("int")
    return merged_boxes(far.select("doc_id", F.col("block").cast("int").alias("ordinal"), x.alias("x1"), y.alias("y1"), (x + size).alias("x2"), (y + size).alias("y2")), size * 1.5)


def ela_signal(blocks: DataFrame, value: str = "value", regions: DataFrame | None = None) -> DataFrame:
    """doc_id, outliers, outlier_ratio, largest_deviation, score: blocks whose recompression error stands out above the median.

    regions: ``outlier_regions`` of the blocks; two of them weigh more than one. Without places every outlier block counts as a region.
    """
    s = block_statistics(blocks, value)
    per = s.groupBy("doc_id").agg(F.count_if(_stands_out(False)).alias("outliers"), F.greatest(F.lit(0.0), F.max("deviation")).alias("largest_deviation"), F.max("n_blocks").alias("n_blocks"))
    ratio = F.col("outliers") / F.greatest(F.lit(1), F.col("n_blocks"))
    base = 0.20 + ratio * 3.5 + F.least(F.lit(30.0), F.col("largest_deviation")) / 30.0 * 0.45
    several = F.col("outliers") >= 2
    if regions is not None:
        per = per.join(regions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("regions")), "doc_id", "left")
        several = F.coalesce("regions", F.lit(0)) >= 2
    base = F.when(several | (F.col("largest_deviation") >= 15.0), F.greatest(base, F.lit(0.45))).otherwise(base)
    base = F.when((F.col("largest_deviation") >= 25.0) & (ratio >= 0.02), F.greatest(base, F.lit(0.70))).otherwise(base)
    score = F.when((F.col("outliers") == 0) | (F.col("largest_deviation") < 2.5) | (F.col("n_blocks") < 4), 0.0).otherwise(F.round(F.least(F.lit(1.0), base), 4))
    return per.select("doc_id", "outliers", F.round(ratio, 4).alias("outlier_ratio"), F.round("largest_deviation", 2).alias("largest_deviation"), score.alias("score"))


def noise_signal(blocks: DataFrame, value: str = "value") -> DataFrame:
    """The same of noise, where deviations to either side count and few outliers don't."""
    s = block_statistics(blocks, value)
    per = s.groupBy("doc_id").agg(F.count_if(_stands_out(True)).alias("outliers"), F.max(F.abs("deviation")).alias("largest_deviation"), F.max("n_blocks").alias("n_blocks"))
    ratio = F.col("outliers") / F.greatest(F.lit(1), F.col("n_blocks"))
    base = F.least(F.lit(1.0), 0.18 + ratio * 3.5 + F.least(F.lit(30.0), F.col("largest_deviation")) / 30.0 * 0.30)
    score = F.when((F.col("outliers") == 0) | (ratio < 0.015) | (F.col("largest_deviation") < 14.0), 0.0).otherwise(F.round(base, 4))
    return per.select("doc_id", "outliers", F.round(ratio, 4).alias("outlier_ratio"), F.round("largest_deviation", 2).alias("largest_deviation"), score.alias("score"))


def edge_signal(blocks: DataFrame, value: str = "value") -> DataFrame:
    """0.25 where some block is far less sharp than the median."""
    per = blocks.groupBy("doc_id").agg(F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least"))
    return per.select("doc_id", "median", "least", F.when((F.col("median") > 8.0) & (F.col("median") - F.col("least") > 6.0) & (F.col("least") < 3.0), 0.25).otherwise(0.0).alias("score"))


def merged_boxes(boxes: DataFrame, max_gap: float = 48.0) -> DataFrame:
    """boxes (doc_id, ordinal, x1, y1, x2, y2) -> merged ones: each box joins the first earlier one within the gap, as they come."""
    struct = "struct<x1:int,y1:int,x2:int,y2:int>"
    gathered = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "x1", "y1", "x2", "y2"))).alias("boxes"))

    def add(kept: Column, b: Column) -> Column:
        meets = lambda m: ~((b["x2"] < m["x1"] - max_gap) | (b["x1"] > m["x2"] + max_gap) | (b["y2"] < m["y1"] - max_gap) | (b["y1"] > m["y2"] + max_gap))
        at = F.array_position(F.transform(kept, meets), True)
        union = lambda m: F.struct(F.least(m["x1"], b["x1"]).alias("x1"), F.least(m["y1"], b["y1"]).alias("y1"), F.greatest(m["x2"], b["x2"]).alias("x2"), F.greatest(m["y2"], b["y2"]).alias("y2"))
        own = F.struct(b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2"))
        return F.when(at > 0, F.transform(kept, lambda m, i: F.when(i + 1 == at, union(m)).otherwise(m))).otherwise(F.concat(kept, F.array(own)))

    folded = F.aggregate("boxes", F.expr(f"cast(array() as array<{struct}>)"), add)
    return gathered.select("doc_id", F.posexplode(folded).alias("region", "b")).select("doc_id", "region", "b.*")


#: Points of an image from which on copies are looked for, the share that a match's distance may be of the next one's, and the
#: radius in bits within which neighbours are found: 16 chunks of 16 bits, of which a pair in it shares one whole.
LEAST_POINTS, RATIO, RADIUS = 25, 0.80, 15


def nearest_descriptors(points: DataFrame, k: int = 3) -> DataFrame:
    """points (doc_id, point, descriptor: 32 bytes) -> doc_id, point, place (from 1), other, distance: the k nearest in the image.

    The point itself is one of them; equal distances go by point. Exact up to RADIUS bits, none beyond: of 16 chunks at
    least one is the same in any such pair, so pairs meet by an equi-join on (image, chunk, its value), once, at their first
    common chunk. An image has as many points as its detector gives, not as many as the table.
    """
    words = F.array(*[F.conv(F.hex(F.substring("descriptor", 8 * i + 1, 8)), 16, -10).cast("long") for i in range(4)])
    chunk = lambda w, i: F.shiftrightunsigned(w[i // 4], 48 - 16 * (i % 4)).bitwiseAND(65535)
    held = points.where(F.length("descriptor") == 32).select("doc_id", "point", words.alias("words"))
    one = held.select("*", F.posexplode(F.array(*[chunk(F.col("words"), i) for i in range(16)])).alias("at", "key"))
    two = one.select("doc_id", "at", "key", F.col("point").alias("other"), F.col("words").alias("other_words"))
    first = F.array_position(F.array(*[chunk(F.col("words"), i) == chunk(F.col("other_words"), i) for i in range(16)]), True) == F.col("at") + 1
    apart = sum((F.bit_count(F.col("words")[i].bitwiseXOR(F.col("other_words")[i])) for i in range(1, 4)), F.bit_count(F.col("words")[0].bitwiseXOR(F.col("other_words")[0])))
    near = one.join(two, ["doc_id", "at", "key"]).where(first).select("doc_id", "point", "other", apart.alias("distance")).where(F.col("distance") <= RADIUS)
    order = Window.partitionBy("doc_id", "point").orderBy("distance", "other")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("doc_id", "point", "place", "other", "distance")


def _equal_descriptors(points: DataFrame) -> DataFrame:
    """Each point with the smallest other point of equal descriptor in its image; all from one partitioning by image."""
    place = F.struct("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p")
    counted = points.where("doc_id is not null").select("doc_id", "descriptor", place, F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n"))
    alike = Window.partitionBy("doc_id", "descriptor").orderBy("p.point").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = counted.where((F.col("n") >= LEAST_POINTS) & (F.length("descriptor") == 32)).select("doc_id", "p", F.first("p").over(alike).alias("one"), F.nth_value("p", 2).over(alike).alias("two"))
    other = F.when(F.col("p.point") == F.col("one.point"), F.col("two")).otherwise(F.col("one"))
    return held.select("doc_id", "p", other.alias("o")).where("o is not null").select("doc_id", F.col("p.x").alias("sx"), F.col("p.y").alias("sy"), F.col("o.x").alias("tx"), F.col("o.y").alias("ty"))


def descriptor_matches(points: DataFrame, ratio: float = RATIO, strict: bool = True) -> DataFrame:
    """points (doc_id, point, x, y, descriptor) -> pairs (doc_id, sx, sy, tx, ty) of each point and the point that matches it.

    The match is the nearest other point. strict: where the point itself comes first among its three nearest, the match is
    weighed against itself, so that only equal descriptors pass; where another comes first, it is equal. So these are found
    without distances. Else it is weighed against the next nearest other point, which
    counts as RADIUS + 1 bits away if none is within reach. Images of fewer than LEAST_POINTS points have no pairs.
    """
    if strict and ratio < 1:
        return _equal_descriptors(points)
    enough = points.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_POINTS).select("doc_id")
    nearest = nearest_descriptors(points.join(enough, "doc_id", "left_semi"))
    gathered = nearest.groupBy("doc_id", "point").agg(F.array_sort(F.collect_list(F.struct("place", "other", "distance"))).alias("near"))
    others = gathered.withColumn("o", F.filter("near", lambda x: x["other"] != F.col("point"))).where(F.size("o") > 0)
    target, leads = F.get("o", F.lit(0)), F.get("near", F.lit(0))["other"] == F.col("point")
    beyond = F.coalesce(F.get("o", F.lit(1))["distance"], F.lit(RADIUS + 1))
    third = F.coalesce(F.get("near", F.lit(2))["distance"], F.lit(RADIUS + 1))
    against = F.when(leads, target["distance"]).otherwise(third) if strict else beyond
    kept = others.where((against == 0) | (target["distance"] <= ratio * against)).select("doc_id", "point", target["other"].alias("other"))
    place = lambda key, x, y: points.select("doc_id", F.col("point").alias(key), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y))
    return kept.join(place("point", "sx", "sy"), ["doc_id", "point"]).join(place("other", "tx", "ty"), ["doc_id", "other"]).select("doc_id", "sx", "sy", "tx", "ty")


def copy_move_clusters(pairs: DataFrame, least: int = 5, min_dist: float = 35.0, bin_size: float = 20.0, sizes: DataFrame | None = None) -> DataFrame:
    """pairs (doc_id, sx, sy, tx, ty) of matching points -> clusters of one displacement: bin, matches, boxes.

    Displacements point to the right. Flat clusters, as repeated letters make, need more matches; overlapping boxes too.
    sizes (doc_id, width, height): boxes end at the image's edge.
    """
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    far = pairs.where(F.sqrt(dx * dx + dy * dy) >= min_dist)
    turn = (dx < 0) | ((dx == 0) & (dy < 0))
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    d = far.select("doc_id", pick("sx", "tx").alias("ax"), pick("sy", "ty").alias("ay"), pick("tx", "sx").alias("bx"), pick("ty", "sy").alias("by"))
    binned = d.withColumn("bin_x", F.bround((F.col("bx") - F.col("ax")) / bin_size).cast("int")).withColumn("bin_y", F.bround((F.col("by") - F.col("ay")) / bin_size).cast("int"))
    low = lambda c: F.greatest(F.lit(0), F.floor(F.min(c) - 15)).cast("int")
    high = lambda c: F.floor(F.max(c) + 15).cast("int")
    boxes = binned.groupBy("doc_id", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("matches"), low("ax").alias("ax1"), low("ay").alias("ay1"), high("ax").alias("ax2"), high("ay").alias("ay2"), low("bx").alias("bx1"), low("by").alias("by1"), high("bx").alias("bx2"), high("by").alias("by2"))
    if sizes is not None:
        cut = {f"{p}{c}2": F.least(F.col(f"{p}{c}2"), F.coalesce(F.col(edge), F.col(f"{p}{c}2"))) for p in "ab" for c, edge in (("x", "width"), ("y", "height"))}
        boxes = boxes.join(sizes.select("doc_id", "width", "height"), "doc_id", "left").withColumns(cut).drop("width", "height")
    h, w, h2 = F.col("ay2") - F.col("ay1"), F.col("ax2") - F.col("ax1"), F.col("by2") - F.col("by1")
    flat = (h < 40) | (h2 < 40) | (w / F.greatest(F.lit(1), h) > 2.5)
    needed = F.when(flat, max(10, 2 * least)).otherwise(least)
    overlap = ~((F.col("ax2") < F.col("bx1")) | (F.col("ax1") > F.col("bx2")) | (F.col("ay2") < F.col("by1")) | (F.col("ay1") > F.col("by2")))
    return boxes.where((F.col("matches") >= least) & ((~overlap & (F.col("matches") >= needed)) | (F.col("matches") >= 3 * least)))


def copy_move_signal(clusters: DataFrame) -> DataFrame:
    per = clusters.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clusters"), F.max("matches").alias("most"))
    return per.select("doc_id", "clusters", "most", F.when((F.col("most") >= 12) | (F.col("clusters") >= 2), 0.80).when(F.col("most") >= 6, 0.55).otherwise(0.30).alias("score"))


def metadata_score(values: Column) -> Column:
    """0.35 where any value names an editor, 0 where there are values, null (not evaluated) where there are none."""
    text = F.lower(F.array_join(values, " | "))
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.lit(None).cast("double")).when(detected_editor(text).isNotNull(), 0.35).otherwise(0.0)


def detected_editor(text: Column) -> Column:
    return F.coalesce(*[F.when(text.contains(k), F.initcap(F.lit(k))) for k in EDITORS])


def cross_zone(visual: DataFrame) -> DataFrame:
    """visual (doc_id, visual map, mrz map, confidences map) -> a row for each field that both zones have.

    Printed names are tried in order; a mismatch counts if the printed field's confidence reaches the least.
    """
    filled = lambda c: F.when(F.trim(c) != "", c)
    rows = []
    for names, mrz_name, kind, weight in FIELD_PAIRS:
        printed = F.coalesce(*[filled(F.try_element_at(F.col("visual"), F.lit(n))) for n in names])
        confidence = F.coalesce(*[F.when(filled(F.try_element_at(F.col("visual"), F.lit(n))).isNotNull(), F.coalesce(F.try_element_at(F.col("confidences"), F.lit(n)), F.lit(0.85))) for n in names])
        zone = filled(F.try_element_at(F.col("mrz"), F.lit(mrz_name)))
        a, b = NORMALIZERS[kind](printed), NORMALIZERS[kind](zone)
        same = same_name(a, b) if kind == "name" else a == b
        rows.append(F.struct(F.lit(mrz_name).alias("field"), printed.alias("visual_raw"), zone.alias("mrz_raw"), a.alias("visual_norm"), b.alias("mrz_norm"), same.alias("match"), F.lit(weight).alias("weight"), confidence.alias("confidence")))
    both = F.filter(F.array(*rows), lambda r: (F.coalesce(r["visual_norm"], F.lit("")) != "") & (F.coalesce(r["mrz_norm"], F.lit("")) != ""))
    return visual.select("doc_id", F.inline(both)).withColumn("counts", ~F.col("match") & (F.col("confidence") >= LEAST_CONFIDENCE))


def consistency_signal(compared: DataFrame) -> DataFrame:
    """doc_id, n_fields, n_mismatches, score, severity: the heaviest mismatch."""
    score = F.coalesce(F.round(F.max(F.when(F.col("counts"), F.col("weight"))), 4), F.lit(0.0))
    per = compared.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if("counts").alias("n_mismatches"), score.alias("score"))
    return per.withColumn("severity", F.when(F.col("score") == 0, "LOW").when(F.col("score") >= HIGH_WEIGHT, "HIGH").otherwise("MEDIUM"))


def half_up(x: Column) -> Column:
    """Four places, halves upward, whatever the last bit of a double says."""
    return F.floor(x * 10000 + 0.5000001) / 10000.0


def fuse(signals: DataFrame) -> DataFrame:
    """signals (doc_id, signal, score, weight, evaluated) -> risk, coverage and level. Consistency counts only if evaluated."""
    core = signals.where(F.col("signal").isin(*WEIGHTS) & (F.col("evaluated") | (F.col("signal") != "document_consistency")))
    on = F.col("evaluated")
    # sums of decimals don't depend on the order of rows
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(18,8)")).cast("double"), F.lit(0.0))
    per = core.groupBy("doc_id").agg(
        exact(F.col("weight")).alias("configured"), exact(F.when(on, F.col("weight"))).alias("weighed"), exact(F.when(on, F.col("weight") * F.col("score"))).alias("total"),
        F.count_if(on & (F.col("score") >= LOW)).alias("elevated"), F.count_if(on & (F.col("score") >= VERY_STRONG)).alias("strong"),
    )
    risk = half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide("total", F.when(F.col("weighed") > 0, F.col("weighed"))), F.lit(0.0)))))
    coverage = F.when(F.col("configured") > 0, F.round(F.least(F.lit(1.0), F.col("weighed") / F.col("configured")), 4)).otherwise(1.0)
    level = F.when(F.col("risk") >= HIGH, F.when((F.col("elevated") >= 2) | (F.col("strong") > 0), "HIGH").otherwise("MEDIUM")).when(F.col("risk") >= LOW, "MEDIUM").otherwise("LOW")
    return per.withColumn("risk", risk).select("doc_id", "risk", coverage.alias("coverage"), "elevated", level.alias("risk_level"))
