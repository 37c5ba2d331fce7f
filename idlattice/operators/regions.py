"""OCR regions: confidence, values beside labels, grouping of words into lines, crop boxes.

A region is a row (doc_id, ordinal, text, confidence, x1, y1, x2, y2). Labels meet values by an equi-join on
the document with conditions on place, never across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_confidence(score: Column, raw_max: float = 100.0) -> Column:
    """Score as 0 to 1, to four places; null and negative count as 0."""
    kept = (score <= 1.0) & F.lit(raw_max != 1.0)
    return F.when(score.isNull() | (score < 0), 0.0).when(kept, F.round(score, 4)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / raw_max)), 4))


def average_confidence(regions: DataFrame) -> DataFrame:
    """Mean confidence of each document, weighted by length of text; blank regions don't count."""
    n = F.length(F.trim("text"))
    return regions.groupBy("doc_id").agg(F.coalesce(F.round(F.try_divide(F.sum(F.when(n > 0, F.col("confidence") * n)), F.sum(F.when(n > 0, n))), 4), F.lit(0.0)).alias("average_confidence"))


def value_confidence(values: DataFrame, regions: DataFrame, value: str = "value", default: float = 0.85) -> DataFrame:
    """values (doc_id, value) with the confidence of the first region, top down, whose text holds the value."""
    r = regions.select("doc_id", F.lower("text").alias("__text"), F.struct("y1", "x1", "ordinal", "confidence").alias("__r"))
    wanted = F.lower(F.trim(value))
    hits = values.join(r, "doc_id").where((wanted != "") & F.col("__text").contains(wanted)).groupBy("doc_id", value).agg(F.min("__r").alias("__r"))
    return values.join(hits, ["doc_id", value], "left").withColumn("confidence", F.coalesce("__r.confidence", F.lit(default))).drop("__r")


#: Height in pixels of a band in which labels meet values, and the bands that a document has at most.
BAND = 64
BANDS = 1024


def _within_reach(labels: DataFrame, values: DataFrame, card: bool) -> DataFrame:
    """Pairs of a label and a value of its document and field that may stand right of it (way 1) or below it (way 2).

    They meet in bands of the document's height: a value lies in one band a way, a label asks in all that it reaches.
    So pairs grow with what stands at one height, not with the square of the document's regions.
    """
    h = F.col("ly2") - F.col("ly1")
    middle = (F.col("ly1") + F.col("ly2")) / 2.0
    beside = F.greatest(F.lit(15.0), h * 1.2) if card else F.greatest(F.lit(18.0), h * 0.9)
    under = F.greatest(F.lit(35.0), h * 2.5) if card else F.greatest(F.lit(35.0), h * 2.0)
    band = lambda y: F.floor(y / F.col("unit"))
    # a pixel more on either side, for what doubles round
    reach = lambda way, top, bottom: F.struct(F.lit(way).alias("way"), F.greatest(band(top - 1), band(F.col("top"))).alias("a"), F.least(band(bottom + 1), band(F.col("bottom"))).alias("b"))
    asked = labels.select("*", F.inline(F.array(reach(1, middle - beside, middle + beside), reach(2, F.col("ly2") if card else F.col("ly1"), F.col("ly2") + under))))
    asked = asked.where("a <= b").select("*", F.explode(F.sequence("a", "b")).alias("band")).drop("unit", "top", "bottom", "a", "b")
    stands = lambda way, y: F.struct(F.lit(way).alias("way"), band(y).alias("band"))
    given = values.select("*", F.inline(F.array(stands(1, (F.col("y1") + F.col("y2")) / 2.0), stands(2, F.col("y1"))))).drop("unit", "top", "bottom")
    return asked.join(given, ["doc_id", "field", "way", "band"]).drop("band")


def spatial_fields(regions: DataFrame, fields: dict[str, tuple[str, str]], card: bool = False) -> DataFrame:
    """doc_id, field, value, confidence: for each field (label pattern, value pattern) the value in, right of or below the first label that has one.

    card: the wider tolerances of identity cards. Labels are tried top down; a value inside the label wins, then
    the nearest to the right on the same line, then the nearest below. All fields share one join, by bands of height.
    Regions without a place have no neighbours, but a label's own value counts.
    """
    order = Window.partitionBy("doc_id").orderBy("y1", "x1", "ordinal", "text", "confidence")
    whole = Window.partitionBy("doc_id")
    extent = regions.withColumn("place", F.row_number().over(order)).withColumn("top", F.min(F.least("y1", "y2")).over(whole)).withColumn("bottom", F.max(F.greatest("y1", "y2")).over(whole))
    placed = extent.withColumn("unit", F.greatest(F.lit(float(BAND)), (F.col("bottom") - F.col("top")) / F.lit(float(BANDS))))
    found = lambda c, pattern: F.trim(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))
    each = lambda make: F.inline(F.filter(F.array(*[make(name, *pair) for name, pair in fields.items()]), lambda s: s["field"].isNotNull()))
    text = F.trim("text")
    labels = placed.select("doc_id", F.col("place").alias("label_place"), text.alias("label_text"), F.col("confidence").alias("label_confidence"), *[F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")], "unit", "top", "bottom",
                           each(lambda name, label, value: F.struct(F.when(text.rlike(f"(?i){label}"), F.lit(name)).alias("field"), found(text, value).alias("own"))))
    values = placed.select("doc_id", "place", "confidence", "x1", "y1", "x2", "y2", "unit", "top", "bottom", each(lambda name, label, value: F.struct(F.when(text.rlike(value), F.lit(name)).alias("field"), found(text, value).alias("value"))))
    inline = labels.where(F.col("own") != F.col("label_text")).select("doc_id", "field", "label_place", F.lit(0).alias("way"), F.lit(0.0).alias("distance"), F.col("label_place").alias("place"), F.col("own").alias("value"), F.col("label_confidence").alias("confidence"))
    others = _within_reach(labels.drop("label_text", "label_confidence", "own"), values, card).where(F.col("place") != F.col("label_place"))
    h = F.col("ly2") - F.col("ly1")
    shift = F.abs((F.col("y1") + F.col("y2")) / 2.0 - (F.col("ly1") + F.col("ly2")) / 2.0)
    if card:
        right = (shift <= F.greatest(F.lit(15.0), h * 1.2)) & (F.col("x1") >= F.col("lx1"))
        below = (F.col("y1") - F.col("ly2")).between(0, F.greatest(F.lit(35.0), h * 2.5)) & ((F.abs(F.col("x1") - F.col("lx1")) <= 250) | (F.abs(F.col("x2") - F.col("lx2")) <= 250))
    else:
        right = (shift <= F.greatest(F.lit(18.0), h * 0.9)) & (F.col("x1") >= F.col("lx1") + 5)
        below = (F.col("y1") >= F.col("ly1")) & (F.col("y1") - F.col("ly2") <= F.greatest(F.lit(35.0), h * 2.0)) & (F.col("x1") <= F.col("lx2") + 80) & (F.col("x2") >= F.col("lx1") - 40)
    # a value on both ways of a label meets it twice; the right one is less, so it wins
    distance = F.when(F.col("way") == 1, F.col("x1") - F.col("lx2")).otherwise(F.col("y1") - F.col("ly2")).cast("double")
    near = others.where(((F.col("way") == 1) & right) | ((F.col("way") == 2) & below)).select("doc_id", "field", "label_place", "way", distance.alias("distance"), "place", "value", "confidence")
    first = F.min(F.struct("label_place", "way", "distance", "place", "value", "confidence")).alias("f")
    return inline.unionByName(near).groupBy("doc_id", "field").agg(first).select("doc_id", "field", F.col("f.value").alias("value"), F.col("f.confidence").alias("confidence"))


def spatial_values(regions: DataFrame, label: str, pattern: str, card: bool = False) -> DataFrame:
    """``spatial_fields`` of one field: doc_id, value, confidence."""
    return spatial_fields(regions, {"value": (label, pattern)}, card).drop("field")


def grouped_lines(regions: DataFrame, threshold: float = 16.0) -> DataFrame:
    """Words of a document merged into lines: doc_id, line_no, text, confidence, x1, y1, x2, y2.

    Words go, by height of their centres, to the first line whose mean centre is within the threshold. Where two
    centres in order lie further apart than that, no line holds words of both sides: such gaps cut the document into
    islands, and the words of each are dealt to lines by themselves. As centres only grow, a line that a word has left
    behind takes no later one either, so only lines still within reach are kept at hand. All steps share one partitioning.
    """
    from ..functions.fields import english_token

    order = ("cy", "ordinal", "x1", "y1", "x2", "y2", "text", "confidence")
    clean = regions.withColumn("clean", english_token(F.col("text"))).where(F.col("clean") != "")
    words = clean.select("doc_id", ((F.col("y1") + F.col("y2")) / 2.0).alias("cy"), "ordinal", "x1", "y1", "x2", "y2", F.col("clean").alias("text"), "confidence")
    down = Window.partitionBy("doc_id").orderBy(*order)
    gap = (F.col("cy") - F.lag("cy").over(down) > threshold).cast("int")
    cut = words.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("island", F.sum("gap").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    islands = cut.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("words"))
    near = f"filter(s.open, g -> abs(w.cy - g.total / g.n) <= {threshold})"
    empty = "named_struct('open', cast(array() as array<struct<total:double,n:int,line:int>>), 'lines', 0, 'at', cast(array() as array<int>))"
    joined = "named_struct('open', concat(array(named_struct('total', t.open[0].total + t.cy, 'n', t.open[0].n + 1, 'line', t.open[0].line)), slice(t.open, 2, size(t.open))), 'lines', t.lines, 'at', concat(t.at, array(t.open[0].line)))"
    begun = "named_struct('open', array(named_struct('total', t.cy, 'n', 1, 'line', t.lines)), 'lines', t.lines + 1, 'at', concat(t.at, array(t.lines)))"
    step = f"transform(array(named_struct('open', {near}, 'lines', s.lines, 'at', s.at, 'cy', w.cy)), t -> if(size(t.open) > 0, {joined}, {begun}))[0]"
    # an island no higher than the threshold is one line, as means lie between its centres: no need to deal
    low = f"element_at(words, -1).cy - words[0].cy <= {threshold}"
    dealt = islands.withColumn("f", F.expr(f"if({low}, named_struct('lines', 1, 'at', array_repeat(0, size(words))), transform(array(aggregate(words, {empty}, (s, w) -> {step})), s -> named_struct('lines', s.lines, 'at', s.at))[0])"))
    before = Window.partitionBy("doc_id").orderBy("island").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("first", F.coalesce(F.sum("f.lines").over(before), F.lit(0)))
    numbered = counted.select("doc_id", "island", "first", F.inline(F.arrays_zip("words", F.col("f.at").alias("line"))))
    lines = numbered.groupBy("doc_id", "island", (F.col("first") + F.col("line")).cast("int").alias("line_no")).agg(F.array_sort(F.collect_list("words")).alias("words"))
    ordered = F.array_sort(F.transform("words", lambda w: F.struct(w["x1"].alias("x1"), w["cy"].alias("cy"), w["ordinal"].alias("ordinal"), w["text"].alias("text"), w["confidence"].alias("confidence"))))
    length = F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w["text"]))
    weighted = F.aggregate("words", F.lit(0.0), lambda a, w: a + w["confidence"] * F.length(w["text"]))
    return lines.select("doc_id", "line_no", F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.round(weighted / F.greatest(F.lit(1), length), 4).alias("confidence"), F.array_min("words.x1").alias("x1"), F.array_min("words.y1").alias("y1"), F.array_max("words.x2").alias("x2"), F.array_max("words.y2").alias("y2"))


def crop_boxes(labels: DataFrame, width: str, height: str, kind: str = "dob") -> DataFrame:
    """labels (doc_id, x1, y1, x2, y2) and image size -> boxes in which the field's value may stand; tiny ones are left out."""
    h = F.greatest(F.lit(12), F.col("y2") - F.col("y1"))
    reach = (5.0, 7.0, 9.0) if kind == "dob" else (3.5, 5.5, 7.5)
    up, left = lambda c: F.greatest(F.lit(0), c), lambda c: F.least(F.col(width), c)
    down = lambda c: F.least(F.col(height), c)
    whole = lambda c: F.floor(c).cast("int")
    box = lambda name, a, b, c, d: F.struct(F.lit(name).alias("crop"), a.cast("int").alias("cx1"), b.cast("int").alias("cy1"), c.cast("int").alias("cx2"), d.cast("int").alias("cy2"))
    boxes = []
    for k, m in enumerate(reach):
        pad = whole(h * F.lit(0.2 + 0.15 * k))
        boxes.append(box(f"right_var_{k + 1}", up(F.col("x2") - 5), up(F.col("y1") - pad), left(F.col("x2") + whole(h * m)), down(F.col("y2") + pad)))
    boxes.append(box("below", up(F.col("x1") - 10), up(F.col("y2") - 2), left(F.col("x2") + whole(h * 4.0)), down(F.col("y2") + whole(h * 2.2))))
    boxes.append(box("combined_line", up(F.col("x1") - 5), up(F.col("y1") - whole(h * 0.25)), left(F.col("x2") + whole(h * 7.0)), down(F.col("y2") + whole(h * 0.25))))
    kept = F.filter(F.array(*boxes), lambda b: (b["cx2"] - b["cx1"] >= 20) & (b["cy2"] - b["cy1"] >= 10))
    return labels.select("doc_id", F.inline(kept))
