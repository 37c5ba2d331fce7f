"""Geometry of images as columns, and what OCR passes are made of each: corners, scales, bands, passes, allowed signs.

Pixels are cut and filtered where an image library is at hand; here it is said which ones. Results of passes come back as
tables and go to ``candidates.candidate_sources`` and ``extraction.second_pass_scores``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of a page's height in which a zone is looked for, filters and page modes of the passes.
BAND_RATIOS = (0.20, 0.25, 0.30, 0.35, 0.40)
BAND_FILTERS, BAND_MODES = ("clahe", "otsu", "adaptive", "blackhat"), (6, 4, 11)
CROP_FILTERS, CROP_MODES = ("clahe_sharp", "otsu", "adaptive", "adaptive_sharp"), (7, 8, 6)
MOST_SIDE, LEAST_SIDE = 2400, 300
#: Signs that may stand in a field, as the inside of a character class.
ALLOWED = {"dob": r"0-9/\-. ", "gender": "A-Za-z/ ", "mrz": "A-Z0-9< \t", "other": r"A-Za-z0-9/\-. "}
#: What the recogniser for tests reads on every page.
SAMPLE_PAGE = (("P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", 0.98, 50, 400, 750, 430), ("L898902C36UTO7408122F1204159ZE184226B<<<<<10", 0.97, 50, 440, 750, 470))
#: Content types of face uploads.
FACE_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")


def ordered_corners(points: Column) -> Column:
    """struct(top_left, top_right, bottom_right, bottom_left) of an array of (x, y), by sums and differences; of equal ones the first."""
    placed = F.transform(points, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), (p["y"] - p["x"]).alias("d"), i.alias("i"), p.alias("p")))
    by = lambda key, sign: F.array_min(F.transform(placed, lambda q: F.struct((q[key] * sign).alias("k"), q["i"].alias("i"), q["p"].alias("p"))))["p"]
    return F.struct(by("s", 1).alias("top_left"), by("d", 1).alias("top_right"), by("s", -1).alias("bottom_right"), by("d", -1).alias("bottom_left"))


def flattened_size(corners: Column) -> Column:
    """struct(width, height) of the upright page that ordered corners span: of each pair of sides the longer, whole pixels."""
    side = lambda a, b: F.sqrt(F.pow(corners[a]["x"] - corners[b]["x"], 2) + F.pow(corners[a]["y"] - corners[b]["y"], 2)).cast("int")
    return F.struct(F.greatest(side("bottom_right", "bottom_left"), side("top_right", "top_left")).alias("width"), F.greatest(side("top_right", "bottom_right"), side("top_left", "bottom_left")).alias("height"))


def resized(width: Column, height: Column) -> Column:
    """struct(scale, width, height): pages over MOST_SIDE shrink, else pages under LEAST_SIDE grow."""
    long, short = F.greatest(width, height), F.least(width, height)
    scale = F.when(long > MOST_SIDE, F.lit(float(MOST_SIDE)) / long).when((short < LEAST_SIDE) & (short > 0), F.lit(float(LEAST_SIDE)) / short).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def zone_bands(pages: DataFrame, ratios: tuple[float, ...] = BAND_RATIOS) -> DataFrame:
    """pages (doc_id, width, height) -> doc_id, ratio, y1, y2: bottom bands of a page that are at least 20 by 50 pixels."""
    start = lambda r: F.greatest(F.lit(0), F.least(F.floor(F.col("height") * F.lit(1.0 - r)).cast("int"), F.col("height") - 10))
    bands = F.array(*[F.struct(F.lit(r).alias("ratio"), start(r).alias("y1"), F.col("height").alias("y2")) for r in ratios])
    return pages.select("doc_id", F.inline(F.filter(bands, lambda b: (b["y2"] - b["y1"] >= 20) & (F.col("width") >= 50))))


def zone_passes(bands: DataFrame) -> DataFrame:
    """A row for every recognition of a band: doc_id, ratio, y1, y2, filter, mode, source (its name among candidates), pass_no."""
    made = [(f, m) for f in BAND_FILTERS for m in BAND_MODES]
    passes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("filter"), F.lit(m).alias("mode")) for k, (f, m) in enumerate(made)])
    percent = F.floor(F.col("ratio") * 100).cast("int")
    wide = bands.select("doc_id", "ratio", "y1", "y2", F.inline(passes))
    return wide.select("doc_id", "ratio", "y1", "y2", "filter", "mode", F.format_string("%s_r%d_psm%d", "filter", percent, "mode").alias("source"), (percent * 100 + F.col("k")).alias("pass_no"))


def crop_passes(crops: DataFrame) -> DataFrame:
    """crops (doc_id, crop, cx1, cy1, cx2, cy2) with a row for every filter and mode."""
    made = [(f, m) for f in CROP_FILTERS for m in CROP_MODES]
    return crops.select("*", F.inline(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(m).alias("mode")) for f, m in made])))


def allowed_signs(text: Column, field: str) -> Column:
    """The text without signs that the field can't hold; a zone is read in capitals."""
    return F.regexp_replace(F.upper(text) if field == "mrz" else text, f"[^{ALLOWED.get(field, ALLOWED['other'])}]", "")


def sample_recognition(pages: DataFrame) -> DataFrame:
    """Regions that the recogniser for tests finds on every page: doc_id, ordinal, text, confidence, x1, y1, x2, y2."""
    rows = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(text).alias("text"), F.lit(sure).alias("confidence"), *[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), box, strict=True)]) for k, (text, sure, *box) in enumerate(SAMPLE_PAGE)])
    return pages.select("doc_id", F.inline(rows))


def checked_faces(uploads: DataFrame, most: int = 15 * 1024 * 1024) -> DataFrame:
    """uploads (content_type, length) with error and the status that a service would answer: 400, 413 or null."""
    kind = F.lower("content_type")
    error = F.when(kind.isNotNull() & (kind != "") & ~kind.isin(*FACE_TYPES), "unsupported content type").when(F.col("length") == 0, "empty file").when(F.col("length") > most, "file too large")
    return uploads.withColumn("error", error).withColumn("status", F.when(F.col("error") == "file too large", 413).when(F.col("error").isNotNull(), 400))


def synthetic_blocks(spark: SparkSession, documents: int, per_document: int = 216, seed: int = 7) -> DataFrame:
    """Measured blocks of invented pages for calibration: doc_id, tampered, block, ela, noise, sharpness.

    Every second page has a patch of six blocks with a foreign recompression residual and noise.
    """
    rows = spark.range(documents * per_document).select((F.col("id") / per_document).cast("long").alias("doc_id"), (F.col("id") % per_document).cast("int").alias("block"))
    rows = rows.withColumn("tampered", F.col("doc_id") % 2 == 1).withColumn("patch", F.col("tampered") & F.col("block").between(100, 105))
    near = lambda k, base, spread: F.lit(base) + F.pmod(F.xxhash64(F.lit(seed + k), "doc_id", "block"), F.lit(1000)) / 1000.0 * spread
    return rows.select("doc_id", "tampered", "block", (near(0, 2.0, 0.8) + F.when(F.col("patch"), 30.0).otherwise(0.0)).alias("ela"), (near(1, 3.0, 1.0) + F.when(F.col("patch"), 40.0).otherwise(0.0)).alias("noise"), near(2, 10.0, 2.0).alias("sharpness"))
