"""Face comparison on embeddings and detections: similarity, bands, quality, choice of faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH = 0.75
MIN_SIZE, BLUR, DARK, BRIGHT = 60, 40.0, 30.0, 240.0


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision, within -1 and 1; 0 for null or zero vectors."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.coalesce(F.when(a.isNull() | b.isNull() | (norm < 1e-12), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(_dot(a, b), norm)))), F.lit(0.0))


def public_score(similarity: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity)), 4)


def band(score: Column) -> Column:
    return F.when(score.isNull(), "NOT_EVALUATED").when(score >= 0.80, "STRONG_MATCH").when(score >= 0.75, "BORDERLINE_MATCH").when(score >= 0.60, "MANUAL_REVIEW").otherwise("NO_MATCH")


def band_colour(score: Column) -> Column:
    return F.when(score.isNull(), "GRAY").when(score >= 0.80, "GREEN").when(score >= 0.75, "YELLOW").when(score >= 0.60, "ORANGE").otherwise("RED")


def verification_status(error: Column, document_faces: Column, selfie_faces: Column, multiple: Column, quality_ok: Column, score: Column) -> Column:
    """First state that applies: an error, no face, several faces, poor quality, then match or not."""
    return F.when(error, "PROCESSING_ERROR").when((document_faces == 0) | (selfie_faces == 0), "NO_FACE").when(multiple, "MULTIPLE_FACES").when(~quality_ok, "INSUFFICIENT_QUALITY").when(score >= MATCH, "MATCH").otherwise("NO_MATCH")


def with_quality(faces: DataFrame) -> DataFrame:
    """faces (w, h, sharpness, brightness) with quality_score and quality_passed."""
    w, h, sharp, light = F.col("w"), F.col("h"), F.col("sharpness"), F.col("brightness")
    size = F.when((w < MIN_SIZE) | (h < MIN_SIZE), F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.least(w, h) / MIN_SIZE))).otherwise(1.0)
    blur = F.when(sharp < BLUR, F.greatest(F.lit(0.1), F.least(F.lit(1.0), sharp / BLUR))).otherwise(F.least(F.lit(1.0), 0.70 + sharp / 200.0 * 0.30))
    lit = F.when(light < DARK, F.greatest(F.lit(0.1), light / DARK)).when(light > BRIGHT, F.greatest(F.lit(0.1), (255.0 - light) / (255.0 - BRIGHT))).otherwise(1.0)
    aspect = h / F.greatest(F.lit(1), w)
    shape = F.when((aspect < 0.60) | (aspect > 2.0), 0.5).otherwise(1.0)
    passed = (w >= MIN_SIZE) & (h >= MIN_SIZE) & (sharp >= BLUR * 0.5) & light.between(20.0, 245.0)
    return faces.withColumn("quality_score", F.floor((size + blur + lit + shape) / 4.0 * 10000 + 0.5000001) / 10000.0).withColumn("quality_passed", passed)


def portraits(faces: DataFrame) -> DataFrame:
    """The face of largest area times confidence of each document; of equal ones the first, of equal ordinals the sharpest, whatever the order of rows."""
    rest = [F.col(c).desc() for c in ("sharpness", "brightness", "w", "h", "confidence")]
    order = Window.partitionBy("doc_id").orderBy((F.col("w") * F.col("h") * F.col("confidence")).desc(), "ordinal", *rest)
    return faces.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def selfie_gate(faces: DataFrame) -> DataFrame:
    """doc_id, n_faces, status: MULTIPLE_FACES if the second face has 30 % of the first one's area, else OK or INSUFFICIENT_QUALITY."""
    order = Window.partitionBy("doc_id").orderBy((F.col("w") * F.col("h")).desc(), "ordinal")
    ranked = with_quality(faces).withColumn("n", F.row_number().over(order)).withColumn("area", F.col("w") * F.col("h"))
    per = ranked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_faces"), F.max(F.when(F.col("n") == 1, F.col("area"))).alias("a1"), F.max(F.when(F.col("n") == 2, F.col("area"))).alias("a2"), F.max(F.when(F.col("n") == 1, F.col("quality_passed"))).alias("ok"))
    status = F.when(F.coalesce(F.col("a2") >= 0.30 * F.col("a1"), F.lit(False)), "MULTIPLE_FACES").when(F.col("ok"), "OK").otherwise("INSUFFICIENT_QUALITY")
    return per.select("doc_id", "n_faces", status.alias("status"))
