"""Comparison of document portraits with selfies, from detections and vectors to a status for every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .faces import MATCH, band, band_colour, cosine, portraits, public_score, selfie_gate, verification_status, with_quality


def verify(pairs: DataFrame, document_faces: DataFrame, selfie_faces: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (doc_id, document_ok, selfie_ok: images that can be read) -> one row each with status, match, scores and band.

    faces: doc_id, ordinal, w, h, confidence, sharpness, brightness of each image's detections; vectors: doc_id, document_vector,
    selfie_vector. Scores are null unless the status is MATCH or NO_MATCH; a pair without vectors is a processing error.
    """
    portrait = with_quality(portraits(document_faces)).select("doc_id", F.col("quality_passed").alias("portrait_ok"), F.col("quality_score").alias("portrait_quality"))
    counted = document_faces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("document_count"))
    selfie = selfie_gate(selfie_faces).select("doc_id", F.col("n_faces").alias("selfie_count"), F.col("status").alias("selfie_status"))
    raw = cosine(F.col("document_vector"), F.col("selfie_vector"))
    scored = vectors.select("doc_id", raw.alias("raw"), (F.col("document_vector").isNull() | F.col("selfie_vector").isNull()).alias("lacks"))
    met = pairs
    for part in (portrait, counted, selfie, scored):
        met = met.join(part, "doc_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    unread = ~(F.coalesce("document_ok", F.lit(False)) & F.coalesce("selfie_ok", F.lit(False)))
    passed = F.coalesce("portrait_ok", F.lit(True)) & (F.col("selfie_status") == "OK")
    several = F.coalesce(F.col("selfie_status") == "MULTIPLE_FACES", F.lit(False))
    score = public_score(F.col("raw"))
    early = verification_status(unread, count("document_count"), count("selfie_count"), several, passed, score)
    lacks = F.coalesce("lacks", F.lit(True))
    status = F.when(early.isin("MATCH", "NO_MATCH") & lacks, "PROCESSING_ERROR").otherwise(early)
    told = met.withColumn("status", status).withColumn("score", F.when(F.col("status").isin("MATCH", "NO_MATCH"), score))
    return told.select(
        "doc_id", (F.col("status") != "PROCESSING_ERROR").alias("success"), "status", F.when(F.col("score").isNotNull(), F.col("score") >= MATCH).alias("is_match"), F.col("score").alias("similarity_score"),
        F.when(F.col("score").isNotNull(), F.round("raw", 4)).alias("raw_cosine"), F.lit(MATCH).alias("threshold"), band(F.col("score")).alias("match_band"), band_colour(F.col("score")).alias("ui_color"), "portrait_quality", count("selfie_count").alias("selfie_faces"),
    )
