"""Submissions and what is shown of them: four documents of one person, records for storage, projections, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .screening import visa_type

_OCR = {
    "passport": "passport_number string, full_name string, date_of_birth date, expiry_date date, nationality string, mrz_ok boolean",
    "visa": "visa_number string, visa_text string, valid_until date, stay_days int",
    "national_id": "id_number string, full_name string, date_of_birth date",
}


def submissions(claims: DataFrame, passports: DataFrame, visas: DataFrame, national_ids: DataFrame, portraits: DataFrame) -> DataFrame:
    """Screenings of which all four documents came: claims (screening_id, claimed_nationality, created_at) with a struct of each.

    Each table has screening_id and its own columns; of several rows for one screening the first in order of all columns counts.
    """
    out = claims
    for name, table in (("passport", passports), ("visa", visas), ("national_id", national_ids), ("portrait", portraits)):
        own = F.struct(*[f"`{c}`" for c in table.columns if c != "screening_id"])
        out = out.join(table.groupBy("screening_id").agg(F.min(own).alias(name)), "screening_id")
    return out


def missing_documents(claims: DataFrame, **tables: DataFrame) -> DataFrame:
    """screening_id, missing: names of the tables that lack a claim's row, for claims that lack any."""
    out = claims.select("screening_id")
    for name, table in tables.items():
        out = out.join(table.select("screening_id").distinct().withColumn(f"has_{name}", F.lit(True)), "screening_id", "left")
    gone = F.filter(F.array(*[F.when(F.col(f"has_{n}").isNull(), F.lit(n)) for n in tables]), lambda x: x.isNotNull())
    return out.select("screening_id", gone.alias("missing")).where(F.size("missing") > 0)


def passport_records(submitted: DataFrame) -> DataFrame:
    return submitted.select("screening_id", F.col("passport.passport_number").alias("passport_number"), F.col("passport.full_name").alias("passport_name"), F.col("passport.date_of_birth").alias("passport_dob"), F.col("passport.expiry_date").alias("passport_expiry"), F.col("passport.nationality").alias("passport_nationality"), F.col("passport.mrz_ok").alias("mrz_ok"))


def visa_records(submitted: DataFrame) -> DataFrame:
    return submitted.select("screening_id", F.col("visa.visa_number").alias("visa_number"), F.col("visa.visa_text").alias("visa_text"), visa_type(F.col("visa.visa_text")).alias("visa_type"), F.col("visa.valid_until").alias("visa_until"), F.col("visa.stay_days").alias("stay_days"))


def national_id_records(submitted: DataFrame) -> DataFrame:
    return submitted.select("screening_id", F.col("national_id.id_number").alias("nid_number"), F.col("national_id.full_name").alias("nid_name"), F.col("national_id.date_of_birth").alias("nid_dob"))


def screening_rows(submitted: DataFrame, checks: DataFrame) -> DataFrame:
    """What ``screening.validate`` reads: the three records side by side with the image checks (screening_id, face_score, photo_score, metadata_anomaly)."""
    claims = submitted.select("screening_id", "created_at", "claimed_nationality")
    found = claims
    for part in (passport_records(submitted), visa_records(submitted), national_id_records(submitted), checks):
        found = found.join(part, "screening_id", "left")
    return found


def find_by_national_id(screenings: DataFrame, national_ids: DataFrame, number: str) -> DataFrame:
    """Screenings whose national id bears the number; the filter reaches the scan of the ids."""
    wanted = national_ids.where(F.col("id_number") == number).select("screening_id").distinct()
    return screenings.join(wanted, "screening_id", "left_semi")


def projections(assessed: DataFrame) -> DataFrame:
    """screening_id with what a client sees: extracted data, biometric and tampering results, verdict."""
    extracted = F.struct("passport_number", "passport_name", "passport_nationality", "visa_number", "visa_type", "nid_name")
    return assessed.select("screening_id", extracted.alias("extracted"), F.struct("face_score", (F.col("face_score") >= 0.75).alias("is_match")).alias("biometric"), F.struct("photo_score", "metadata_anomaly").alias("tampering"), F.struct("risk", "category", "verdict", "status", "reasons").alias("decision"))


#: Status words in groups, with the label and colour that a screen shows for each.
STATUS_LABELS = {
    ("VERIFIED", "PASSED", "APPROVED"): ("VERIFIED & CLEARED", "emerald"),
    ("FLAGGED", "WARNING"): ("FLAGGED / CAUTION", "amber"),
    ("MANUAL_REVIEW", "REVIEW_REQUIRED"): ("MANUAL REVIEW REQUIRED", "indigo"),
    ("REJECTED", "FAILED"): ("REJECTED", "rose"),
}
#: The same of verdicts, with what is said of them; other verdicts are reviewed by hand.
BANNERS = {
    ("ALLOW", "PASSED"): ("emerald", "Automated clearance authorized. Low risk tier, verified biometrics, and zero forensic anomalies."),
    ("REJECT", "FAILED"): ("rose", "Immediate entry denial / rejection. High risk score or critical forensic tampering detected."),
}
REVIEW_BANNER = ("amber", "Manual border officer inspection required. Discrepancies flagged for secondary verification.")


def _grouped(word: Column, groups: dict, names: tuple[str, str], otherwise: tuple[str, str]) -> Column:
    of = lambda pair: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, pair, strict=True)])
    found = F.coalesce(*[F.when(F.upper(word).isin(*words), of(pair)) for words, pair in groups.items()])
    return F.coalesce(found, of(otherwise))


def status_label(status: Column) -> Column:
    """struct(label, colour) of a status."""
    return _grouped(status, STATUS_LABELS, ("label", "colour"), ("PROCESSING OCR", "sky"))


def verdict_banner(verdict: Column) -> Column:
    """struct(colour, text) of a verdict."""
    return _grouped(verdict, BANNERS, ("colour", "text"), REVIEW_BANNER)


def risk_colour(risk: Column) -> Column:
    return F.when(risk < 30, "emerald").when(risk < 60, "amber").otherwise("rose")


def stub_extractions(spark: SparkSession, name: str) -> DataFrame:
    """An empty table with the columns of one document's OCR, for runs without recognition."""
    return spark.createDataFrame([], f"screening_id string, {_OCR[name]}")


def stub_checks(claims: DataFrame) -> DataFrame:
    """Image checks that find nothing, for every claim."""
    return claims.select("screening_id", F.lit(0.0).alias("face_score"), F.lit(0.0).alias("photo_score"), F.lit(False).alias("metadata_anomaly"))
