"""Rules across a person's documents, risk score, verdict and review queue.

A screening row holds what was read of passport, visa and national id, what was claimed, and the scores of the
image checks. "Today" is always the parameter ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of visa with the longest stay in days, and their names as printed.
STAYS = {"TOURIST": 90, "BUSINESS": 180, "STUDENT": 365, "WORK_PERMIT": 730, "TRANSIT": 5, "DIPLOMATIC": 365}
PRINTED = {"WORKPERMIT": "WORK_PERMIT"}


def visa_type(text: Column) -> Column:
    """Type by its name in any case, blanks as underscores; other spellings are none."""
    names = [x for k in STAYS for x in (k, k)] + [x for kv in PRINTED.items() for x in kv]
    return F.try_element_at(F.create_map(*map(F.lit, names)), F.replace(F.upper(F.trim(text)), F.lit(" "), F.lit("_")))


def whole_years(born: Column, as_of: Column) -> Column:
    """Completed years, truncated toward zero: a birth less than a year ahead is age 0."""
    def number(d: Column) -> Column:
        return (F.year(d) * 12 + F.month(d)) * 32 + F.dayofmonth(d)

    days = number(as_of) - number(born)
    months = F.signum(days).cast("int") * F.floor(F.abs(days) / 32).cast("int")
    return F.signum(months).cast("int") * F.floor(F.abs(months) / 12).cast("int")


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "")


def without_lookalikes(name: Column) -> Column:
    return F.translate(name, "015", "ols")


def rules(as_of: Column) -> dict[str, Column]:
    """Message of each broken rule, null where it holds or can't be judged; in the order of the report."""
    text = lambda c: F.col(c).cast("string")
    age = whole_years(F.col("passport_dob"), as_of)
    a, b = normalized_name(F.col("passport_name")), normalized_name(F.col("nid_name"))
    most = F.try_element_at(F.create_map(*[F.lit(x) for kv in STAYS.items() for x in kv]), F.col("visa_type"))
    return {
        "passport_expired": F.when(F.col("passport_expiry") < as_of, F.concat(F.lit("Passport has expired on "), text("passport_expiry"))),
        "visa_expired": F.when(F.col("visa_until") < as_of, F.concat(F.lit("Visa has expired on "), text("visa_until"))),
        "age": F.when((age < 0) | (age > 120), F.concat(F.lit("Invalid date of birth: calculated age ("), age.cast("string"), F.lit(") is outside realistic human bounds"))),
        "nationality": F.when(F.lower("passport_nationality") != F.lower(F.trim("claimed_nationality")), F.concat(F.lit("Claimed nationality ("), F.col("claimed_nationality"), F.lit(") mismatches passport nationality ("), F.col("passport_nationality"), F.lit(")"))),
        "name": F.when(a != b, F.when(without_lookalikes(a) == without_lookalikes(b), F.lit("Suspicious character substitution detected between Passport name and National ID name")).otherwise(F.concat(F.lit("Name mismatch between Passport ("), F.col("passport_name"), F.lit(") and National ID ("), F.col("nid_name"), F.lit(")")))),
        "dob": F.when(F.col("passport_dob") != F.col("nid_dob"), F.concat(F.lit("Date of birth mismatch between Passport ("), text("passport_dob"), F.lit(") and National ID ("), text("nid_dob"), F.lit(")"))),
        "stay": F.when(F.col("stay_days") > most, F.concat(F.lit("Stay duration ("), text("stay_days"), F.lit(" days) exceeds maximum allowed threshold for "), F.col("visa_type"), F.lit(" ("), most.cast("string"), F.lit(" days)"))).when(F.col("visa_type").isNull() & F.col("visa_number").isNotNull(), F.lit("Unrecognized or missing visa classification type")),
        "mrz": F.when(~F.col("mrz_ok"), F.lit("ICAO 9303 MRZ Checksum verification failed: Document number, DOB, or Expiry has been altered")),
    }


def validate(screenings: DataFrame, as_of: str) -> DataFrame:
    """screenings with errors, is_valid and the four flags; age, stay and zone show in is_valid only."""
    found = rules(F.lit(as_of).cast("date"))
    held = screenings.withColumns({f"__{k}": v for k, v in found.items()})
    errors = F.filter(F.array(*[F.col(f"__{k}") for k in found]), lambda e: e.isNotNull())
    ok = lambda *names: F.coalesce(*[F.col(f"__{n}") for n in names]).isNull()
    return held.withColumns({"errors": errors, "name_consistent": ok("name"), "dob_consistent": ok("dob"), "nationality_consistent": ok("nationality"), "expired": ~ok("passport_expired", "visa_expired")}).withColumn("is_valid", F.size("errors") == 0).drop(*[f"__{k}" for k in found])


def assess(validated: DataFrame) -> DataFrame:
    """validated with risk (0 to 100), category, verdict, status and the reasons in order."""
    face, photo = F.coalesce(F.col("face_score") < 0.75, F.lit(False)), F.coalesce(F.col("photo_score") > 0.50, F.lit(False))
    invalid, meta = ~F.col("is_valid"), F.coalesce(F.col("metadata_anomaly"), F.lit(False))
    points = lambda c, n: F.when(c, n).otherwise(0)
    risk = F.least(F.lit(100), points(face, 40) + points(photo, 30) + points(invalid, 25) + points(meta, 15))
    own = F.array(F.when(face, "Biometric facial similarity below threshold"), F.when(photo, "Photo tampering detected by ELA"), F.when(invalid, "Document failed field integrity / ICAO checksum checks"), F.when(meta, "Metadata anomaly or editing artifacts present"))
    out = validated.withColumn("risk", risk.cast("int")).withColumn("reasons", F.concat(F.coalesce("anomalies", F.array().cast("array<string>")), "errors", F.filter(own, lambda r: r.isNotNull())))
    high, medium = F.col("risk") >= 60, F.col("risk") >= 30
    return out.withColumns({"category": F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"), "verdict": F.when(high, "REJECT").when(medium, "MANUAL_REVIEW_REQUIRED").otherwise("ALLOW"), "status": F.when(medium, "FLAGGED_FOR_ADMIN").otherwise("PASSED")})


def review_queue(assessed: DataFrame, page: int = 0, size: int = 20, page_first: bool = False) -> DataFrame:
    """A page of flagged screenings, newest first. page_first: page over all and filter then, so that pages come short."""
    flagged = F.col("status").isin("FLAGGED_FOR_ADMIN", "SUSPICIOUS")
    order = [F.col("created_at").desc(), F.col("screening_id")]
    if page_first:
        return assessed.orderBy(*order).offset(page * size).limit(size).where(flagged)
    return assessed.where(flagged).orderBy(*order).offset(page * size).limit(size)


def find_by_number(screenings: DataFrame, number: str, column: str = "passport_number") -> DataFrame:
    """Screenings of a passport (or national id) number; the filter reaches the scan."""
    return screenings.where(F.col(column) == number)
