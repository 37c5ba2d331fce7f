"""Behaviour of the earlier, smaller service, for those who still depend on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fields import KEYWORDS
from .mrz_digits import digits_from_ocr, letters_from_ocr
from .mrz_lines import FILLER_SIGNS


def normalize_line(raw: Column) -> Column:
    """Every blank becomes a filler."""
    line = F.translate(F.upper(F.trim(raw)), FILLER_SIGNS + " ", "<" * (len(FILLER_SIGNS) + 1))
    return F.regexp_replace(line, "[^A-Z0-9<]", "")


def substituted_second_line(line: Column) -> Column:
    """Passport line 2 with letters read as digits in dates and check digits, and digits as letters in the nationality, unproven."""
    cut = lambda a, b: F.substring(line, a + 1, b - a)
    return F.concat(cut(0, 9), digits_from_ocr(cut(9, 10)), letters_from_ocr(cut(10, 13)), digits_from_ocr(cut(13, 20)), cut(20, 21), digits_from_ocr(cut(21, 28)), cut(28, 42), digits_from_ocr(cut(42, 44)))


def classify(text: Column) -> Column:
    """Passport words come before visa words."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    has = lambda kind: F.exists(F.array(*map(F.lit, KEYWORDS[kind])), lambda w: upper.contains(w))
    return F.when(has("passport"), "passport").when(has("visa"), "visa").otherwise("national_id")


def sex_of(text: Column) -> Column:
    """M is looked for first, so that FEMALE reads as M."""
    upper = F.upper(text)
    return F.when(upper.contains("M"), "M").when(upper.contains("F"), "F").otherwise("X")


def first_pair(lines: DataFrame) -> DataFrame:
    """lines (doc_id, pos, line) -> doc_id, line1, line2: the first two neighbours of 40 to 46 characters after normalising."""
    shaped = lines.withColumn("n", normalize_line(F.col("line"))).withColumn("next", F.lead("n").over(Window.partitionBy("doc_id").orderBy("pos")))
    pairs = shaped.where(F.length("n").between(40, 46) & F.length("next").between(40, 46))
    return pairs.groupBy("doc_id").agg(F.min_by(F.struct("n", "next"), "pos").alias("p")).select("doc_id", F.col("p.n").alias("line1"), F.col("p.next").alias("line2"))


_DAY = r"([0-9]{2}[/-][0-9]{2}[/-][0-9]{4}|[0-9]{4}[/-][0-9]{2}[/-][0-9]{2})"
_DAY_OR_MONTH = r"([0-9]{2}[/-][0-9]{2}[/-][0-9]{4}|[0-9]{2}[A-Za-z]{3}[0-9]{4})"
#: Patterns of the earlier extractors; (pattern, whether case matters), the first that matches wins.
PASSPORT = {
    "passport_number": ((r"\b([A-Z][0-9]{7,8}|[A-Z0-9]{8,9})\b", True),),
    "date_of_birth": ((r"(?:DOB|Date of Birth|Birth Date)[:\s]+" + _DAY, False),),
    "date_of_expiry": ((r"(?:Date of Expiry|Expiry Date|Expires)[:\s]+" + _DAY, False),),
    "sex": ((r"(?:Sex|Gender)[:\s]+([MFX]|MALE|FEMALE)", False),),
}
VISA = {
    "visa_number": ((r"(?:Visa No|Control Number|Document No|Visa Number)[:\s]+([A-Z0-9]{7,12})", False), (r"\b([A-Z]\d{7,9}|\d{8,9})\b", True)),
    "name": ((r"(?:Name|Full Name|Given Name)[:\s]+([A-Za-z\s]+)(?:\n|$)", False),),
    "passport_number": ((r"(?:Passport No|Passport Number)[:\s]+([A-Z0-9]{7,10})", False),),
    "visa_type": ((r"(?:Type / Class|Visa Type|Class|Category)[:\s]+([A-Z0-9/-]+)", False),),
    "entries": ((r"(?:Entries|Number of Entries)[:\s]+(MULTIPLE|SINGLE|DOUBLE|M|S|1|2|\b[0-9]\b)", False),),
    "issue_date": ((r"(?:Issue Date|Date of Issue|Issued)[:\s]+" + _DAY_OR_MONTH, False),),
    "expiry_date": ((r"(?:Expiry Date|Expiration Date|Expires On|Valid Until)[:\s]+" + _DAY_OR_MONTH, False),),
    "nationality": ((r"(?:Nationality)[:\s]+([A-Za-z]+)", False),),
    "issuing_authority": ((r"(?:Authority|Issuing Post|Issued By)[:\s]+([A-Za-z\s,]+)(?:\n|$)", False),),
}
NATIONAL_ID = {
    "id_number": ((r"\b([0-9]{4}\s[0-9]{4}\s[0-9]{4})\b", True), (r"(?:ID No|Identity No|National ID|Card No|Document No)[:\s]+([A-Z0-9-]+)", False), (r"\b([A-Z]{1,3}[0-9]{6,10}|[0-9]{9,12})\b", True)),
    "name": ((r"(?:Name|Full Name|Holder)[:\s]+([A-Za-z\s]+)(?:\n|$)", False),),
    "date_of_birth": ((r"(?:DOB|Date of Birth|Birth Date|Year of Birth)[:\s]+([0-9]{2}[/-][0-9]{2}[/-][0-9]{4}|[0-9]{4})", False),),
    "gender": ((r"(?:Gender|Sex)[:\s]+(MALE|FEMALE|M|F|OTHER|X)", False),),
    "nationality": ((r"(?:Nationality|Citizen of)[:\s]+([A-Za-z]+)", False),),
    "address": ((r"(?:Address|Permanent Address)[:\s]+([^\n]+(?:\n[^\n]+)?)", False),),
}
_TRIMMED = ("name", "issuing_authority", "address")
_CAPITALS = ("entries", "nationality", "gender")
_ZONE_OF_VISA = {"passport_number": ("passport_number",), "nationality": ("nationality",), "date_of_birth": ("date_of_birth",), "expiry_date": ("date_of_expiry",)}
_ZONE_OF_ID = {"date_of_birth": "date_of_birth", "gender": "sex", "nationality": "nationality"}


def _printed(text: Column, name: str, options: tuple[tuple[str, bool], ...]) -> Column:
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p if cased else "(?i)" + p, 1), F.lit("")) for p, cased in options])
    if name in _TRIMMED:
        found = F.regexp_replace(found, r"^\s+|\s+$", "")
    return F.replace(found, F.lit("\n"), F.lit(", ")) if name == "address" else F.upper(found) if name in _CAPITALS else found


def extracted(documents: DataFrame, kind: str) -> DataFrame:
    """documents (doc_id, text, fields: the zone's map, empty or null for none) with the columns of the earlier extractor of ``kind``.

    A passport's zone stands alone; a visa's zone comes before the print, a national id's behind it.
    """
    zone = lambda k: F.nullif(F.try_element_at(F.col("fields"), F.lit(k)), F.lit(""))
    zoned = F.coalesce(F.size("fields"), F.lit(0)) > 0
    full = F.nullif(F.trim(F.concat_ws(" ", zone("surname"), zone("given_names"))), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    if kind == "passport":
        printed = {n: _printed(text, n, p) for n, p in PASSPORT.items()}
        sex = F.upper(printed["sex"])
        printed["sex"] = F.when(sex.contains("M"), "M").when(sex.contains("F"), "F").when(sex.isNotNull(), "X")
        names = (*printed, "surname", "given_names", "nationality", "issuing_state", "personal_number")
        made = {n: F.when(zoned, F.coalesce(zone(n), zone("document_number")) if n == "passport_number" else zone(n)).otherwise(printed.get(n, F.lit(None).cast("string"))) for n in names}
    elif kind == "visa":
        printed = {n: _printed(text, n, p) for n, p in VISA.items()}
        made = printed | {n: F.coalesce(*[zone(k) for k in keys], printed.get(n, F.lit(None).cast("string"))) for n, keys in _ZONE_OF_VISA.items()} | {"name": F.coalesce(full, printed["name"])}
    else:
        printed = {n: _printed(text, n, p) for n, p in NATIONAL_ID.items()}
        made = printed | {n: F.coalesce(printed[n], zone(k)) for n, k in _ZONE_OF_ID.items()} | {"name": F.coalesce(printed["name"], full)}
    return documents.select("doc_id", *[c.alias(n) for n, c in made.items()])


def zone_of(region_lines: DataFrame, text_lines: DataFrame) -> DataFrame:
    """doc_id, line1, line2 (corrected without proof): the first pair among a document's regions, else among its text's lines."""
    first, second = first_pair(region_lines), first_pair(text_lines)
    found = first.unionByName(second.join(first, "doc_id", "left_anti"))
    return found.select("doc_id", F.rpad("line1", 44, "<").alias("line1"), substituted_second_line(F.rpad("line2", 44, "<")).alias("line2"))
