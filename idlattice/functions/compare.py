"""Normalisers of the comparison between printed fields and machine-readable ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
#: Printed names of a field, its machine-readable name, the kind of comparison and the weight of a mismatch.
FIELD_PAIRS = (
    (("passport_number", "document_number", "visa_number", "id_number"), "document_number", "number", 0.90),
    (("date_of_birth", "dob", "birth_date"), "date_of_birth", "date", 0.90),
    (("date_of_expiry", "expiry_date", "expiration_date"), "date_of_expiry", "date", 0.85),
    (("name", "full_name"), "name", "name", 0.75),
    (("sex", "gender"), "sex", "sex", 0.65),
    (("nationality", "country_code"), "nationality", "nationality", 0.75),
)
LEAST_CONFIDENCE = 0.35
HIGH_WEIGHT = 0.85


def _last_two(year: Column) -> Column:
    return F.lpad(F.substring(year, -2, 2), 2, "0")


def comparable_date(value: Column) -> Column:
    """YYMMDD of a date in any of the usual spellings, else null. Impossible days stay, as only spelling matters."""
    text = F.upper(F.trim(value))
    pick = lambda p, g: F.regexp_extract(text, p, g)
    two = lambda c: F.lpad(c, 2, "0")
    dmy, ymd, named = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2,4})$", r"^([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})$", r"^([0-9]{1,2})[\s/-]*([A-Z]{3,9})[\s/-]*([0-9]{2,4})$"
    month = (F.instr(F.lit(MONTHS), F.substring(pick(named, 2), 1, 3)) + 2) / 3
    is_month = text.rlike(named) & (month > 0.9) & (month == F.floor(month))
    digits = F.regexp_replace(text, "[^0-9]", "")
    number = lambda c: c.try_cast("int")
    return (
        F.when(text.rlike("^[0-9]{6}$"), text)
        .when(text.rlike(dmy), F.concat(_last_two(pick(dmy, 3)), two(pick(dmy, 2)), two(pick(dmy, 1))))
        .when(text.rlike(ymd), F.concat(F.substring(pick(ymd, 1), 3, 2), two(pick(ymd, 2)), two(pick(ymd, 3))))
        .when(is_month, F.concat(_last_two(pick(named, 3)), F.lpad(F.floor(month).cast("string"), 2, "0"), two(pick(named, 1))))
        .when(F.length(digits) == 6, digits)
        .when((F.length(digits) == 8) & (number(F.substring(digits, 5, 4)) > 1900), F.concat(F.substring(digits, 7, 2), F.substring(digits, 3, 2), F.substring(digits, 1, 2)))
        .when((F.length(digits) == 8) & (number(F.substring(digits, 1, 4)) > 1900), F.substring(digits, 3, 6))
    )


def comparable_number(value: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9]", ""))


def comparable_name(value: Column) -> Column:
    letters = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z\s]", " "))
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def comparable_sex(value: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(s.isin("M", "MALE", "HOMME", "MASCULINE", "MASCULIN"), "M").when(s.isin("F", "FEMALE", "FEMME", "FEMININE", "FEMININ"), "F").when(s.isin("X", "UNSPECIFIED", "<"), "X").otherwise(F.substring(s, 1, 1))


def comparable_nationality(value: Column) -> Column:
    return F.substring(F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z]", "")), 1, 3)


NORMALIZERS = {"number": comparable_number, "date": comparable_date, "name": comparable_name, "sex": comparable_sex, "nationality": comparable_nationality}


def same_name(a: Column, b: Column) -> Column:
    """Equal, or the words of one all among the other's."""
    x, y = F.split(a, " "), F.split(b, " ")
    return (a == b) | (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
