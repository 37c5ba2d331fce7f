"""Machine-readable-zone characters: values, check digits, OCR confusions, calendar plausibility (ICAO Doc 9303)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = (7, 3, 1)
#: What OCR reads for digits, and for letters.
DIGIT_CONFUSIONS = ("ODQILlZSB", "000111258")
FIELD_CONFUSIONS = ("ODQILlZSBJg", "00011125899")
ALPHA_CONFUSIONS = ("01258", "OIZSB")


def char_value(char: Column) -> Column:
    """0-9 as they are, A-Z from 10 to 35 in either case, anything else 0."""
    return F.greatest(F.instr(F.lit(ALPHABET), F.upper(char)) - 1, F.lit(0))


def char_at(value: Column, index: int) -> Column:
    return F.substring(value, index + 1, 1)


def weighted_sum(value: Column, width: int) -> Column:
    """Sum of values times weights over a field of fixed width.

    Up to nine characters it is unrolled, so that it stays in generated code; a longer sum would make methods too large for the
    JVM's compiler, and runs over an array.
    """
    if width > 9:
        return _sum_of(F.substring(value, 1, width))
    terms = [char_value(char_at(value, i)) * WEIGHTS[i % 3] for i in range(width)]
    return sum(terms[1:], terms[0])


def _sum_of(value: Column) -> Column:
    chars = F.transform(F.split(value, ""), lambda c, i: char_value(c) * F.element_at(F.array(*map(F.lit, WEIGHTS)), (i % 3 + 1).cast("int")))
    return F.aggregate(chars, F.lit(0), lambda a, x: a + x)


def check_digit(value: Column, width: int | None = None) -> Column:
    """Check digit of a field; without a width, of a string of any length."""
    if width is not None:
        return weighted_sum(value, width) % 10
    return _sum_of(value) % 10


def digit_matches(total: Column, digit: Column) -> Column:
    """Whether a digit character fits a weighted sum; a filler counts as 0, as the sum of an all-filler field does."""
    number = F.instr(F.lit("0123456789"), F.translate(digit, "<", "0")) - 1
    return F.coalesce((F.length(digit) == 1) & (total % 10 == number), F.lit(False))


def is_valid_digit(value: Column, digit: Column, width: int | None = None) -> Column:
    """Whether ``digit`` is the check digit of ``value``; null, blank and other characters are not."""
    total = weighted_sum(value, width) if width is not None else check_digit(value)
    return digit_matches(total, digit)


def digits_from_ocr(value: Column) -> Column:
    return F.translate(value, *DIGIT_CONFUSIONS)


def letters_from_ocr(value: Column) -> Column:
    return F.translate(value, *ALPHA_CONFUSIONS)


_MONTH_AND_DAY = "(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])"
MONTH_AND_DAY_FIT = f"(?s)^..{_MONTH_AND_DAY}"


def month_and_day_fit(value: Column) -> Column:
    """YYMMDD: month 1-12 and day 1-31; only these four characters need be digits."""
    return F.coalesce(value.rlike(MONTH_AND_DAY_FIT), F.lit(False))


def is_calendar_date(value: Column) -> Column:
    """Six digits with month 1-12 and day 1-31; month lengths are not looked at."""
    return F.coalesce(value.rlike(f"^[0-9]{{2}}{_MONTH_AND_DAY}$"), F.lit(False))
