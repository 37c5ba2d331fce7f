"""Corrections of zone characters that a check digit proves or a sign's place gives away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mrz_digits import FIELD_CONFUSIONS, is_valid_digit

CORRECTION = "array<struct<line:int,position:int,from_char:string,to_char:string,field:string>>"


def correct_trailing_fillers(line1: Column) -> Column:
    """K, E, C behind the names read as fillers: from two past the last other letter, and never before 30."""
    names = F.substring(line1, 6, 100)
    last = F.length(F.regexp_extract(names, "^(.*[A-Z&&[^KEC]])", 1))
    start = F.when(last > 0, F.greatest(F.lit(30), last + 4 + 2)).otherwise(F.lit(30))
    after = F.concat(F.substring(line1, F.lit(1), start), F.translate(F.substring(line1, start + 1, F.lit(100)), "KEC", "<<<"))
    return F.when(names.contains("<<"), after).otherwise(line1)


def correct_sex(raw: Column) -> Column:
    return F.when(raw.isin("0", "1", "I", "L"), F.lit("<")).when(raw == "E", F.lit("F")).otherwise(raw)


def correct_composite(payload: Column, digit: Column) -> Column:
    read = F.translate(digit, *FIELD_CONFUSIONS)
    return F.when((read != digit) & is_valid_digit(payload, read), read).otherwise(digit)
