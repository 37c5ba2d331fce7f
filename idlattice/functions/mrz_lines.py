"""Cleaning of machine-readable lines and of the names in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that OCR reads for a filler, and letters that filler noise consists of.
FILLER_SIGNS = "«‹{([]|"
NOISE = "SREKCX"


def normalize_line(raw: Column) -> Column:
    """Upper case, fillers restored, blanks turned into fillers (name lines) or dropped, other signs dropped."""
    line = F.translate(F.upper(F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")), FILLER_SIGNS, "<" * len(FILLER_SIGNS))
    names = line.startswith("P") & (line.contains("<") | ~F.substring(line, 1, 5).rlike("(?U)[0-9]"))
    spaced = F.when(names, F.replace(line, F.lit(" "), F.lit("<"))).otherwise(F.replace(line, F.lit(" "), F.lit("")))
    return F.regexp_replace(spaced, "[^A-Z0-9<]", "")


def clean_name(part: Column) -> Column:
    """Words of a name without filler noise: runs of three or more noise letters of at most three kinds, and a lone one at the end."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(part, F.lit("")), "<", " "), r"\s+"), lambda w: w != "")
    noise = lambda w: w.rlike(f"^[{NOISE}]{{3,}}$") & (F.size(F.array_distinct(F.filter(F.split(w, ""), lambda c: c != ""))) <= 3)
    lone = lambda w, i: (i > 0) & (i == F.size(words) - 1) & w.rlike(f"^[{NOISE}]$")
    return F.array_join(F.filter(words, lambda w, i: ~noise(F.upper(w)) & ~lone(F.upper(w), i)), " ")


def split_names(raw: Column, cleaned: Column) -> Column:
    """Array of surname and given names of a name field; where ``cleaned`` is false, as on cards, words stay as they are."""
    parts = F.split(F.regexp_replace(raw, "^<+", ""), "<<", 2)
    return F.transform(parts, lambda c: F.when(cleaned, clean_name(c)).otherwise(F.trim(F.replace(c, F.lit("<"), F.lit(" ")))))


def without_fillers(value: Column) -> Column:
    return F.replace(value, F.lit("<"), F.lit(""))
