"""Values beside labels: bands of height against all pairs of a document, and how many pairs meet."""

import random
import re

import pytest
from pyspark.sql import functions as F

from idlattice.operators import extraction, regions

COLUMNS = "doc_id long, ordinal int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"
FIELDS = {"name": (r"\bName\b", r"([A-Z][a-z]+ [A-Z][a-z]+)"), "birth": (r"\b(?:DOB|Birth)\b", r"(\d{2}/\d{2}/\d{4})")}
TEXTS = ("Name", "Full Name", "DOB", "Date of Birth", "DOB 15/08/1990", "Elena Rostova", "Anna Berg", "01/02/1980", "30/12/1999", "ROSTOVA", "", None, " Name  ", "Name Ada Byron")


def page(rng, doc, n, height):
    out = []
    for k in range(n):
        x, y, tall = rng.randrange(600), rng.randrange(height), rng.choice((8, 12, 20, 20, 60, 300, -5))
        spot = (x, y, x + rng.randrange(20, 200), y + tall)
        if rng.random() < 0.03:
            spot = (*spot[:1], None, *spot[2:])
        out.append((doc, rng.choice((k, 0)), rng.choice(TEXTS), round(rng.random(), 2), *spot))
    return out + out[:1]


def all_pairs(rows, label, value, card):
    """(value, confidence) of one field of one document, by trying every label with every value."""
    null_first = lambda x: (x is not None, x)
    rows = sorted(rows, key=lambda r: tuple(map(null_first, (r[5], r[4], r[1], r[2], r[3]))))
    best = None
    for a, (_, _, text, sure, lx1, ly1, lx2, ly2) in enumerate(rows):
        text = (text or "").strip(" ")
        if not re.search(f"(?i){label}", text):
            continue
        offers = []
        own = re.search(value, text)
        if own and own.group(1) != text:
            offers.append((0, 0.0, a, own.group(1), sure))
        for b, (_, _, other, its, x1, y1, x2, y2) in enumerate(rows):
            hit = re.search(value, (other or "").strip(" "))
            if a == b or not hit or None in (lx1, ly1, lx2, ly2, x1, y1, x2, y2):
                continue
            h, shift = ly2 - ly1, abs((y1 + y2) / 2 - (ly1 + ly2) / 2)
            if card:
                right = shift <= max(15, h * 1.2) and x1 >= lx1
                below = 0 <= y1 - ly2 <= max(35, h * 2.5) and (abs(x1 - lx1) <= 250 or abs(x2 - lx2) <= 250)
            else:
                right = shift <= max(18, h * 0.9) and x1 >= lx1 + 5
                below = y1 >= ly1 and y1 - ly2 <= max(35, h * 2.0) and x1 <= lx2 + 80 and x2 >= lx1 - 40
            if right:
                offers.append((1, float(x1 - lx2), b, hit.group(1), its))
            elif below:
                offers.append((2, float(y1 - ly2), b, hit.group(1), its))
        if offers and best is None:
            best = min(offers)[3:]
    return best


@pytest.mark.parametrize("card", [False, True])
def test_bands_find_what_all_pairs_find(spark, card):
    rng = random.Random(21 + card)
    pages = {doc: page(rng, doc, n, height) for doc, (n, height) in enumerate([(1, 50), (5, 100), (12, 200), (30, 900), (60, 4000), (25, 300000), (40, 64), *[(10, 400)] * 30])}
    table = spark.createDataFrame([r for rows in pages.values() for r in rows], COLUMNS)
    got = {(r.doc_id, r.field): (r.value, r.confidence) for r in regions.spatial_fields(table, FIELDS, card).collect()}
    want = {(doc, field): found for doc, rows in pages.items() for field, pair in FIELDS.items() if (found := all_pairs(rows, *pair, card))}
    assert got == want and len(want) > 30
    clashing = table.select("*", F.lit(1).alias("band"), F.lit(2).alias("way"), F.lit(3).alias("unit"), F.lit("x").alias("value"))
    assert {(r.doc_id, r.field): (r.value, r.confidence) for r in regions.spatial_fields(clashing, FIELDS, card).collect()} == want
    assert regions.spatial_fields(table.where("false"), FIELDS, card).count() == 0


def test_pairs_grow_with_regions_not_their_square(spark):
    def met(n):
        lines = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit("name").alias("field"), "id")
        side = lambda mark: [F.col("id").alias(f"{mark}place"), *[F.expr(e).cast("int").alias(f"{mark}{c}") for c, e in (("x1", "10"), ("y1", "id * 30"), ("x2", "90"), ("y2", "id * 30 + 12"))]]
        grid = [F.lit(max(64.0, n * 30 / 1024)).alias("unit"), F.lit(0).alias("top"), F.lit(n * 30).alias("bottom")]
        return regions._within_reach(lines.select("doc_id", "field", *side("l"), *grid).withColumnRenamed("lplace", "label_place"), lines.select("doc_id", "field", *side(""), *grid), False).count()

    small, large = met(500), met(2000)
    assert small < 20 * 500 and large < 4.2 * small


def test_passport_labels_beside_values(spark):
    rows = [(1, 0, "Surname", 0.9, 10, 10, 80, 22), (1, 1, "ROSTOVA", 0.8, 100, 11, 180, 23), (1, 2, "Passport No", 0.7, 10, 60, 90, 72), (1, 3, "P01234567", 0.6, 12, 80, 90, 92), (1, 4, "P99999999", 0.5, 12, 4000, 90, 4012)]
    found = {r.field: r.value for r in regions.spatial_fields(spark.createDataFrame(rows, COLUMNS), extraction.PASSPORT_BESIDE).collect()}
    assert "P01234567" in found.values() and "P99999999" not in found.values()
