"""Document types that a caller adds: as rows of a table, or with an extractor of their own."""

import pytest
from pyspark.sql import functions as F

from idlattice.operators import document_types, extraction

RULES = [
    ("driving_licence", document_types.MARKER, 1, None, r"(?i)\bdriving licen[cs]e\b", None, None),
    ("driving_licence", "licence_number", 1, r"(?:Licence|License) No", r"([A-Z]{2}[0-9 ]{6,12})", r"[A-Z]{2}[0-9]{6,10}", "upper"),
    ("driving_licence", "licence_number", 2, r"DL", r"([A-Z]{2}[0-9]{6,10})", None, "upper"),
    ("driving_licence", "name", 1, "Holder", r"([A-Za-z' -]{2,40})", None, "title"),
    ("driving_licence", "valid_until", 1, "Valid until", r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})", None, None),
    ("residence_permit", "permit_number", 1, None, r"\b(R[0-9]{8})\b", None, None),
    ("broken", "x", 1, None, None, None, None),
]
TEXTS = [
    (1, "DRIVING LICENCE\nLicence No: ab123456\nHolder: anna o'neil\nValid until 01.02.2030", None),
    (2, "DRIVING LICENCE\nLicence No: zz12 34 56\nDL xy7654321\nHolder: -", None),
    (3, "PASSPORT\nPassport No: P1234567\nSurname: ROSS", None),
    (4, "Permit R12345678", "residence_permit"),
    (5, None, "driving_licence"),
    (6, "driving licence of a passport holder", "passport"),
]


@pytest.fixture(scope="module")
def inputs(spark):
    documents = spark.createDataFrame(TEXTS, "doc_id long, text string, requested string")
    regions = spark.createDataFrame([(1, 0, "Licence No: AB123456", 0.7, 0, 0, 10, 10)], "doc_id long, ordinal int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    zones = spark.createDataFrame([(4, True, "TD1", "I", {"document_number": "D1", "permit_number": "Z9", "sex": ""})], "doc_id long, detected boolean, format string, document_code string, fields map<string,string>")
    return documents, regions, zones


def test_types_as_rows(spark, inputs):
    rules = spark.createDataFrame(RULES, document_types.SCHEMA)
    types, fused, printed = extraction.extract(*inputs, rules=rules)
    assert {r.doc_id: r.document_type for r in types.collect()} == {1: "driving_licence", 2: "driving_licence", 3: "passport", 4: "residence_permit", 5: "driving_licence", 6: "passport"}
    found = {(r.doc_id, r.field): (r.value, r.confidence, r.source) for r in fused.collect()}
    mine = {k: v for k, v in found.items() if k[0] in (1, 2, 4, 5)}
    assert mine == {
        (1, "licence_number"): ("AB123456", 0.7, "visual_ocr"), (1, "name"): ("Anna O'neil", 0.85, "visual_ocr"), (1, "valid_until"): ("01.02.2030", 0.85, "visual_ocr"),
        (2, "licence_number"): ("XY7654321", 0.85, "visual_ocr"), (2, "name"): ("-", 0.85, "visual_ocr"),
        (4, "document_number"): ("D1", 0.98, "mrz"), (4, "permit_number"): ("Z9", 0.98, "mrz"),
    }
    plain = extraction.extract(*inputs)[1]
    assert {(r.doc_id, r.field, r.value) for r in plain.where("doc_id = 3").collect()} == {(3, k[1], v[0]) for k, v in found.items() if k[0] == 3} != set()
    assert {(r.doc_id, r.field) for r in printed.where("doc_id = 4").collect()} == {(4, "permit_number")}


def test_an_extractor_of_ones_own(inputs):
    def visual(types, regions):
        return types.select("doc_id", F.lit("length").alias("field"), F.length("text").cast("string").alias("value"), F.lit(1.0).alias("confidence"))

    own = extraction.Extractor(visual, lambda printed, zones: printed.withColumn("source", F.lit("own")))
    _, fused, _ = extraction.extract(*inputs, extractors={"residence_permit": own})
    assert [(r.field, r.value, r.source) for r in fused.where("doc_id = 4").collect()] == [("length", "16", "own")]


def test_no_rules(spark, inputs):
    types, fused, _ = extraction.extract(*inputs, rules=spark.createDataFrame([], document_types.SCHEMA))
    assert types.count() == len(TEXTS) and fused.count() == extraction.extract(*inputs)[1].count()


def test_only_wanted_types_are_read(spark):
    """Documents of other types are typed; their extractors don't run, nor those without documents."""
    documents = spark.createDataFrame([(1, "VISA\nVisa No: V1234567\n", None), (2, "PASSPORT\nSurname: ROSS\n", None)], "doc_id long, text string, requested string")
    regions = spark.createDataFrame([], "doc_id long, ordinal int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    zones = spark.createDataFrame([], "doc_id long, detected boolean, format string, document_code string, fields map<string,string>")

    def never(*_):
        raise AssertionError("not asked for")

    others = dict.fromkeys(("passport", "national_id"), extraction.Extractor(never, never))
    types, fused, _ = extraction.extract(documents, regions, zones, extractors=others, wanted=("visa",))
    assert sorted((r.doc_id, r.document_type) for r in types.collect()) == [(1, "visa"), (2, "passport")]
    assert {(r.doc_id, r.field, r.value) for r in fused.collect()} == {(1, "visa_number", "V1234567"), (1, "document_number", "V1234567")}
