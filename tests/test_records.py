"""Vectors of identity records with their known results."""

import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from idlattice.functions import compare, fields
from idlattice.functions.countries import CODES, corrections
from idlattice.functions.mrz_digits import WEIGHTS, is_valid_digit
from idlattice.functions.mrz_lines import clean_name, normalize_line
from idlattice.functions.mrz_parse import parse
from idlattice.operators import candidates, evaluation, faces, regions, screening, tamper

L1, L2 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def zone(spark, kind, *lines, **options):
    names = [f"l{k}" for k in range(len(lines))]
    return rows(parse(spark.createDataFrame([lines], ", ".join(f"{n} string" for n in names)), kind, names, **options))[0]["mrz"]


def test_check_digits(spark):
    cases = [("L898902C3", "6", True), ("740812", "2", True), ("120415", "9", True), ("L898902C3", "5", False), ("740812", "7", False), ("12345", "", False), ("12345", None, False), ("12345", "X", False), ("<<<<<<<<<", "<", True)]
    df = spark.createDataFrame(cases, "v string, d string, ok boolean")
    assert all(r.got == r.ok for r in df.select("ok", is_valid_digit(F.col("v"), F.col("d")).alias("got")).collect())


@settings(max_examples=200, deadline=None)
@given(st.text("0123456789", min_size=6, max_size=6), st.integers(0, 5), st.integers(1, 9))
def test_one_changed_digit_changes_the_check_digit(value, at, by):
    total = lambda v: sum(int(c) * WEIGHTS[i % 3] for i, c in enumerate(v)) % 10
    other = value[:at] + str((int(value[at]) + by) % 10) + value[at + 1 :]
    assert total(value) != total(other)


def test_td3(spark):
    z = zone(spark, "TD3", L1, L2)
    assert (z["surname"], z["given_names"], z["document_number"], z["nationality"], z["date_of_birth"], z["sex"], z["date_of_expiry"]) == ("ERIKSSON", "ANNA MARIA", "L898902C3", "UTO", "740812", "F", "120415")
    assert z["overall_valid"] and z["corrections"] == []
    assert not zone(spark, "TD3", L1[:19], L2)["valid_format"]
    bad = zone(spark, "TD3", L1, L2.replace("C36UTO", "C39UTO"))
    assert not bad["number_ok"] and not bad["overall_valid"]


def test_td3_corrections(spark):
    z = zone(spark, "TD3", L1, L2.replace("7408122F", "74O8122F"))
    assert z["overall_valid"] and [(c["position"], c["from_char"], c["to_char"]) for c in z["corrections"]] == [(15, "O", "0")]
    assert zone(spark, "TD3", L1, L2.replace("F1204159", "FI204I59"))["date_of_expiry"] == "120415"
    z = zone(spark, "TD3", L1, L2[:-1] + "O")
    assert z["line2"].endswith("10") and z["corrections"][-1]["field"] == "composite_check_digit"
    z = zone(spark, "TD3", L1[:-5] + "KK<EE", L2)
    assert (z["surname"], z["given_names"]) == ("ERIKSSON", "ANNA MARIA") and sum(c["field"] == "filler" for c in z["corrections"]) >= 2
    z = zone(spark, "TD3", L1, L2.replace("UTO", "1ND"))
    assert z["nationality"] == "IND" and [(c["from_char"], c["to_char"]) for c in z["corrections"]] == [("1", "I")]
    assert zone(spark, "TD3", L1, L2.replace("UTO", "100"))["nationality"] == "100"
    assert zone(spark, "TD3", L1, L2.replace("UTO", "1QQ"))["nationality"] == "1QQ"
    z = zone(spark, "TD3", L1, L2.replace("7408122", "8888888"))
    assert z["date_of_birth"] == "888888" and not z["overall_valid"]


def test_visas_and_cards(spark):
    a = zone(spark, "MRVA", "V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159<<<<<<<<<<<<<<<<")
    assert a["overall_valid"] and a["composite_ok"] is None
    assert not zone(spark, "MRVA", "V<UTOERIKSSON<<ANNA", "L898902C36UTO7408122F1204159<<<<<<<<<<<<<<<<")["valid_format"]
    assert zone(spark, "MRVB", "V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<", "L898902C36UTO7408122F1204159<<<<<<<<")["overall_valid"]
    card = ("I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<")
    assert zone(spark, "TD1", *card)["overall_valid"]
    assert not zone(spark, "TD1", card[0], card[1][:-1] + "1", card[2])["composite_ok"]
    two = zone(spark, "TD2", "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<", "D231458907UTO7408122F1204159<<<<<<<6")
    assert two["overall_valid"] and two["document_code"] == "P"
    assert zone(spark, "TD2", "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<", "D231458907UTO7408122F1204159<<<<<<<6", td2_keep_doc_code=True)["document_code"] == "I"


def test_lines_and_names(spark):
    got = spark.createDataFrame([(" p<uto anna«‹ ", "ANNA<MARIA<SRSSSESSESSSS"), ("L8 98|x-", "JACKSON"), (None, None)], "l string, n string").select(normalize_line(F.col("l")).alias("l"), clean_name(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("P<UTO<ANNA<<", "ANNA MARIA"), ("L898<X", "JACKSON"), (None, "")]
    assert len(set(CODES)) == 263 and corrections()["1ND"] == "IND" and "100" not in corrections()


def test_best_candidate(spark):
    short = f"{L1[:30]}\n{L2}"
    df = spark.createDataFrame([("a", 0, "otsu", f"{L1}\n{L2.replace('L8989', 'L8X89')}"), ("a", 1, "adaptive", short), ("a", 2, "clahe", f"PASSPORT\n{L1}\n{L2}"), ("b", 0, "noise", "some words that are long enough\nand another line of words")], "doc_id string, source_ordinal int, source string, text string")
    best = rows(candidates.best_candidates(candidates.scored_candidates(df)))
    assert [(r["doc_id"], r["source"]) for r in best] == [("a", "clahe")] and best[0]["mrz"]["overall_valid"]


def test_regions(spark):
    cols = "doc_id int, ordinal int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"
    df = spark.createDataFrame([(1, 1, "A", 0.5, 0, 0, 9, 9), (1, 2, "LONGTEXTHERE", 1.0, 0, 0, 9, 9), (2, 1, " ", 0.9, 0, 0, 9, 9)], cols)
    assert {r["doc_id"]: r["average_confidence"] for r in rows(regions.average_confidence(df))} == {1: 0.9615, 2: 0.0}
    df = spark.createDataFrame([(1, 1, "Name", 0.9, 10, 10, 60, 30), (1, 2, "Elena Rostova", 0.8, 90, 12, 200, 30), (1, 3, "Other Person", 0.7, 10, 40, 90, 60)], cols)
    assert [(r["value"], r["confidence"]) for r in rows(regions.spatial_values(df, r"\bName\b", "([A-Z][a-z]+ [A-Z][a-z]+)"))] == [("Elena Rostova", 0.8)]
    lines = rows(regions.grouped_lines(df))
    assert [r["text"] for r in lines] == ["Name Elena Rostova", "Other Person"]
    scores = [((95.0), 0.95), (150.0, 1.0), (-5.0, 0.0), (None, 0.0)]
    got = spark.createDataFrame(scores, "s double, e double").select("e", regions.unit_confidence(F.col("s")).alias("g")).collect()
    assert all(r.e == r.g for r in got)


def test_fields(spark):
    df = spark.createDataFrame([("MULT",), ("M",), ("SINGLE",), ("S",), ("DOUBLE",), ("1",), ("",)], "e string")
    assert [r[0] for r in df.select(fields.entries(F.col("e"))).collect()] == ["MULTIPLE", "MULTIPLE", "SINGLE", "SINGLE", "DOUBLE", "SINGLE", None]
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t"))).first()[0]
    assert [one(fields.is_visa_date, v) for v in ("15/01/2023", "12/15/2021", "35/05/2031")] == [True, False, False]
    assert one(fields.id_number, "GOVERNMENT OF INDIA\n8416 1590 3267") == "8416 1590 3267"
    assert one(lambda t: fields.name_score(t, F.lit(0.9)), "Sriram Mamundi") > 0 > one(lambda t: fields.name_score(t, F.lit(0.9)), "GOVERNMENT OF INDIA")
    assert [one(compare.comparable_date, v) for v in ("15/08/1990", "1990-08-15", "15-AUG-1990", "740812", "31/02/1990", "nonsense")] == ["900815", "900815", "900815", "740812", "900231", None]
    assert one(fields.mask_personal_data, "id AB12345678 on 740812") == "id ***ID*** on ***DOB***"


def test_cross_zone_and_fusion(spark):
    m = "map<string,string>"
    base = {"document_number": "L898902C3", "date_of_birth": "740812"}
    df = spark.createDataFrame([(1, {"passport_number": "L898902C3", "dob": "12/08/1974"}, base, {}), (2, {"passport_number": "L898902C3", "dob": "15/08/1995"}, base, {}), (3, {"dob": ""}, base, {})], f"doc_id int, visual {m}, mrz {m}, confidences map<string,double>")
    got = {r["doc_id"]: r for r in rows(tamper.consistency_signal(tamper.cross_zone(df)))}
    assert got[1]["score"] == 0.0 and got[2]["score"] == 0.9 and got[2]["severity"] == "HIGH" and 3 not in got
    signals = spark.createDataFrame([(1, s, 0.9 if s == "document_consistency" else 0.0, w, s == "document_consistency") for s, w in tamper.WEIGHTS.items()], "doc_id int, signal string, score double, weight double, evaluated boolean")
    fused = rows(tamper.fuse(signals))[0]
    assert (fused["risk"], fused["risk_level"], fused["coverage"]) == (0.9, "HIGH", 0.2917)


def test_faces(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(faces.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    bands = [(0.80, "STRONG_MATCH"), (0.7999, "BORDERLINE_MATCH"), (0.75, "BORDERLINE_MATCH"), (0.7499, "MANUAL_REVIEW"), (0.60, "MANUAL_REVIEW"), (0.5999, "NO_MATCH"), (None, "NOT_EVALUATED")]
    got = spark.createDataFrame(bands, "s double, e string").select("e", faces.band(F.col("s")).alias("g")).collect()
    assert all(r.e == r.g for r in got)


def _screening(spark, **over):
    d = datetime.date
    base = dict(screening_id="s", created_at=datetime.datetime(2024, 1, 1), claimed_nationality="UTO", passport_number="L1", passport_name="JOHN SMITH", passport_dob=d(1980, 2, 29), passport_expiry=d(2030, 1, 1), passport_nationality="uto", mrz_ok=True, visa_number="V1", visa_type="TRANSIT", visa_until=d(2030, 1, 1), stay_days=5, nid_name="JOHN SMITH", nid_dob=d(1980, 2, 29), face_score=0.9, photo_score=0.1, metadata_anomaly=False, anomalies=[])
    schema = "screening_id string, created_at timestamp, claimed_nationality string, passport_number string, passport_name string, passport_dob date, passport_expiry date, passport_nationality string, mrz_ok boolean, visa_number string, visa_type string, visa_until date, stay_days int, nid_name string, nid_dob date, face_score double, photo_score double, metadata_anomaly boolean, anomalies array<string>"
    row = base | over
    return rows(screening.assess(screening.validate(spark.createDataFrame([tuple(row.values())], schema), "2024-06-01")))[0]


def test_screening(spark):
    assert (_screening(spark)["risk"], _screening(spark)["verdict"]) == (0, "ALLOW")
    stub = _screening(spark, passport_name=None, passport_dob=None, passport_expiry=None, passport_nationality=None, mrz_ok=False, visa_number=None, visa_type=None, visa_until=None, stay_days=None, nid_name=None, nid_dob=None, face_score=0.0, photo_score=0.0)
    assert (stub["risk"], stub["category"], stub["verdict"], stub["status"], len(stub["errors"])) == (65, "HIGH", "REJECT", "FLAGGED_FOR_ADMIN", 1)
    assert _screening(spark, metadata_anomaly=True)["risk"] == 15
    assert (_screening(spark, photo_score=0.51)["risk"], _screening(spark, photo_score=0.50)["risk"]) == (30, 0)
    assert (_screening(spark, face_score=0.75)["risk"], _screening(spark, face_score=0.7499)["risk"]) == (0, 40)
    assert _screening(spark, face_score=0.1, photo_score=0.9, mrz_ok=False, metadata_anomaly=True)["risk"] == 100
    assert "substitution" in _screening(spark, passport_name="J0HN SM1TH", nid_name="JOHN SMLTH")["errors"][0]
    assert "Stay duration (6 days)" in _screening(spark, stay_days=6)["errors"][0]
    assert _screening(spark, passport_expiry=datetime.date(2024, 6, 1))["is_valid"]
    assert _screening(spark, passport_dob=datetime.date(2024, 9, 1), nid_dob=None)["is_valid"]
    ages = spark.sql("select date '2000-02-29' as b, date '2023-02-28' as t").select(screening.whole_years(F.col("b"), F.col("t"))).first()[0]
    assert ages == 22
    kinds = spark.createDataFrame([("tourist",), ("work permit",), ("WORKPERMIT",), ("Tourist Visa",)], "t string").select(screening.visa_type(F.col("t"))).collect()
    assert [r[0] for r in kinds] == ["TOURIST", "WORK_PERMIT", "WORK_PERMIT", None]


def test_boxes_blocks_and_calibration(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 32, 32), (1, 2, 40, 0, 72, 32), (1, 3, 500, 500, 532, 532)], "doc_id int, ordinal int, x1 int, y1 int, x2 int, y2 int")
    assert [(r["x1"], r["x2"]) for r in rows(tamper.merged_boxes(boxes))] == [(0, 72), (500, 532)]
    blocks = spark.createDataFrame([(1, k, 50.0 if k == 0 else 10.0) for k in range(20)], "doc_id int, block int, value double")
    assert rows(tamper.ela_signal(blocks))[0]["outliers"] == 1
    samples = spark.createDataFrame([(True, 0.9), (True, 0.2), (False, 0.1), (False, 0.35)], "positive boolean, score double")
    got = rows(evaluation.calibration(samples))[0]
    assert (got["tp"], got["fn"], got["tn"], got["fp"], got["recall"]) == (1, 1, 2, 0, 0.5)
    assert rows(evaluation.calibration(samples.limit(0)))[0]["f1"] == 0.0
