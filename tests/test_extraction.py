"""Fields of whole documents, on small cards written out here."""

import pytest

from idlattice.operators import extraction, regions

REGIONS = "doc_id string, ordinal int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"
ZONES = "doc_id string, detected boolean, format string, document_code string, fields map<string,string>"

#: card -> (lines as (text, confidence, x1, y1, x2, y2), text where it isn't the lines joined, expected fields)
CARDS = {
    "unlabelled": ([("GOVERNMENT OF INDIA", 0.98, 50, 20, 450, 50), ("UNIQUE IDENTIFICATION AUTHORITY OF INDIA", 0.96, 50, 55, 480, 80), ("Sriram Mamundi", 0.94, 50, 100, 280, 130), ("DOB: 15/08/1990", 0.95, 50, 140, 250, 165), ("Male", 0.97, 50, 175, 120, 200), ("8416 1590 3267", 0.99, 50, 220, 320, 255)], None,
                   {"name": ("Sriram Mamundi", 0.94), "date_of_birth": ("15/08/1990", 0.95), "gender": ("MALE", 0.97), "sex": ("M", 0.97), "id_number": ("8416 1590 3267", 0.99), "issuing_authority": ("Government of India", 0.90)}),
    "beside": ([("NATIONAL IDENTITY CARD", 0.95, 50, 10, 300, 35), ("Full Name:", 0.95, 50, 60, 150, 85), ("Elena Rostova", 0.92, 160, 60, 320, 85), ("DOB:", 0.95, 50, 95, 100, 120), ("24-11-1988", 0.93, 110, 95, 230, 120), ("Gender:", 0.95, 50, 130, 120, 155), ("Female", 0.96, 130, 130, 200, 155), ("Card No: ID-78901234", 0.94, 50, 170, 280, 195)], None,
               {"name": ("Elena Rostova", None), "date_of_birth": ("24-11-1988", None), "gender": ("FEMALE", None), "sex": ("F", None), "id_number": ("ID-78901234", 0.94)}),
    "split": ([("GOVERNMENT OF INDIA", 0.98, 50, 20, 450, 50), ("wher", 0.10, 20, 85, 60, 95), ("Sriram", 0.78, 50, 100, 150, 130), ("Mamundi", 0.92, 160, 100, 280, 130), ("8416 1590 3267", 0.99, 50, 220, 320, 255)], None, {"name": ("Sriram Mamundi", None), "id_number": ("8416 1590 3267", 0.99)}),
    "headings": ([("REPUBLIC OF INDIA", 0.99, 50, 10, 300, 35), ("VOTER IDENTITY CARD", 0.97, 50, 70, 350, 95), ("Card No: 12345678", 0.95, 50, 140, 250, 165)], None, {"name": None, "id_number": ("12345678", 0.95)}),
    "fragment": ([("DOB", 0.95, 50, 140, 90, 165), ("8416", 0.95, 100, 140, 150, 165), ("1590 3267", 0.99, 160, 140, 280, 165)], "DOB 8416 1590 3267", {"date_of_birth": None, "id_number": ("8416 1590 3267", None)}),
    "letters": ([("F", 0.70, 10, 10, 20, 20), ("Robert M Williams", 0.95, 50, 60, 250, 85), ("DOB: 12/04/1985", 0.96, 50, 95, 200, 120), ("ID: 98765432", 0.95, 50, 130, 180, 155)], None, {"gender": None, "sex": None, "name": ("Robert M Williams", 0.95), "date_of_birth": ("12/04/1985", 0.96)}),
    "below": ([("DOB", 0.9, 50, 100, 90, 120), ("01/02/1990", 0.8, 52, 140, 150, 160)], "x", {"date_of_birth": ("01/02/1990", 0.8)}),
    "text year": ([], "Year of Birth: 1990\nMale", {"date_of_birth": ("1990", 0.85), "gender": ("MALE", 0.85)}),
    "text bad": ([], "DOB: 35/10/1990\nFemale", {"date_of_birth": None, "sex": ("F", 0.85)}),
    "text lone": ([], "Card 12.04.1982 of 7\nSex: Transgender", {"date_of_birth": ("12.04.1982", 0.85), "gender": ("TRANSGENDER", 0.85), "sex": ("X", 0.85)}),
    "text name": ([], "GOVERNMENT CARD\nAnna Maria\nDOCUMENT NUMBER: 99887766", {"name": ("Anna Maria", 0.75), "id_number": ("99887766", 0.85)}),
    "nothing": ([], None, {"name": None, "id_number": None}),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, "\n".join(line[0] for line in lines) if text is None and lines else text, None) for k, (lines, text, _) in CARDS.items()], "doc_id string, text string, requested string")
    near = spark.createDataFrame([(k, i, *line) for k, (lines, _, _) in CARDS.items() for i, line in enumerate(lines)], REGIONS)
    rows = extraction.national_id_visual(docs, near).collect()
    assert len({(r.doc_id, r.field) for r in rows}) == len(rows)
    return {(r.doc_id, r.field): (r.value, r.confidence) for r in rows}


@pytest.mark.parametrize("card", CARDS)
def test_national_ids(found, card):
    for field, want in CARDS[card][2].items():
        got = found.get((card, field))
        assert (got is None) == (want is None), (field, got)
        if want:
            assert got[0] == want[0] and (want[1] is None or abs(got[1] - want[1]) < 1e-9), (field, got)


def test_documents_of_all_types(spark):
    zone = {"surname": "ERIKSSON", "given_names": "ANNA MARIA", "document_number": "L898902C3", "nationality": "UTO", "date_of_birth": "740812", "sex": "F", "date_of_expiry": "120415", "issuing_state": "UTO"}
    docs = spark.createDataFrame([
        ("v1", "VISA TYPE: B1/B2\nENTRIES: MULTIPLE\nISSUE DATE: 12/04/2010\nISSUING POST: LONDON\nControl Number: X9999999\nName: Robert Williams", None),
        ("v2", "VISA\nDate d'expiration: 01/02/2030\nDate d' émission: 03-04-2020\nNombre d'entrées: MULT\nVisa No: AB1234567", "auto"),
        ("p1", "PASSPORT", None), ("p2", "PASSPORT.\nSurname: DOE\nGiven Names: JOHN\nSexe: HOMME", None), ("i1", "Visual text", None), ("n1", "AADHAAR", "National_ID"), ("o1", "", "other"),
    ], "doc_id string, text string, requested string")
    zones = spark.createDataFrame([("v1", True, "MRVA", "V", zone), ("p1", True, "TD3", "P", zone), ("i1", True, "TD1", "I", zone)], ZONES)
    near = spark.createDataFrame([("p2", 0, "Passport No", 0.9, 10, 10, 100, 30), ("p2", 1, "X1234567", 0.8, 120, 10, 200, 30), ("p2", 2, "Surname: DOE", 0.7, 10, 50, 100, 70), ("p2", 3, "JOHN", 0.6, 10, 80, 100, 99), ("v2", 0, "Class", 0.9, 10, 10, 60, 30), ("v2", 1, "C-7", 0.5, 10, 40, 60, 60)], REGIONS)
    types, fused, printed = extraction.extract(docs, near, zones)
    rows = {(r.doc_id, r.field): (r.value, r.source, r.confidence) for r in fused.collect()}
    assert {r.doc_id: r.document_type for r in types.collect()} == {"v1": "visa", "v2": "visa", "p1": "passport", "p2": "passport", "i1": "national_id", "n1": "national_id", "o1": "other"}
    assert rows["v1", "name"] == ("ERIKSSON ANNA MARIA", "mrz", 0.98) and rows["v1", "visa_number"][0] == "L898902C3" and rows["v1", "mrz_format"][0] == "MRVA"
    assert rows["v1", "visa_type"][:2] == ("B1/B2", "visual_ocr") and rows["v1", "issue_date"][0] == "12/04/2010" and rows["v1", "expiry_date"][:2] == ("120415", "mrz") and rows["v1", "issuing_authority"][0].startswith("LONDON")
    assert rows["v2", "expiry_date"][0] == "01/02/2030" and rows["v2", "issue_date"][0] == "03-04-2020" and rows["v2", "entries"][0] == "MULTIPLE" and rows["v2", "document_number"][0] == "AB1234567" and rows["v2", "visa_type"] == ("C-7", "visual_ocr", 0.5)
    assert rows["p1", "passport_number"] == ("L898902C3", "mrz", 0.98) and rows["p2", "passport_number"] == ("X1234567", "visual_ocr", 0.8)
    assert rows["p2", "sex"][0] == "M" and rows["i1", "name"][0] == "ERIKSSON ANNA MARIA" and rows["i1", "gender"][0] == "F" and ("i1", "visa_type") not in rows
    differing = extraction.discrepancies(printed, zones)
    assert {(r.doc_id, r.field) for r in differing.collect()} == {("v1", "document_number"), ("v1", "name")}
    view = {r.doc_id: r for r in extraction.document_view(types, fused, differing).collect()}
    assert len(view) == 7 and view["v1"].fields["entries"] == "MULTIPLE" and len(view["v1"].warnings) == 2 and view["n1"].warnings[0].startswith("MRZ not detected on this National ID") and view["p2"].warnings == ["No MRZ detected for passport; extracted fields rely on visual OCR text."] and view["p1"].warnings == []


def test_second_passes(spark):
    crops = spark.createDataFrame([
        ("a", 0, "date_of_birth", "DOB", 90, "below", 60, "8416", 0.9), ("a", 1, "date_of_birth", "DOB", 90, "right_var_1", 95, "15/08/1990", 0.7), ("a", 2, "date_of_birth", "DOB", 90, "below", 60, "16/08/1990", 0.8),
        ("a", 3, "gender", "Sex", 90, "below", 60, "x M", 0.99), ("a", 4, "gender", "Sex", 90, "below", 60, "female", 0.5), ("b", 0, "date_of_birth", "Year of Birth", 90, "below", 60, "1984", 0.5),
    ], "doc_id string, pass_no int, field string, label_text string, label_x2 int, crop string, crop_x1 int, text string, confidence double")
    scored = extraction.second_pass_scores(crops, spark.createDataFrame([("a", "8416 1590 3267")], "doc_id string, id_number string"))
    assert {(r.doc_id, r.value): round(r.score, 4) for r in scored.collect()} == {("a", "15/08/1990"): 2.345, ("a", "16/08/1990"): 2.2, ("a", "M"): 2.085, ("a", "FEMALE"): 1.75, ("b", "1984"): 1.55}
    assert {(r.doc_id, r.field): r.value for r in extraction.second_pass_best(scored).collect()} == {("a", "date_of_birth"): "15/08/1990", ("a", "gender"): "M", ("b", "date_of_birth"): "1984"}
    dates = spark.createDataFrame([("a", "issue_date", 1, "no 31/13/2020 but 01/02/2020", 0.5), ("a", "issue_date", 2, "03/02/2020", 0.9)], "doc_id string, field string, pass_no int, text string, confidence double")
    assert [tuple(r) for r in extraction.second_pass_dates(dates).collect()] == [("a", "issue_date", "01/02/2020", 0.5)]


def test_empty_inputs(spark):
    docs, near, zones = spark.createDataFrame([], "doc_id string, text string, requested string"), spark.createDataFrame([], REGIONS), spark.createDataFrame([], ZONES)
    types, fused, _ = extraction.extract(docs, near, zones)
    assert extraction.document_view(types, fused).count() == 0
    assert regions.spatial_values(near, "Name", "([a-z]+)").count() == 0


def test_texts_of_visas_are_read_once(spark, tmp_path):
    """Confidence, fallbacks and fusion don't search the texts again."""
    spark.createDataFrame([(1, "VISA\nVisa No: V1234567\nName: ANNA ROSS\n"), (2, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    regions = spark.createDataFrame([(1, 0, "V1234567", 0.7, 0, 0, 9, 9)], "doc_id long, ordinal int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    zones = spark.createDataFrame([(2, "MRVA", {"document_number": "X1", "date_of_expiry": "301231"})], "doc_id long, format string, fields map<string,string>")
    rows = extraction.visa_fused(extraction.visa_visual(texts, regions), zones)
    assert sorted((r.doc_id, r.field, r.value, r.confidence, r.source) for r in rows.collect()) == [
        (1, "document_number", "V1234567", 0.7, "visual_ocr"), (1, "name", "ANNA ROSS", 0.85, "visual_ocr"), (1, "visa_number", "V1234567", 0.7, "visual_ocr"),
        (2, "document_number", "X1", 0.98, "mrz"), (2, "expiry_date", "301231", 0.98, "mrz"), (2, "mrz_format", "MRVA", 0.98, "mrz"), (2, "visa_number", "X1", 0.98, "mrz"),
    ]
    assert rows._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
