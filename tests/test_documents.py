"""Zones, forensic analysis, face verification, submissions and streams on small tables written out here."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from idlattice.functions import legacy
from idlattice.operators import analysis, candidates, images, records, screening, verification
from idlattice.sources import tables
from idlattice.streaming import events

LINE1, LINE2 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
SOURCES = "doc_id long, source_ordinal int, source string, text string"


def test_a_batch_without_zones(spark):
    sources = spark.createDataFrame([(1, 0, "a", "nothing here that looks\nlike a zone at all, no"), (2, 0, "a", "")], SOURCES)
    scored = candidates.scored_candidates(sources)
    assert scored.count() == 0 and candidates.best_candidates(scored).count() == 0
    found = candidates.zones(sources.select("doc_id"), scored).collect()
    assert [(r.doc_id, r.detected, r.fields, r.candidate_count) for r in sorted(found)] == [(1, False, {}, 0), (2, False, {}, 0)]


def test_zone_of_several_sources(spark):
    documents = spark.createDataFrame([(1, "PASSPORT\n" + LINE1 + "\n" + LINE2), (2, " "), (3, "PASSPORT")], "doc_id long, text string")
    passes = spark.createDataFrame([(1, 0, "otsu_r20_psm6", LINE1[:38] + "\n" + LINE2), (1, 1, "clahe_r35_psm6", LINE1 + "\n" + LINE2), (2, 0, None, "  "), (3, 0, None, "x")], "doc_id long, pass_no int, source string, text string")
    lines = spark.createDataFrame([(1, 1, LINE2), (1, 0, LINE1)], "doc_id long, ordinal int, text string")
    sources = candidates.candidate_sources(documents, passes, lines)
    assert {(r.doc_id, r.source) for r in sources.collect()} == {(1, "otsu_r20_psm6"), (1, "clahe_r35_psm6"), (1, "general_ocr"), (1, "general_ocr_lines"), (3, "general_ocr"), (3, "mrz_pass_1")}
    scored = candidates.scored_candidates(sources)
    assert {r.source for r in candidates.best_candidates(scored).collect()} == {"clahe_r35_psm6"}
    found = {r.doc_id: r for r in candidates.zones(documents, scored).collect()}
    assert found[1].format == "TD3" and found[1].fields["surname"] == "ERIKSSON" and found[1].fields["personal_number"] == "ZE184226B" and found[1].overall_valid and not found[2].detected
    text = spark.createDataFrame([(1, 0, "x"), (1, 1, LINE1), (1, 2, LINE2.replace("0", "O")), (2, 0, "y")], "doc_id long, pos int, line string")
    assert [(r.doc_id, r.line2[:20]) for r in legacy.zone_of(text.where("doc_id = 9"), text).collect()] == [(1, "L8989O2C36UTO7408122")]


FACE = "doc_id long, ordinal int, w int, h int, confidence double, sharpness double, brightness double"


@pytest.mark.parametrize(("ok", "document", "selfies", "vectors", "status"), [
    (False, [(100, 0.9, 90.0)], [(100, 0.9, 90.0)], ([1.0, 0.0], [1.0, 0.0]), "PROCESSING_ERROR"), (True, [], [(100, 0.9, 90.0)], ([1.0, 0.0], [1.0, 0.0]), "NO_FACE"),
    (True, [(100, 0.9, 90.0)], [], ([1.0, 0.0], [1.0, 0.0]), "NO_FACE"), (True, [(100, 0.9, 90.0)], [(100, 0.9, 90.0), (90, 0.9, 90.0)], ([1.0, 0.0], [1.0, 0.0]), "MULTIPLE_FACES"),
    (True, [(100, 0.9, 90.0)], [(100, 0.9, 1.0)], ([1.0, 0.0], [1.0, 0.0]), "INSUFFICIENT_QUALITY"), (True, [(30, 0.9, 90.0)], [(100, 0.9, 90.0)], ([1.0, 0.0], [1.0, 0.0]), "INSUFFICIENT_QUALITY"),
    (True, [(100, 0.9, 90.0)], [(100, 0.9, 90.0)], (None, [1.0, 0.0]), "PROCESSING_ERROR"), (True, [(100, 0.9, 90.0)], [(100, 0.9, 90.0), (20, 0.9, 90.0)], ([1.0, 0.0], [1.0, 0.1]), "MATCH"),
    (True, [(100, 0.9, 90.0)], [(100, 0.9, 90.0)], ([1.0, 0.0], [0.0, 1.0]), "NO_MATCH"),
])
def test_verification(spark, ok, document, selfies, vectors, status):
    rows = lambda faces: spark.createDataFrame([(1, i, side, side, sure, sharp, 120.0) for i, (side, sure, sharp) in enumerate(faces)], FACE)
    pairs = spark.createDataFrame([(1, ok, True)], "doc_id long, document_ok boolean, selfie_ok boolean")
    out = verification.verify(pairs, rows(document), rows(selfies), spark.createDataFrame([(1, *vectors)], "doc_id long, document_vector array<double>, selfie_vector array<double>")).collect()
    assert len(out) == 1 and out[0].status == status and out[0].success == (status != "PROCESSING_ERROR")
    scored = status in ("MATCH", "NO_MATCH")
    assert (out[0].similarity_score is not None) == scored and (out[0].match_band != "NOT_EVALUATED") == scored and out[0].is_match == ({"MATCH": True, "NO_MATCH": False}.get(status))


def test_equal_portraits_are_chosen_alike(spark):
    """Two detections of one ordinal and size: the sharper one, whichever comes first."""
    faces = [(1, 1, 100, 100, 0.9, 5.0, 120.0), (1, 1, 100, 100, 0.9, 90.0, 120.0)]
    pairs = spark.createDataFrame([(1, True, True)], "doc_id long, document_ok boolean, selfie_ok boolean")
    vectors = spark.createDataFrame([(1, [1.0], [1.0])], "doc_id long, document_vector array<double>, selfie_vector array<double>")
    told = {verification.verify(pairs, spark.createDataFrame(rows, FACE).coalesce(1), spark.createDataFrame(faces[1:], FACE), vectors).first().status for rows in (faces, faces[::-1])}
    assert told == {"MATCH"}


def test_analysis(spark):
    pages = spark.createDataFrame([(1, 600, 400), (2, None, None), (3, 150, 400), (4, None, None)], "doc_id long, width int, height int")
    blocks = images.synthetic_blocks(spark, 4, 120).where("doc_id in (1, 3)").select("doc_id", "block", "ela", "noise", "sharpness")
    calm = images.synthetic_blocks(spark, 4, 120).where("doc_id = 2").select(F.lit(3).cast("long").alias("doc_id"), "block", "ela", "noise", "sharpness")
    tags = spark.createDataFrame([(1, ["GIMP 2.10"]), (3, ["Canon"])], "doc_id long, values array<string>")
    compared = spark.createDataFrame([(4, "sex", False, 0.65, True)], "doc_id long, field string, match boolean, weight double, counts boolean")
    clusters = spark.createDataFrame([], "doc_id long, matches long")
    out = {r.doc_id: r for r in analysis.analyze(pages, blocks.where("doc_id = 1").unionByName(calm), tags, compared, clusters).collect()}
    assert len(out) == 4 and [i.type for i in out[1].indicators][:2] == ["ela_local_inconsistency", "noise_inconsistency"] and out[1].risk > out[3].risk
    assert out[1].indicators[-1].type == "editing_software_metadata" and "gimp" in out[1].indicators[-1].explanation.lower()
    assert (out[2].risk, out[2].risk_level, out[2].coverage) == (0.0, "LOW", 0.0) and out[2].warnings[0].startswith("Document image data is empty")
    assert out[4].risk > 0 and [i.type for i in out[4].indicators] == ["document_consistency_mismatch"] and out[3].warnings == ["Low-resolution image (150x400 px); forensic signal reliability may be reduced."]
    assert {s.signal: s.evaluated for s in out[3].signals} == {"ela": True, "noise": True, "edge_texture": True, "copy_move": True, "metadata": True, "document_consistency": False}


def test_submissions(spark):
    claims = spark.createDataFrame([("a", "2024-01-01", "UTO"), ("b", "2024-01-02", "UTO")], "screening_id string, created_at string, claimed_nationality string")
    passports = spark.sql("select 'a' as screening_id, 'P1' as passport_number, 'ANNA' as full_name, date '1990-01-01' as date_of_birth, date '2030-01-01' as expiry_date, 'UTO' as nationality, true as mrz_ok")
    visas = spark.sql("select 'a' as screening_id, 'V1' as visa_number, 'work permit' as visa_text, date '2030-01-01' as valid_until, 10 as stay_days")
    ids = spark.sql("select 'a' as screening_id, 'N1' as id_number, 'Anna' as full_name, date '1990-01-01' as date_of_birth")
    joined = records.submissions(claims, passports, visas, ids.unionByName(ids), spark.sql("select 'a' as screening_id, 'x.png' as path"))
    rows = records.screening_rows(joined, records.stub_checks(claims)).withColumn("anomalies", F.array().cast("array<string>"))
    assessed = screening.assess(screening.validate(rows, "2024-06-01"))
    shown = records.projections(assessed).collect()
    assert len(shown) == 1 and shown[0].extracted.visa_type == "WORK_PERMIT" and shown[0].decision.verdict == "MANUAL_REVIEW_REQUIRED" and not shown[0].biometric.is_match
    assert {r.screening_id: r.missing for r in records.missing_documents(claims, passport=passports, visa=records.stub_extractions(spark, "visa")).collect()} == {"a": ["visa"], "b": ["passport", "visa"]}
    uploads = spark.createDataFrame([("image/PNG", 5), ("text/plain", 5), (None, 0), ("image/webp", 99_000_000)], "content_type string, length long")
    assert [r.status for r in images.checked_faces(uploads).collect()] == [None, 400, 400, 413]


def test_streams_are_drained_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in events.drain(stream, "append").collect()) == list(range(10))
    (tmp_path / "none").mkdir()
    assert events.drain(spark.readStream.schema("id long").parquet(f"{tmp_path}/none"), "append").count() == 0


def test_a_cluster_must_name_its_folder():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))

    assert tables.shared_folder(session("spark://host:7077", "hdfs:///x/")) == "hdfs:///x/idlattice" and tables.shared_folder(session("local[2]", None)).endswith("/idlattice")
    with pytest.raises(ValueError):
        tables.shared_folder(session("spark://host:7077", None))
