"""Images written as plain bitmaps, and the earlier service's behaviour."""

import struct

import numpy as np
from pyspark.sql import functions as F

from idlattice.functions import legacy
from idlattice.operators import analysis, pixels, tamper
from idlattice.sources import files


def bitmap(path, grey):
    h, w = grey.shape
    rows = b"".join(np.repeat(r[:, None], 3, 1).astype(np.uint8).tobytes() + b"\0" * (-3 * w % 4) for r in grey[::-1])
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0)
    path.write_bytes(head + rows)


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "clean").mkdir()
    image = np.full((160, 192), 200.0)
    image[64:96, 64:96] = rng.integers(0, 255, (32, 32))
    bitmap(tmp_path / "clean" / "a.bmp", image)
    (tmp_path / "clean" / "b.txt").write_bytes(b"x")
    (tmp_path / "clean" / "c.png").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.error, r.label) for r in files.labelled_by_folder(files.read_images(spark, str(tmp_path))).collect()}
    assert got == {"a.bmp": (None, "clean"), "b.txt": ("unsupported extension", "clean")}  # the source itself leaves out empty files
    listed = spark.createDataFrame([("/x/c.png", 0), ("/x/d.png", 99_000_000), ("/x/e.PNG", 5)], "path string, length long")
    assert [r.error for r in files.checked(listed).orderBy("path").collect()] == ["empty file", "file too large", None]
    decoded = files.read_pixels(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in decoded.collect()}
    assert (rows["a.bmp"].height, rows["a.bmp"].width, rows["a.bmp"].channels, rows["a.bmp"].error) == (160, 192, 3, None)
    assert rows["b.txt"].error == "not an image" and rows["b.txt"].data is None  # what can't be decoded is not dropped
    decoded = decoded.where("error is null")
    blocks = pixels.with_blocks(decoded)
    assert blocks.count() == 30 and blocks.orderBy(F.desc("noise")).first().block == 14
    assert tamper.noise_signal(blocks.select(F.col("path").alias("doc_id"), "block", F.col("noise").alias("value"))).first().outliers == 1
    face = pixels.with_face_measures(decoded).first()
    assert len(face.embedding) == 128 and abs(sum(x * x for x in face.embedding) - 1) < 1e-9


def test_filters_of_a_flat_image():
    flat = np.full((16, 16), 100.0)
    assert pixels.recompression_error(flat).max() <= 1 and pixels.laplacian(flat).max() == 0 and pixels.gradient(flat).max() == 0


def test_earlier_service(spark):
    df = spark.createDataFrame([("p<uto anna", "VISA and PASSPORT", "FEMALE")], "l string, t string, s string")
    row = df.select(legacy.normalize_line(F.col("l")), legacy.classify(F.col("t")), legacy.sex_of(F.col("s"))).first()
    assert tuple(row) == ("P<UTO<ANNA", "passport", "M")
    line = spark.createDataFrame([("L898902C36UT074O8122F12O4159ZE184226B<<<<<1O",)], "l string").select(legacy.substituted_second_line(F.col("l"))).first()[0]
    assert line == "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    lines = spark.createDataFrame([(1, 0, "x"), (1, 1, "P" * 44), (1, 2, "Q" * 41), (1, 3, "R" * 44)], "doc_id int, pos int, line string")
    assert [r.line2[0] for r in legacy.first_pair(lines).collect()] == ["Q"]


def test_tags_of_files(spark):
    entry = lambda tag, text, at: struct.pack("<HHII", tag, 2, len(text) + 1, at)
    software, taken = b"GIMP 2.10", b"2020:01:01 00:00:00"
    more = 8 + 2 + 2 * 12 + 4
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + entry(0x0131, software, 200) + struct.pack("<HHII", 0x8769, 4, 1, more) + struct.pack("<I", 0) + struct.pack("<H", 1) + entry(0x9003, taken, 220) + struct.pack("<I", 0)
    tiff = tiff.ljust(200, b"\0") + software.ljust(20, b"\0") + taken + b"\0"
    part = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(part) + 2) + part + b"\xff\xd9"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 13, b"tEXt") + b"Software\0Mypx" + b"crc!"
    found = {r.path: r.tags for r in files.with_tags(spark.createDataFrame([("a", jpeg), ("b", png), ("c", None), ("d", jpeg[:40]), ("e", b"text")], "path string, content binary")).collect()}
    assert found == {"a": {"Software": "GIMP 2.10", "DateTimeOriginal": "2020:01:01 00:00:00"}, "b": {"Software": "Mypx"}, "c": {}, "d": {}, "e": {}}
    pairs = spark.createDataFrame([("x/pair_1_doc.jpg",), ("x/pair_1_selfie.png",), ("x/pair_2_doc.jpg",)], "path string")
    assert [tuple(r) for r in files.paired_by_name(pairs).collect()] == [("1", "x/pair_1_doc.jpg", "x/pair_1_selfie.png")]


def test_synthetic_pages_are_told_apart(spark):
    pages = pixels.synthetic_pages(spark, 8).cache()
    blocks = pixels.with_blocks(pages).withColumnRenamed("path", "doc_id")
    none = lambda schema: spark.createDataFrame([], schema)
    out = analysis.analyze(pages.select(F.col("path").alias("doc_id"), "width", "height"), blocks, none("doc_id string, values array<string>"), none("doc_id string, field string, match boolean, weight double, counts boolean"), none("doc_id string, matches long"))
    risk = {r.doc_id: r.risk for r in out.collect()}
    clean = [risk[f"synthetic/{k}"] for k in (0, 2, 4, 6)]
    spliced = [risk[f"synthetic/{k}"] for k in (3, 7)]
    assert max(clean) < 0.35 and min(spliced) - max(clean) >= 0.10
    bands = pixels.with_zone_variants(pages.limit(1)).collect()
    assert len(bands) == 15 and {r.filter for r in bands} == {"otsu", "adaptive", "blackhat"} and all(len(r.data) == r.height * r.width for r in bands)


def test_evaluation_job(spark, tmp_path):
    from idlattice import evaluate

    report = evaluate.main(["--synthetic", "8", "--threshold", "0.05"], spark)
    assert (report["n_clean"], report["n_tampered"], report["fp"]) == (4, 4, 0) and report["tp"] >= 2
    for label, grey in (("clean", np.full((96, 96), 200.0)), ("tampered", np.full((96, 96), 200.0))):
        (tmp_path / label).mkdir()
        bitmap(tmp_path / label / "a.bmp", grey)
    assert evaluate.main(["--dataset", str(tmp_path)], spark)["n_clean"] == 1


def test_pixel_helpers():
    image = np.full((60, 80), 200.0)
    image[20:40, 30:50] = 10.0
    assert 10 <= pixels.otsu(image) < 200
    assert (pixels.flattened(image, np.array([[30, 20], [49, 20], [49, 39], [30, 39]]), 20, 20) == 10).all()
    photo = np.zeros((200, 200, 3), np.uint8)
    photo[40:140, 60:130] = (120, 150, 210)  # skin, blue first
    photo[150:155, 10:190] = (120, 150, 210)  # too flat
    assert pixels.skin_boxes(photo) == [(60, 40, 70, 100)] and pixels.skin_boxes(photo[:10]) == []
    error, spread, rest = pixels.residuals(image)
    assert error >= 0 and spread >= 0 and rest > 0
    ramp = np.add.outer(np.arange(300.0), 2 * np.arange(300.0))
    moved = np.array(pixels.ALIGNED) * 1.5 + [40, 30]  # half as large again, shifted
    face = pixels.aligned_face(ramp, moved)
    assert face.shape == (112, 112) and abs(face[10, 20] - ((10 * 1.5 + 30) + 2 * (20 * 1.5 + 40))) < 1e-6
    assert pixels.aligned_face(ramp, None, (50, 60, 100, 100)).shape == (112, 112) and pixels.aligned_face(ramp, None) is None and pixels.aligned_face(ramp, None, (400, 400, 10, 10)) is None
