"""Labelled folders and invented images as data sources: rows at any number of slices, partitions that filters leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from idlattice.operators import pixels
from idlattice.sources import files, labelled


@pytest.fixture(autouse=True)
def known(spark):
    labelled.register(spark)


@pytest.fixture
def folder(tmp_path):
    for label, names in {"clean": ["pair_1_doc.jpg", "pair_1_selfie.PNG", "notes.txt", "none.png", *[f"p{k}.jpg" for k in range(20)]], "tampered": ["a.webp", "large.png"], "other": ["b.jpg"]}.items():
        (tmp_path / label).mkdir()
        for name in names:
            (tmp_path / label / name).write_bytes(b"" if name == "none.png" else b"x" * (200 if name == "large.png" else 5))
    (tmp_path / "clean" / "below").mkdir()
    return str(tmp_path)


def test_folders(spark, folder):
    def read(**options):
        return spark.read.format("labelled_images").options(path=folder, most=100, **options).load()

    rows = sorted((tuple(r) for r in read().select("label", "pair", "side", F.element_at(F.split("path", "/"), -1), "length", "content", "error").collect()), key=repr)
    assert len(rows) == 26 and rows.count(("clean", "1", "doc", "pair_1_doc.jpg", 5, bytearray(b"xxxxx"), None)) == 1
    assert {(r[3], r[6]) for r in rows if r[6]} == {("notes.txt", "unsupported extension"), ("none.png", "empty file"), ("large.png", "file too large")}
    assert all((r[5] is None) == (r[6] is not None) for r in rows)
    for slices in (1, 3, 16):
        assert sorted(map(repr, map(tuple, read(slices=slices).drop("path").collect()))) == sorted(repr((*r[:3], *r[4:])) for r in rows)
    assert read(slices=3).rdd.getNumPartitions() == 6 and read(slices=3).where("label = 'tampered'").rdd.getNumPartitions() == 3
    assert read().where("label in ('clean', 'x') and length > 4").count() == 23 and read().where("label = 'x'").count() == 0
    assert read(labels="other, gone").select("label").distinct().collect()[0][0] == "other" and read(labels="gone").count() == 0
    # the same files as Spark's own reader of files finds, which leaves out empty ones
    named = files.labelled_by_folder(files.read_images(spark, folder)).where("label != ''").select("label", F.element_at(F.split("path", "/"), -1).alias("name"))
    assert sorted(map(tuple, named.collect())) == sorted((r[0], r[3]) for r in rows if r[6] != "empty file")


@pytest.mark.parametrize(("source", "label"), [("seeded_pages", "tampered"), ("seeded_faces", "impostor")])
def test_invented_rows(spark, source, label):
    def read(rows, **options):
        return spark.read.format(source).options(rows=rows, **options).load()

    hashed = lambda df: sorted(map(tuple, df.select("id", "label", F.xxhash64(*df.columns[2:])).collect()))
    once = hashed(read(11, slices=1))
    assert [r[0] for r in once] == list(range(11)) and all((r[1] == label) == (r[0] % 2 == 1) for r in once) and len({r[2] for r in once}) == 11
    assert hashed(read(11, slices=4)) == hashed(read(11, slices=20)) == once and hashed(read(11, seed=8)) != once
    assert hashed(read(14))[:11] == once and read(0).count() == 0
    picked = read(11, slices=4).where(F.col("label") == label)
    assert hashed(picked) == [r for r in once if r[1] == label] and picked.rdd.getNumPartitions() == 4


def test_pages_are_those_of_the_generator(spark):
    old = {r.path: bytes(r.data) for r in pixels.synthetic_pages(spark, 4).collect()}
    assert {f"synthetic/{r.id}": bytes(r.data) for r in spark.read.format("seeded_pages").option("rows", 4).load().collect()} == old


def test_one_person_differs_less_than_two(spark):
    far = {"genuine": [], "impostor": []}
    for r in spark.read.format("seeded_faces").option("rows", 40).load().collect():
        a, b = (np.frombuffer(x, np.uint8).astype(float) for x in (r.document, r.selfie))
        far[r.label].append(np.abs(a - a.mean() - b + b.mean()).mean())
    assert np.mean(far["genuine"]) < 0.6 * np.mean(far["impostor"])
