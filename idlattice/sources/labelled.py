"""Labelled images as data sources of Spark's: folders named after their label, invented pages, invented pairs of faces.

    labelled.register(spark)
    spark.read.format("labelled_images").option("path", folder).option("labels", "clean,tampered").load().where("label = 'clean'")
    spark.read.format("seeded_pages").option("rows", 1000).option("seed", 7).load()
    spark.read.format("seeded_faces").option("rows", 1000).load()

A partition holds one slice of one label, so a filter on the label leaves out the others' partitions before any task
starts. Files are listed and read by the tasks, none by the driver; invented rows depend on seed and number alone. Rows
are the same at any number of ``slices``. For folders of many millions of files, which every slice lists anew,
``files.read_images`` is the better way.

Defined cases: a label without a folder and an empty folder give no rows; a file with a foreign extension, an empty and
an oversized one keep a row with ``error`` and no content; a filter on a label that isn't there gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.pixels import synthetic_page
from .files import EXTENSIONS, MOST_BYTES

_PAIR = re.compile(r"pair_(.+)_(doc|selfie)\.[^.]+$")


@dataclass
class Slice(InputPartition):
    label: str
    part: int
    parts: int


class LabelReader(DataSourceReader):
    """Slices of the labels that filters leave."""

    def __init__(self, options: dict[str, str], labels: tuple[str, ...]) -> None:
        self.options = options
        self.labels = labels
        self.parts = int(options.get("slices", 4))
        if self.parts < 1:
            raise ValueError("slices must be 1 or more")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and lists of labels are settled by leaving partitions out; all else stays with Spark."""
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == ("label",):
                self.labels = tuple(x for x in self.labels if x == one.value)
            elif isinstance(one, In) and one.attribute == ("label",):
                self.labels = tuple(x for x in self.labels if x in one.value)
            else:
                yield one

    def partitions(self) -> list[Slice]:
        return [Slice(label, k, self.parts) for label in self.labels for k in range(self.parts)]

    def read(self, partition: Slice | None) -> Iterator[tuple]:
        """Spark asks once, without a slice, where no label is left."""
        return iter(()) if partition is None else self.rows(partition)

    def rows(self, partition: Slice) -> Iterator[tuple]:
        raise NotImplementedError


class FolderReader(LabelReader):
    def rows(self, partition: Slice) -> Iterator[tuple]:
        root = self.options["path"].rstrip("/") + "/" + partition.label
        system, folder = fs.FileSystem.from_uri(root)
        most = int(self.options.get("most", MOST_BYTES))
        for found in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if not found.is_file or zlib.crc32(found.base_name.encode()) % partition.parts != partition.part:
                continue
            error = "unsupported extension" if found.extension.lower() not in EXTENSIONS else "empty file" if found.size == 0 else "file too large" if found.size > most else None
            content = None
            if error is None:
                with system.open_input_stream(found.path) as opened:
                    content = opened.read()
            pair, side = match.groups() if (match := _PAIR.match(found.base_name)) else (None, None)
            yield partition.label, pair, side, found.path, found.size, content, error


class PageReader(LabelReader):
    def rows(self, partition: Slice) -> Iterator[tuple]:
        height, width, seed = (int(self.options.get(name, default)) for name, default in (("height", 400), ("width", 600), ("seed", 7)))
        first = 2 * partition.part + (partition.label == "tampered")
        for k in range(first, int(self.options["rows"]), 2 * partition.parts):
            yield k, partition.label, height, width, 3, synthetic_page(seed, k, height, width).tobytes()


def synthetic_face(seed: int, person: int, shot: int, side: int = 160) -> np.ndarray:
    """A shot of an invented person, BGR: features are the person's own, grain and light the shot's."""
    own, taken = np.random.default_rng([seed, person]), np.random.default_rng([seed, person, shot])
    y, x = np.mgrid[:side, :side] / side - 0.5
    wide, tall, apart, level, mouth = own.uniform((0.24, 0.32, 0.08, -0.12, 0.05), (0.32, 0.42, 0.13, -0.04, 0.13))
    skin = own.uniform((95, 125, 165), (165, 195, 235))
    image = np.full((side, side, 3), 240.0)
    image[(x / wide) ** 2 + (y / tall) ** 2 <= 1] = skin
    for eye in (-apart, apart):
        image[(x - eye) ** 2 + (y - level) ** 2 <= 0.0009] = 35.0
    image[(np.abs(x) < 0.012) & (y > level) & (y < 0.1)] = skin * 0.6
    image[(np.abs(x) < mouth) & (np.abs(y - 0.2) < 0.015)] = (60, 50, 120)
    return np.clip(image * taken.uniform(0.92, 1.05) + taken.normal(0, 3.0, image.shape), 0, 255).astype(np.uint8)


class FaceReader(LabelReader):
    """Even pairs show one person twice, odd pairs two persons."""

    def rows(self, partition: Slice) -> Iterator[tuple]:
        side, seed = int(self.options.get("side", 160)), int(self.options.get("seed", 7))
        first = 2 * partition.part + (partition.label == "impostor")
        for k in range(first, int(self.options["rows"]), 2 * partition.parts):
            other = 2 * k + (partition.label == "impostor")
            yield k, partition.label, side, side, 3, synthetic_face(seed, 2 * k, 0, side).tobytes(), synthetic_face(seed, other, 1, side).tobytes()


class LabelledImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "labelled_images"

    def schema(self) -> str:
        return "label string, pair string, side string, path string, length long, content binary, error string"

    def reader(self, schema) -> FolderReader:
        named = self.options.get("labels", "clean,tampered").split(",")
        return FolderReader(dict(self.options), tuple(dict.fromkeys(x.strip() for x in named if x.strip())))


class SeededPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seeded_pages"

    def schema(self) -> str:
        return "id long, label string, height int, width int, channels int, data binary"

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options), ("clean", "tampered"))


class SeededFaces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seeded_faces"

    def schema(self) -> str:
        return "id long, label string, height int, width int, channels int, document binary, selfie binary"

    def reader(self, schema) -> FaceReader:
        return FaceReader(dict(self.options), ("genuine", "impostor"))


def register(spark: SparkSession) -> None:
    """Make the three formats known to the session and let it hand them its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LabelledImages, SeededPages, SeededFaces):
        spark.dataSource.register(source)
