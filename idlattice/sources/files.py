"""Image files and record tables.

Images are read as binary files; what an upload check would refuse becomes an error column, never a failed task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif")
MOST_BYTES = 15 * 1024 * 1024


def checked(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files (path, length) with ``error``: extension not allowed, empty, or too large; null where accepted."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("error", F.when(~extension.isin(*EXTENSIONS), "unsupported extension").when(F.col("length") == 0, "empty file").when(F.col("length") > most, "file too large"))


def read_images(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, length, content, error of every file below ``path``; contents over the limit are not carried. Spark leaves out empty files."""
    files = checked(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most)
    return files.select("path", "length", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")


def labelled_by_folder(files: DataFrame) -> DataFrame:
    """files with ``label``: the name of the folder, clean or tampered, and ``pair`` of pair_*_doc / pair_*_selfie names."""
    return files.withColumn("label", F.regexp_extract("path", r"/(clean|tampered)/[^/]+$", 1)).withColumn("pair", F.regexp_extract("path", r"/pair_([^/]+)_(?:doc|selfie)\.[^./]+$", 1))


def write_screenings(screenings: DataFrame, path: str, mode: str = "append") -> None:
    """Screenings as Parquet, partitioned by status, so that the review queue reads its partition only."""
    screenings.write.mode(mode).partitionBy("status").parquet(path)


def write_json(records: DataFrame, path: str, mode: str = "append") -> None:
    records.write.mode(mode).json(path)


def write_jdbc(screenings: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "append") -> None:
    """Screenings to a database; array columns become JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in screenings.dtypes]
    screenings.select(*flat).write.jdbc(url, table, mode, properties)


def read_pixels(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """path, height, width, channels, data (BGR bytes) and error of every image below ``path``; what can't be decoded or is tiny has an error and no data."""
    image = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)
    error = F.when(F.col("image.height").isNull() | (F.col("image.height") < 1), "not an image").when((F.col("image.height") < least) | (F.col("image.width") < least), "too small")
    sized = image.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), error.alias("error"))
    return sized.withColumn("data", F.when(F.col("error").isNull(), F.col("data")))


#: Tags of image files that are read, by number.
TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x000B: "ProcessingSoftware", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized"}
_MORE_TAGS = 0x8769


def _directory(data: bytes, order: str, at: int, found: dict[str, str], depth: int = 0) -> None:
    """Texts of the named tags of a TIFF directory, and of the one that it points to."""
    if depth > 1 or at + 2 > len(data):
        return
    for k in range(struct.unpack_from(f"{order}H", data, at)[0]):
        if at + 14 + 12 * k > len(data):
            return
        tag, kind, count, value = struct.unpack_from(f"{order}HHII", data, at + 2 + 12 * k)
        if tag == _MORE_TAGS:
            _directory(data, order, value, found, depth + 1)
        elif tag in TAGS and kind == 2:
            begin = value if count > 4 else at + 10 + 12 * k
            text = data[begin : begin + count].split(b"\0")[0].decode("latin-1").strip()
            if text:
                found[TAGS[tag]] = text


def image_tags(content: bytes) -> dict[str, str]:
    """Text tags of a JPEG's EXIF part or of a PNG's text parts; none where there are none or the file is broken."""
    found: dict[str, str] = {}
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xDA, 0xD9):
            size = struct.unpack_from(">H", content, at + 2)[0]
            part = content[at + 4 : at + 2 + size]
            if content[at + 1] == 0xE1 and part[:6] == b"Exif\0\0" and len(part) >= 14:
                order = "<" if part[6:8] == b"II" else ">"
                _directory(part[6:], order, struct.unpack_from(f"{order}I", part, 10)[0], found)
            at += 2 + max(2, size)
    elif content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(content):
            size, kind = struct.unpack_from(">I4s", content, at)
            if kind == b"tEXt":
                key, _, text = content[at + 8 : at + 8 + size].partition(b"\0")
                found[key.decode("latin-1")] = text.decode("latin-1").strip()
            at += 12 + size
    return found


def with_tags(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, tags (map); a file without content has an empty map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [list(image_tags(x or b"").items()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.map_(pa.string(), pa.string()))], names=["path", "tags"])

    return files.select("path", "content").mapInArrow(run, "path string, tags map<string,string>")


def paired_by_name(files: DataFrame) -> DataFrame:
    """pair, document and selfie path of pair_*_doc / pair_*_selfie files that both are there."""
    named = labelled_by_folder(files).where("pair != ''").withColumn("side", F.regexp_extract("path", r"_(doc|selfie)\.[^./]+$", 1))
    sides = [named.where(F.col("side") == side).groupBy("pair").agg(F.min("path").alias(name)) for side, name in (("doc", "document"), ("selfie", "selfie"))]
    return sides[0].join(sides[1], "pair")
