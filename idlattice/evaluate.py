"""Job entry: measure the forensic analysis on labelled images, or on invented pages.

    spark-submit idlattice/evaluate.py --dataset DIR [--threshold 0.35]
    spark-submit idlattice/evaluate.py --synthetic 40

DIR has the folders ``clean`` and ``tampered``. Prints one JSON line of counts, means and rates.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlattice.operators import analysis, evaluation, pixels
from idlattice.sources import files


def labelled_risks(images: DataFrame) -> DataFrame:
    """images (path, height, width, channels, data, positive) -> positive, score: risk by the image signals alone."""
    spark = images.sparkSession
    pages = images.select(F.col("path").alias("doc_id"), "width", "height")
    blocks = pixels.with_blocks(images.where("data is not null")).withColumnRenamed("path", "doc_id")
    none = [spark.createDataFrame([], schema) for schema in ("doc_id string, values array<string>", "doc_id string, field string, match boolean, weight double, counts boolean", "doc_id string, matches long")]
    found = analysis.analyze(pages, blocks, *none)
    return images.select(F.col("path").alias("doc_id"), "positive").join(found, "doc_id").select("positive", F.col("risk").alias("score"), F.col("risk_level").alias("level"))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--dataset")
    parser.add_argument("--synthetic", type=int, default=0)
    parser.add_argument("--threshold", type=float, default=0.35)
    args = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.dataset:
        decoded = files.labelled_by_folder(files.read_pixels(spark, args.dataset)).where("label != ''")
        images = decoded.withColumn("positive", F.col("label") == "tampered")
    else:
        images = pixels.synthetic_pages(spark, args.synthetic or 20).withColumnRenamed("tampered", "positive")
    report = evaluation.calibration(labelled_risks(images), args.threshold).first().asDict()
    print(json.dumps(report))
    return report


if __name__ == "__main__":
    main()
