"""Ranked lexical search: term-bucketed postings, joined with the items' terms, summed by item and document.

One pass over the texts counts terms; of its postings those stay whose term some item holds, and a row
without a term for every document, from which the collection's size and length come. The postings are a
table in folders by term bucket, of which a search reads those that its items' terms fall in, and within
each folder in files by document. So a word that stands in most documents is spread over all tasks, items meet
postings by term, and the matches of a document, wherever their terms lie, are summed in the task that
reads it: what is shuffled is each task's best k of an item, never the matches.

The items' terms are broadcast in groups of at most ``ITEM_TERMS`` rows on average; a group that exceeds twice that
(one endless item) is joined by a shuffle instead.

Defined cases: a null or empty text has no term; every row is a document and every item row an item, whatever
ids repeat; null document ids stand behind others of the same score; an item without a known term has no row;
empty tables give none. Other columns are never looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_path, read, slices

K = 20
#: Folders of postings.
TERM_BUCKETS = 16
#: Rows of items' terms that are broadcast at once.
ITEM_TERMS = 200_000
#: Terms: ASCII letters and digits and whatever is not ASCII; A-Z count as a-z, the rest parts terms.
_SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_SIGNS).split()


def term_counts(rows: DataFrame, text: str) -> DataFrame:
    """rows -> their other columns, n, term, tf: a row for each distinct term of a text, and one with the term null; n: its terms with repeats."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            sizes, lengths, found, counts = [], [], [], []
            for x in texts:
                counted = Counter(terms(x))
                sizes.append(len(counted) + 1)
                lengths.append(counted.total())
                found += (None, *counted)
                counts += (0, *counted.values())
            at = np.repeat(np.arange(len(texts)), sizes)
            yield pa.RecordBatch.from_arrays([*[x.take(pa.array(at)) for x in batch.select(kept).columns], pa.array(np.array(lengths, np.int64)[at]), pa.array(found, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=[*kept, "n", "term", "tf"])

    schema = T.StructType([*rows.select(*kept).schema.fields, *T.StructType.fromDDL("n long, term string, tf long").fields])
    return rows.select(*kept, text).mapInArrow(run, schema)


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int").alias("bucket")


def _written(postings: DataFrame) -> DataFrame:
    """The postings as a table in the shared folder: folders by term bucket, files by document."""
    spark = postings.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"postings_{uuid.uuid4().hex}"
    placed = postings.repartition(count, "d").write.partitionBy("bucket").bucketBy(count, "d").sortBy("term")
    placed.option("path", new_path(spark, "postings")).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """The k documents of highest score above 0 for each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = materialize(items.select(F.monotonically_increasing_id().alias("q"), F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")), "items")
    wanted = materialize(term_counts(asked.select("q", "text"), "text").where("term is not null").select("q", "term", F.col("tf").alias("times")), "item_terms")

    numbered = docs.select(F.monotonically_increasing_id().alias("d"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = wanted.select("term").distinct().withColumn("known", F.lit(True))
    counted = term_counts(numbered, "text").join(known, "term", "left").where("known or term is null")
    postings = _written(counted.select("d", F.when(F.col("term").isNull(), F.col("doc_id")).alias("doc_id"), "n", "term", "tf", _bucket("term")))

    whole = postings.where("term is null").agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    if not whole["L"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    held = postings.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * whole["N"] + 2) / (2 * F.col("df") + 1)))
    groups = max(1, -(-wanted.count() // item_terms))
    weighed = wanted.join(held, "term").select(F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("group"), "q", "term", _bucket("term"), (F.col("times") * weight).alias("weight"))
    weights = materialize(weighed.where("weight > 0"), "weights")

    size = f"(75 + (25 * n * {whole['N']}) div {whole['L']})"
    scored = postings.where("term is not null").select("bucket", "term", "d", F.expr(f"(1000000000 * tf) div (1000 * tf + 12 * {size})").alias("impact"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "d")
    names = postings.where("term is null").select("d", "doc_id").hint("shuffle_hash")
    found = None
    for group, rows in weights.groupBy("group").count().collect():
        own = weights.where(F.col("group") == group).drop("group").hint("broadcast" if rows <= 2 * item_terms else "merge")
        total = scored.join(own, ["bucket", "term"]).groupBy("q", "d").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
        top = total.where("score > 0").join(names, "d").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = top if found is None else found.unionByName(top)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS cn, sum(n)::BIGINT AS cl FROM sized),
posting AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sized) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), whole),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
total AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * cn) // cl))))::BIGINT AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term), whole GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM total WHERE score > 0)
WHERE rank <= 20"""
