"""Corpus pipeline over ``documents``: five stages, each written and read again as the next one's input.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``documents``:

1. quality: documents that the Bradley-Terry ranking rejects go;
2. near_duplicates: of each SimHash component the document with the smallest id stays;
3. substrings: words in windows of 35 that occur elsewhere too are removed from the texts;
4. mixture: documents are taken by weighted fair queueing over sources, some up to three times;
5. tokens: byte-level BPE, per document of the mix its id, tokens and the digests of ids and decoded text.

No SQL: stages 1, 2 and 3 rest on a fitted model, iterated components and kept texts; the tests hold
them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from idlattice.llm.bpe import bpe_stage
from idlattice.llm.common import drop_table, materialize, read
from idlattice.llm.mixing import mix_stage
from idlattice.llm.quality_model import quality_stage
from idlattice.llm.simhash import simhash_stage
from idlattice.llm.substrings import substring_stage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", simhash_stage),
    ("substrings", substring_stage),
    ("mixture", mix_stage),
    ("tokens", bpe_stage),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return docs
