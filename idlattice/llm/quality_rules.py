"""Quality rules with compression bands.

A text's zstandard ratio (compressed bytes over bytes) tells repetition (low) from noise (high). It is
taken over the whole document and over fixed chunks, and held against limits by length, as short texts
compress less. The limits are learnt: ``learn_limits`` measures all texts labelled good outside the held-out
fold, whole and in all their chunks, draws the median ratio as a curve over length, and sets the highest ratio
at ``REACH`` times the distance of the good texts' last percent from it, the lowest at the share ``LOW`` of it.
One rule holds for every number of chunks: a document fails if more than one in ``SHARE`` lies outside. Counted rules (words,
symbols, repeated lines and windows) come with it.

Pieces are measured where their texts lie, joined to the labels as lengths and ratios, and counted by class of
length; medians and last percents are exact order statistics of all of them. Every document is judged.

Defined cases: null or empty text has no words, ratio null, fails the base rule and is not kept; without limits
(none given, or no good text labelled) the bands reject nothing; beyond the shortest and longest text measured the
limits at those ends hold; labels with a null id or mark are left out, of several marks of one id the mean counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, map_texts, materialize, order_statistics, read
from .quality_model import held_out, labelled

#: Bytes of a chunk. What is left behind the last whole chunk is one more, of TAIL bytes at least.
CHUNK = 4096
TAIL = 1024
#: A document fails if more than one chunk in SHARE lies outside the limits of its length.
SHARE = 4
#: The highest ratio lies REACH times as far above the median of good texts as their last percent does, the lowest at LOW times the median.
REACH = 3.0
LOW = 0.5
#: Pieces and span of length (as log2, in classes from 0) that a point of the curve is taken from, at least.
LEAST = 50
SPAN = 0.25
LEVEL = 3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def repeated_window_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window found twice or more in the list, its first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    ids = defaultdict(count().__next__)
    flat = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    keys = flat[: n - window + 1]
    for k in range(1, window):
        keys = keys * len(ids) + flat[k : n - window + 1 + k]
        if len(ids) ** 2 * (len(keys) + 1) > 1 << 62:  # rank the pairs before the next word joins them
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, bool)
    for k in range(window):
        twice[order[1:][same] + k] = True
        twice[order[:-1][same] + k] = True
    return int(twice.sum())


@dataclass(frozen=True)
class Limits:
    """Lowest and highest ratio at points of length (log2 of the bytes), straight lines between them."""

    at: np.ndarray
    lowest: np.ndarray
    highest: np.ndarray

    def of(self, size: int) -> tuple[float, float]:
        x = np.log2(size)
        return float(np.interp(x, self.at, self.lowest)), float(np.interp(x, self.at, self.highest))


def edges_of(classes: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """First classes of the groups: neighbouring classes together until they hold ``least`` pieces; the last takes what is left."""
    edges, held = [classes[0]], 0
    for k, n in zip(classes, counts, strict=True):
        if held >= least:
            edges.append(k)
            held = 0
        held += n
    return np.array(edges[:-1] if held < least and len(edges) > 1 else edges)


def fit_limits(sizes: np.ndarray, ratios: np.ndarray, reach: float = REACH, low: float = LOW, least: int = LEAST) -> Limits | None:
    """The limits that good pieces of these sizes and ratios set, held in memory; None without pieces."""
    if not len(sizes):
        return None
    x = np.log2(sizes)
    classes = np.floor(x / SPAN).astype(int)
    group = np.searchsorted(edges_of(*np.unique(classes, return_counts=True), least), classes, side="right")
    at, middle = (np.array([np.median(v[group == g]) for g in np.unique(group)]) for v in (x, ratios))
    above = ratios - np.interp(x, at, middle)
    spread = np.array([max(0.0, np.quantile(above[group == g], 0.99)) for g in np.unique(group)])
    return Limits(at, low * middle, middle + reach * spread)


def quantiles(rows: DataFrame, counts: list[int], share: float) -> np.ndarray:
    """As ``np.quantile``, of each key from 0; ``counts`` are the weights of the keys."""
    where = [share * (n - 1) for n in counts]
    ends = order_statistics(rows, {g: [int(h), min(int(h) + 1, n - 1)] for g, (h, n) in enumerate(zip(where, counts, strict=True))})
    return np.array([ends[g][0] + (ends[g][1] - ends[g][0]) * (h - int(h)) for g, h in enumerate(where)])


def fit_all(found: DataFrame, reach: float = REACH, low: float = LOW, least: int = LEAST) -> Limits | None:
    """``fit_limits`` of a table of any size: x (log2 of the size), ratio and the weight of equal pieces."""
    classes = found.groupBy(F.floor(F.col("x") / SPAN).cast("int").alias("class")).agg(F.sum("weight").alias("n")).orderBy("class").collect()
    if not classes:
        return None
    edges = edges_of(np.array([r["class"] for r in classes]), np.array([r.n for r in classes]), least)
    group = lambda x: np.searchsorted(edges, np.floor(x / SPAN), side="right") - 1
    counts = np.bincount([group(r["class"] * SPAN) for r in classes], [r.n for r in classes]).astype(int).tolist()

    def values(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ratio = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(group(x), pa.int32()), pa.array(of(x, ratio), pa.float64()), batch.column(2)], names=["key", "value", "weight"])

        return found.select("x", "ratio", "weight").mapInArrow(run, "key int, value double, weight long")

    at, middle = (quantiles(values(of), counts, 0.5) for of in (lambda x, ratio: x, lambda x, ratio: ratio))
    spread = np.maximum(0.0, quantiles(values(lambda x, ratio: ratio - np.interp(x, at, middle)), counts, 0.99))
    return Limits(at, low * middle, middle + reach * spread)


def chunks_of(text: bytes) -> list[bytes]:
    """Whole chunks, and the tail if the last one leaves something; none of a text shorter than a chunk."""
    whole = [text[k : k + CHUNK] for k in range(0, len(text) - CHUNK + 1, CHUNK)]
    rest = len(text) % CHUNK
    return [*whole, text[-max(rest, TAIL) :]] if whole and rest else whole


def pieces(texts: list[bytes]) -> dict[str, pa.Array]:
    """Length (as log2) and ratio of each text and of all its chunks; none of texts that the base rule on words fails."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    taken = [[text, *chunks_of(text)] if len(text.split()) >= 50 else [] for text in texts]
    return {"pieces": pa.array([[{"x": float(np.log2(len(p))), "ratio": len(packer.compress(p)) / len(p)} for p in t] for t in taken], pa.list_(pa.struct([("x", pa.float64()), ("ratio", pa.float64())])))}


def learn_limits(docs: DataFrame, labels: DataFrame, text: str = "text", mark: str = "quality") -> Limits | None:
    """Limits of all documents labelled good outside the held-out fold."""
    good = labelled(labels.where(~held_out()), mark).where("mark >= 0.5").select("doc_id")
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out())
    measured = map_texts(rows, "text", pieces, "pieces array<struct<x: double, ratio: double>>", ["doc_id"]).where("size(pieces) > 0")
    found = materialize(measured.join(good, "doc_id").select(F.inline("pieces")).groupBy("x", "ratio").agg(F.count(F.lit(1)).alias("weight")), "pieces")
    limits = fit_all(found)
    drop_table(found)
    return limits


def compression_verdict(text: bytes, packer: zstandard.ZstdCompressor, limits: Limits | None) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole, chunks with the tail, chunks outside their limits, and whether the bands accept the text."""
    if not text:
        return None, 0, 0, False
    ratio = len(packer.compress(text)) / len(text)
    chunks = chunks_of(text)
    if limits is None:
        return ratio, len(chunks), 0, True

    def within(size: int, packed: float) -> bool:
        lowest, highest = limits.of(size)
        return lowest <= packed <= highest

    outside = sum(not within(len(x), len(packer.compress(x)) / len(x)) for x in chunks)
    return ratio, len(chunks), outside, within(len(text), ratio) and SHARE * outside <= len(chunks)


def measure(texts: list[bytes], limits: Limits | None = None) -> dict[str, pa.Array]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    for text in texts:
        words = text.split()
        data = np.frombuffer(text, np.uint8)
        spaces = int(_SPACE[data].sum())
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        repeated = repeated_window_words(words)
        ratio, chunks, outside, accepted = compression_verdict(text, packer, limits)
        failed = len(words) < 50 or 100 * repeated > 50 * len(words)
        rows.append((len(words), int(((data & 0xC0) != 0x80).sum()) - spaces, int(_SYMBOLS[data].sum()), len(lines) - len(set(lines)), repeated, failed, accepted and not failed, ratio, chunks, outside))
    kinds = dict(n_words=pa.int64(), word_chars=pa.int64(), n_symbols=pa.int64(), n_dup_lines=pa.int64(), n_repeat_words=pa.int64(), base_failed=pa.bool_(), kept=pa.bool_(), ratio=pa.float64(), n_chunks=pa.int64(), chunks_outside=pa.int64())
    return {name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), zip(*rows, strict=True), strict=True)}


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, chunks_outside long"


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, limits: Limits | None = None) -> DataFrame:
    """docs (or its ``keep`` columns) with the counts, the ratios and the verdict ``kept``."""
    return map_texts(docs, text, lambda texts: measure(texts, limits), SCHEMA, keep)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules(docs, keep=["doc_id"], limits=learn_limits(docs, read(spark, sf_dir, "labels")))
