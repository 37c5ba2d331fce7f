"""Substring dedup by level-wise doubling: words inside a window that occurs elsewhere too are removed.

A window of W words can only repeat if its halves repeat. The first level therefore asks about windows of a
fraction of W (18 words for W = 35); only windows whose part is repeated go on to twice that length, and
the last length is W itself; a level without a repeat ends the search. Below W a level need not ask about every
part: each W-word window answers for the part with the smallest hash inside it, which is the same part wherever
that window stands, so about a tenth of all positions are asked about and no repeated window is lost.

A question is a row (hash, text). Rows are dealt by hash and read in order: a run of two or more is
repeated, and its rows go back to their texts. Of a hash that is frequent in one task, only the first
rows are asked about; the task knows the others to be repeated, and they skip the deal. So a passage
shared by a third of all documents is a few rows per task.

After the first level, texts with a repeated part are reduced to distinct texts and numbered; a text that had
copies answers for itself and is asked about on behalf of others only. Texts are told apart by 128 bits, and so are
windows at the last level; below it, a collision only lets a window be asked about in vain. Documents meet the
answers by key: the query's rows carry counts and digests, never texts, through that join.

Defined cases: null or empty text has no words; a text shorter than a window keeps all words and takes part in no
join; repeated rows are each other's copies, so every window of them goes; a text that loses nothing stays as it is
in the pipeline; an empty table gives no rows; columns of the caller's that bear a name of ours are replaced by
``remove_repeats`` and kept by the pipeline's stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flatten_words, free_shuffles, map_texts, materialize, read, slices, xxh64_many

WINDOW = 35
#: No level asks about windows of fewer words than this.
SHORTEST = 12
#: Hashes, and texts, that a task may remember as seen before; what it can't remember is asked about again.
KNOWN = 200_000
_HIDDEN = "__own_"


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the first level to the last, each at most twice the one before."""
    found = [window]
    while (found[0] + 1) // 2 >= shortest:
        found.insert(0, (found[0] + 1) // 2)
    return found


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the pair (a, b)."""
    x = (a ^ np.uint64(0x9E3779B97F4A7C15 + salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def window_hashes(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` word hashes, by doubling."""
    if length == 1:
        return words
    half = (length + 1) // 2
    part = window_hashes(words, half, salt)
    shift = length - half
    return _mix(part[:-shift], part[shift:], salt) if len(part) > shift else part[:0]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest of every ``width`` values in a row."""
    at = np.arange(len(values))
    low, done = values, 1
    while done < width:
        shift = min(done, width - done)
        if len(low) <= shift:
            return at[:0]
        right = low[shift:] < low[:-shift]
        at = np.where(right, at[shift:], at[:-shift])
        low = np.where(right, low[shift:], low[:-shift])
        done += shift
    return at


class Repeats:
    """Tells which of a task's questions need no asking: frequent ones, of which two were asked before."""

    def __init__(self) -> None:
        self.ha = self.hb = np.zeros(0, np.uint64)

    def known_of(self, ha: np.ndarray, hb: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ha), bool)
        if len(self.ha):
            at = np.minimum(np.searchsorted(self.ha, ha), len(self.ha) - 1)
            out = (self.ha[at] == ha) & (self.hb[at] == hb)
        order = np.lexsort((hb, ha))
        a, b = ha[order], hb[order]
        third = np.zeros(len(ha), bool)
        third[2:] = (a[2:] == a[:-2]) & (b[2:] == b[:-2])
        out[order[third]] = True
        if len(self.ha) < KNOWN:  # one entry a first half: the few others are asked about
            self.ha, first = np.unique(np.concatenate([self.ha, a[third]]), return_index=True)
            self.hb = np.concatenate([self.hb, b[third]])[first]
        return out


class _Chunk:
    """Words of a slice of texts: hashes and, for every W-window that lies in one text, its text."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        data, starts, lengths, self.counts = flatten_words(texts)
        self.words = xxh64_many(data, starts, lengths)
        self.first = np.cumsum(self.counts) - self.counts
        fit = np.maximum(self.counts - window + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), fit)
        self.at = np.arange(int(fit.sum())) - np.repeat(np.cumsum(fit) - fit, fit) + self.first[self.text]

    def open(self, batch: pa.RecordBatch, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of the windows whose part was repeated at the level before: ``prior`` words, hashes ``hs``; all where there was none."""
        if not len(self.at):
            return self.at, self.text
        prior = batch.column(batch.schema.get_field_index("prior"))[0].as_py()
        if not prior:
            return self.at, self.text
        column = batch.column(batch.schema.get_field_index("hs"))
        lists = [column[int(k)].values.to_numpy(zero_copy_only=False).view(np.uint64) for k in rows]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        hashes = window_hashes(self.words, prior)
        anchor = sliding_argmin(hashes, window - prior + 1)[self.at]
        repeated = np.isin(_salted(self.text, hashes[anchor]), _salted(owner, np.concatenate(lists)))
        return self.at[repeated], self.text[repeated]


def _salted(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


_ASKED = "ha long, hb long, k1 long, k2 long, copied boolean, sure boolean"


def _asked(ha: np.ndarray, hb: np.ndarray, k1: np.ndarray, k2: np.ndarray, copied: np.ndarray, repeats: Repeats) -> pa.RecordBatch:
    sure = repeats.known_of(ha, hb) & ~copied
    columns = [ha.view(np.int64), hb.view(np.int64), k1, k2, copied, sure]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["ha", "hb", "k1", "k2", "copied", "sure"])


def _ask_parts(texts: DataFrame, length: int, window: int) -> DataFrame:
    """Questions of a level below W, about texts (k1, k2, text) or candidates with ``prior`` and ``hs``; k1 and k2 name the text."""
    later = "hs" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, seen = Repeats(), {}
        for batch, raw in slices(batches, "text"):
            k1, k2 = (batch.column(k).to_numpy() for k in range(2))
            rows = []
            for k, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):  # a third copy of a text tells nothing new
                n = seen.get(key, 0)
                if n < 2:
                    rows.append(k)
                    if n or len(seen) < KNOWN:
                        seen[key] = n + 1
            rows = np.array(rows, np.int64)
            chunk = _Chunk([raw[k] for k in rows], window)
            at, text = chunk.open(batch, rows, window) if later else (chunk.at, chunk.text)
            if not len(at):
                continue
            hashes = window_hashes(chunk.words, length)
            picked = sliding_argmin(hashes, window - length + 1)[at]
            new = np.concatenate([[True], picked[1:] != picked[:-1]])
            text, ha = text[new], hashes[picked[new]]
            copied = batch.column(batch.schema.get_field_index("copied")).to_numpy(zero_copy_only=False)[rows][text] if later else np.zeros(len(ha), bool)
            yield _asked(ha, np.zeros(len(ha), np.uint64), k1[rows][text], k2[rows][text], copied, repeats)

    return texts.mapInArrow(run, _ASKED)


def _ask_windows(candidates: DataFrame, window: int) -> DataFrame:
    """Questions of the last level, about the open windows of candidates; k1 is the text's number and k2 the window's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = Repeats()
        for batch, raw in slices(batches, "text"):
            rows = np.arange(len(raw))
            chunk = _Chunk(raw, window)
            at, text = chunk.open(batch, rows, window)
            if not len(at):
                continue
            ha, hb = (window_hashes(chunk.words, window, salt)[at] for salt in (0, 1))
            number, copied = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            yield _asked(ha, hb, number[text], at - chunk.first[text], copied[text], repeats)

    return candidates.select("number", "copied", "text", "hs", "prior").mapInArrow(run, _ASKED)


def _repeated(asked: DataFrame, answer_copied: bool = True) -> DataFrame:
    """Of the questions, those whose hash was asked twice or more, or by a copied text: (ha, k1, k2). At the last level copied texts need no answer."""
    dealt = asked.withColumn("deal", F.when(F.col("sure"), F.xxhash64("k1", "k2", "ha")).otherwise(F.col("ha")))
    placed = dealt.repartition("deal").sortWithinPartitions("ha", "hb")
    names = ["ha", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # first row of the last run, until a second one comes
        run_of = None  # hash of the last run
        for batch in batches:
            ha, hb, k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            copied, sure = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            if not len(ha):
                continue
            same = np.concatenate([[run_of == (ha[0], hb[0])], (ha[1:] == ha[:-1]) & (hb[1:] == hb[:-1])])
            twice = same.copy()
            twice[:-1] |= same[1:]
            out = twice | sure | copied if answer_copied else (twice | sure) & ~copied
            extra = [held] if same[0] and held is not None else []
            held = None
            run_of = (ha[-1], hb[-1])
            if not same[-1] and not sure[-1] and not copied[-1]:  # a new run of one row: wait for the next batch
                held = (ha[-1], k1[-1], k2[-1])
            columns = [np.concatenate([np.array([x[k] for x in extra], np.int64), v[out]]) for k, v in enumerate((ha, k1, k2))]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return placed.drop("deal").mapInArrow(run, "ha long, k1 long, k2 long")


def keys_of(text: Column, window: int) -> list[Column]:
    """128 bits that name a text, as k1 and k2. A text too short to hold a window has no k2 and joins nothing."""
    long_enough = F.length(text) >= 2 * window - 1
    return [F.when(long_enough, F.xxhash64(text)).otherwise(F.xxhash64(F.monotonically_increasing_id())).alias("k1"), F.when(long_enough, F.xxhash64(F.lit(1), text)).alias("k2")]


def repeated_texts(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """k1, k2, n_removed, kept_text: the distinct texts that lose words, with the words left joined by one blank."""
    spark = docs.sparkSession
    whole = F.col(f"`{text}`")
    long_enough = F.length(whole) >= 2 * window - 1
    texts = docs.where(long_enough).select(*keys_of(whole, window), whole.alias("text"))
    none = spark.createDataFrame([], "k1 long, k2 long, n_removed long, kept_text string")
    steps = levels(window)
    source = texts
    for length in steps[:-1]:
        hits = materialize(_repeated(_ask_parts(source, length, window)).groupBy("k1", "k2").agg(F.collect_set("ha").alias("hs")), "parts")
        free_shuffles(spark)
        if hits.isEmpty():
            return none
        if source is texts:
            # any copy of a text is that text: what copies share is combined before the shuffle
            distinct = texts.groupBy("k1", "k2").agg(F.any_value("text").alias("text"), (F.count(F.lit(1)) > 1).alias("copied"))
        else:
            distinct = source.select("k1", "k2", "text", "copied")
        source = materialize(distinct.join(hits, ["k1", "k2"]).withColumns({"prior": F.lit(length), "number": F.monotonically_increasing_id()}), "candidates")
        free_shuffles(spark)
    if source is texts:  # the window is its own first level: every long text is a candidate
        distinct = texts.groupBy("k1", "k2").agg(F.any_value("text").alias("text"), (F.count(F.lit(1)) > 1).alias("copied"))
        source = materialize(distinct.withColumns({"hs": F.array().cast("array<bigint>"), "prior": F.lit(0), "number": F.monotonically_increasing_id()}), "candidates")
    found = materialize(_repeated(_ask_windows(source, window), False).groupBy(F.col("k1").alias("number")).agg(F.collect_list("k2").alias("places")), "places")
    free_shuffles(spark)
    return _cut(source.select("number", "k1", "k2", "copied", "text").join(found, "number", "left").where(F.col("copied") | F.col("places").isNotNull()), window)


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """rows (k1, k2, copied, places, text) without the words of the windows at ``places``, or of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, "text"):
            gone, left = [], []
            for k, x in enumerate(raw):
                words = x.split()
                if batch.column(2)[k].as_py():
                    kept = words if len(words) < window else []
                else:
                    edges = np.zeros(len(words) + 1, np.int64)
                    begin = batch.column(3)[k].values.to_numpy(zero_copy_only=False)
                    edges[begin] += 1
                    edges[begin + window] -= 1
                    kept = list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
                gone.append(len(words) - len(kept))
                left.append(b" ".join(kept))
            made = [pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["k1", "k2", "n_removed", "kept_text"])

    return rows.select("k1", "k2", "copied", "places", "text").mapInArrow(run, "k1 long, k2 long, n_removed long, kept_text string")


def count_words(texts: list[bytes]) -> dict[str, pa.Array]:
    """Words of each text, and the digest of all of them joined by one blank."""
    split = [x.split() for x in texts]
    return {"n_words": pa.array(list(map(len, split)), pa.int64()), "whole_sha256": pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in split])}


def with_answers(docs: DataFrame, answers: DataFrame, k1: str, k2: str) -> DataFrame:
    """docs with the columns of ``answers`` (k1, k2, ...) of their texts, null where there is none."""
    renamed = answers.withColumnRenamed("k1", "__a1").withColumnRenamed("k2", "__a2")
    return docs.join(renamed, (F.col(k1) == F.col("__a1")) & (F.col(k2) == F.col("__a2")), "left").drop("__a1", "__a2", k1, k2)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """docs (or its ``keep`` columns) with n_words, n_removed and kept_text, the words left joined by one blank."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "n_removed", "kept_text")]
    own = [f"{_HIDDEN}{k}" for k in range(len(names))]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    k1, k2 = keys_of(whole, window)
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)], k1.alias("__k1"), k2.alias("__k2"), whole.alias("__whole"))
    met = with_answers(rows, repeated_texts(docs, text, window), "__k1", "__k2")

    def joined(texts: list[bytes]) -> dict[str, pa.Array]:
        split = [x.split() for x in texts]
        return {"__n": pa.array(list(map(len, split)), pa.int64()), "__all": pa.array([b" ".join(x) for x in split], pa.binary()).cast(pa.string())}

    out = map_texts(met, "__whole", joined, "__n long, __all string", [*own, "n_removed", "kept_text"])
    return out.select(*[F.col(o).alias(c) for c, o in zip(names, own, strict=True)], F.col("__n").alias("n_words"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_text", "__all").alias("kept_text"))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    answers = repeated_texts(docs).select("k1", "k2", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
    counted = map_texts(docs.select("doc_id", *keys_of(F.col("text"), WINDOW), "text"), "text", count_words, "n_words long, whole_sha256 string", ["doc_id", "k1", "k2"])
    met = with_answers(counted, answers, "k1", "k2")
    return met.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def substring_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all rows and columns of docs; where words were removed, text is what is left and n_chars its length."""
    own = [f"{_HIDDEN}{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)], *[k.alias(f"__{n}") for n, k in zip(("k1", "k2"), keys_of(F.col("text"), WINDOW), strict=True)])
    met = with_answers(rows, repeated_texts(docs), "__k1", "__k2")
    changed = F.coalesce(F.col("n_removed") > 0, F.lit(False))
    kinds = dict(docs.dtypes)
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col(own[docs.columns.index("text")]))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(kinds["n_chars"])).otherwise(F.col(own[docs.columns.index("n_chars")]))
    return met.select(*[new.get(c, F.col(o)).alias(c) for c, o in zip(docs.columns, own, strict=True)])
