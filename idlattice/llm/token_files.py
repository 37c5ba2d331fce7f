"""Token ids in ORC: documents in order of id, one row each, ids as integer runs.

The files keep row indexes and a Bloom filter on ``doc_id``, so that readers prune stripes by statistics
and split a file by stripe. Tokens come from the tokenizers library; as white space is dropped and
never part of a token, a text's ids are those of its blank-free words in turn, and a bounded cache
keeps each word's ids, packed, as the library gave them.

Defined cases: null or empty text is the end id alone; null doc_id comes first; documents of equal id
stand in the order of their texts' hash; an empty table makes an empty file set.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LONGEST, materialize, new_path, read, slices

END_ID = 1
#: Words that a worker keeps from one slice to the next.
WORDS_KEPT = 500_000
#: Settings of the writer.
ORC_OPTIONS = {"compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
# White space that the tokenizer's \s drops and that Python's str.split() splits at.
_SPLIT = regex.compile(r"\S+")
# First bytes of white space beyond ASCII; a text without them is cut at ASCII white space.
_WIDE_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
# Letters whose lower-case and normal forms are single characters; U+0130, U+0131 and U+0149 are left to the library.
_PLAIN = regex.compile(r"[\x20-\x7e¡-¬®-įĲ-ňŊ-ž]+")
# The tokenizer's pattern on lower-case ASCII, and the blank between words.
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 ]+| ")


class WordEncoder:
    """ids of blank-free words by the library, packed as little-endian unsigned 32-bit integers.

    Words that a slice of texts brings for the first time are encoded together. Those of plain letters are cut into
    pre-tokens by one search over all of them and given to the library's model in one call, through a tokenizer of
    the same model that only splits at blanks; the last token of every pre-token bears the word-end mark. All
    other words go through the whole tokenizer one by one.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        state = json.loads(self.tokenizer.to_str())
        pattern = next(p["pattern"]["Regex"] for p in state["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(f"{pattern}| ")
        mark = state["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith(mark)]] = True
        self.plain = Tokenizer.from_str(json.dumps(state | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.letters = dict(enumerate(_byte_letters())) | {32: " "}
        self.words: dict[bytes, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: set[bytes]) -> list[bytes]:
        """Make all the words known; the new ones."""
        new = [w for w in words if w not in self.words]
        plain = new
        text = b" ".join(new).decode()
        if "<|" in text or not _PLAIN.fullmatch(text):
            plain = []
            for word in new:
                one = word.decode()
                if "<|" not in one and _PLAIN.fullmatch(one):
                    plain.append(word)
                else:
                    self.words[word] = self._whole(one)
            text = b" ".join(plain).decode()
        if plain:
            parts = (_ASCII_PARTS if text.isascii() else self.split).findall(text.lower())
            spelled = " ".join(parts).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.plain.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            blank = np.array([x == " " for x in parts])
            upto = np.cumsum(~blank)
            if len(ends) != upto[-1] or int(blank.sum()) != len(plain) - 1:  # the model makes something else of them: word by word
                self.words.update((w, self._whole(w.decode())) for w in plain)
                return new
            cuts = (4 * ends[np.append(upto[blank], upto[-1]) - 1]).tolist()
            packed = ids.tobytes()
            self.words.update(zip(plain, [packed[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        return new

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of whole texts. Long words are not kept; a cache that is full keeps what it had before these texts."""
        split = [[w.encode() for w in _SPLIT.findall(x.decode())] if any(map(x.__contains__, _WIDE_SPACES)) else x.split() for x in texts]
        new = self._learn(set(chain.from_iterable(split)))
        get = self.words.__getitem__
        packed = [b"".join(map(get, words)) for words in split]
        full = len(self.words) > WORDS_KEPT
        for w in new:
            if full or len(w) > LONGEST:
                del self.words[w]
        return packed


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(2)
def encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_token_files(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode the texts and write ``doc_id, tie, ids`` as ORC, range-partitioned and sorted by doc_id."""
    file = tokenizer or default_tokenizer()
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("tie"), F.col(f"`{text}`").alias("__text"))
    placed = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        for batch, texts in slices(batches, "__text"):
            packed = [x + end for x in own.encode(texts)]
            begin = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(begin), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "tie", "ids"])

    encoded = placed.mapInArrow(run, "doc_id long, tie long, ids array<int>")
    encoded.write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, tie, ids of the files; a filter on doc_id prunes stripes."""
    return spark.read.schema("doc_id long, tie long, ids array<int>").orc(path)


def token_index(files: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files hold disjoint ranges in order, so a file's start is the sum of the files before it, and only
    one row per file is gathered. Equal (doc_id, tie) are equal texts and may stand in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            begin = lists.offsets.to_numpy()
            flat = np.asarray(lists.values).astype("<i4", copy=False).view(np.uint8).tobytes()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(begin).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "tie", "file", "n_tokens", "ids_crc32"])

    rows = files.select("doc_id", "ids", "tie", F.input_file_name().alias("file")).mapInArrow(run, "doc_id long, tie long, file string, n_tokens long, ids_crc32 long")
    rows = materialize(rows, "token-rows")
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("first_tie")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "tie"))
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"), first.alias("first")).select("file", "file_tokens", F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"))
    starts = per_file.select("file", F.coalesce(F.sum("file_tokens").over(order), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(within)).join(starts, "file")
    return placed.select("doc_id", (F.col("file_start") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_orc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens.orc")
    write_token_files(read(spark, sf_dir, "documents"), path)
    return token_index(read_token_files(spark, path))
