"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regex: code points become classes by table, and a small automaton runs
over the classes. Its transition functions form a finite monoid, so the states at all positions come
from an associative scan: blocks compose their functions in step, block totals are scanned, and each
block is replayed from its entry state. The texts that a task holds at once are scanned as one, with a break between
them, and equal ones once. Slices between boundaries go through a bounded cache of merged pieces. Every
id keeps the byte offset it starts at; decoding gathers the tokens' bytes from one table to these offsets.

Pieces: a contraction ('s 't 're 've 'm 'll 'd), letters, numbers or other signs with at most one blank
before them, or white space, which leaves its last character to what follows.

Defined cases: null or empty text has no tokens, digest of the empty string; ids without a token decode to nothing;
a tokenizer with another pattern is refused, as boundaries follow this one.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import Cache, map_texts, read

#: Classes of code points. BLANK is U+0020; SPACE is other white space; QUOTE is the apostrophe.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)
#: The pattern whose matches the automaton finds.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What may follow the apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point, from Unicode's general categories L, N and white space."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(pattern, every))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


# --- the automaton -----------------------------------------------------------------------------
# State after a character: the kind of run it ends in, or how many letters a contraction still takes.
# An apostrophe opens a piece (rather than continuing one) unless a blank or another sign stands before it.
START, IN_LETTERS, IN_NUMBERS, IN_SIGNS, IN_SPACE, AFTER_BLANK, TAKE_ONE, TAKE_TWO, TAKEN = range(9)
_STATES = 9
# Symbols: the six classes, the apostrophe before a one- or a two-letter ending, and the break between texts.
_QUOTE_ONE, _QUOTE_TWO, _BREAK = 6, 7, 8
_SYMBOLS = 9


def _next_state(state: int, symbol: int) -> int:
    if symbol == _BREAK:
        return START
    if state == TAKE_TWO:
        return TAKE_ONE
    if state == TAKE_ONE:
        return TAKEN
    if symbol == LETTER:
        return IN_LETTERS
    if symbol == NUMBER:
        return IN_NUMBERS
    if symbol == SPACE:
        return IN_SPACE
    if symbol == BLANK:
        return AFTER_BLANK
    if symbol in (_QUOTE_ONE, _QUOTE_TWO) and state not in (IN_SIGNS, AFTER_BLANK):
        return TAKE_ONE if symbol == _QUOTE_ONE else TAKE_TWO
    return IN_SIGNS


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transition of a state by a symbol; function number of each symbol; products of functions by number; values of functions."""
    step = np.array([[_next_state(s, x) for s in range(_STATES)] for x in range(_SYMBOLS)], np.uint8)
    functions = {tuple(range(_STATES)): 0}
    todo = [tuple(map(int, row)) for row in step]
    for f in todo:
        functions.setdefault(f, len(functions))
    frontier = list(functions)
    while frontier:  # close under composition with single symbols
        new = []
        for f in frontier:
            for g in todo:
                h = tuple(g[s] for s in f)
                if h not in functions:
                    functions[h] = len(functions)
                    new.append(h)
        frontier = new
    values = np.array(list(functions), np.uint8)
    product = np.array([[functions[tuple(int(g[s]) for s in f)] for g in values] for f in values], np.uint16)
    return step, np.array([functions[f] for f in todo], np.uint16), product, values


def states_after(symbols: np.ndarray, block: int = 64) -> np.ndarray:
    """State after each symbol, by a blocked scan of transition functions; the work per symbol is constant."""
    step, number, product, values = _monoid()
    n = len(symbols)
    rows = -(-n // block)
    padded = np.zeros(rows * block, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, block).T)
    total = np.zeros(rows, np.uint16)
    for column in columns:  # each block's composed function
        total = product[total, number[column]]
    shift = 1
    while shift < rows:  # inclusive scan over the blocks by doubling
        total[shift:] = product[total[:-shift], total[shift:]]
        shift *= 2
    state = np.full(rows, START, np.uint8)
    state[1:] = values[total[:-1], START]
    out = np.empty((block, rows), np.uint8)
    for k, column in enumerate(columns):  # replay every block from its entry state
        out[k] = state = step[column, state]
    return out.T.ravel()[:n]


def piece_starts(text: str, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which pieces start, and the byte offset of every code point (and of the end).

    breaks: code points that stand between texts; each is a piece of its own.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    at = np.zeros(n + 1, np.int32 if n < 1 << 29 else np.int64)
    np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
    if n == 0:
        return np.zeros(0, np.int64), at
    symbols = class_table()[points]
    wide = (symbols == SPACE) | (symbols == BLANK)
    blank = symbols == BLANK
    quotes = np.flatnonzero(symbols == QUOTE)
    if len(quotes):
        tail = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = tail[quotes + 1], tail[quotes + 2]
        symbols[quotes] = OTHER
        symbols[quotes[np.isin(one, [ord(x) for x in ENDINGS if len(x) == 1])]] = _QUOTE_ONE
        for ending in ENDINGS:
            if len(ending) == 2:
                symbols[quotes[(one == ord(ending[0])) & (two == ord(ending[1]))]] = _QUOTE_TWO
    ends = wide
    if breaks is not None and len(breaks):
        symbols[breaks] = _BREAK
        ends = wide.copy()
        ends[breaks] = True
        wide[breaks] = blank[breaks] = False
    state = states_after(symbols)
    before = np.concatenate([[START], state[:-1]]).astype(np.uint8)
    follows = np.concatenate([ends[1:], [True]])  # white space or the end of a text behind
    # A run starts where its kind changes; a contraction's letters never start one.
    inside = (before == TAKE_ONE) | (before == TAKE_TWO)
    kind = np.array([0, 1, 2, 3, 4, 4, 5, 5, 6], np.uint8)
    start = (kind[state] != kind[before]) | (state == TAKE_ONE) | (state == TAKE_TWO)
    # White space: the last character of a run stands alone unless the text ends behind it ...
    last = wide & ~follows
    start[last] = True
    # ... and a blank there carries what follows, so that run doesn't start anew.
    carried = np.concatenate([[False], (last & blank)[:-1]])
    start &= ~(inside | carried)
    start[0] = True
    if breaks is not None and len(breaks):
        start[breaks] = True
        start[breaks[breaks + 1 < n] + 1] = True
    return np.flatnonzero(start), at


class BpeCodec:
    """Encoder and decoder over a rank file; one per Python worker."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        if pattern != PATTERN:
            raise ValueError("the boundaries of this encoder follow another pattern")
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.cache = Cache(lambda piece: array("i", merge(piece)).tobytes())
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = np.array(list(map(len, self.tokens)), np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.decimal = [str(k).encode() for k in range(len(self.tokens))]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in turn, and where each text's ids begin (and the end). The texts are scanned as one, with breaks between them."""
        decoded = [x.decode() for x in texts]
        breaks = (np.cumsum([len(x) + 1 for x in decoded]) - 1)[:-1]
        starts, at = piece_starts("\n".join(decoded), breaks)
        joined = b"\n".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cuts = at[starts].tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)], strict=True)]
        lists = list(map(self.cache.__getitem__, pieces))
        own = np.ones(len(lists), bool)
        own[np.searchsorted(starts, breaks)] = False
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) // 4 * own)])
        ids = np.frombuffer(b"".join(compress(lists, own.tolist())), np.int32)
        return ids, upto[np.concatenate([[0], np.searchsorted(starts, breaks), [len(lists)]])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token starts, and the end."""
        return np.concatenate([[0], np.cumsum(self.size[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered from one table to their offsets."""
        out = np.empty(int(offsets[-1]), np.uint8)
        for a in range(0, len(ids), 1 << 18):
            part, begin = ids[a : a + (1 << 18)], offsets[a : a + (1 << 18) + 1]
            out[begin[0] : begin[-1]] = self.bytes[np.arange(begin[0], begin[-1]) + np.repeat(self.first[part] - begin[:-1], self.size[part])]
        return out.tobytes()


@lru_cache(2)
def codec(rank_file: str, pattern: str) -> BpeCodec:
    return BpeCodec(rank_file, pattern)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, text: str = "text", tokenizer: tuple[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with ``ids`` and ``offsets`` (byte offset of each token in the UTF-8 text, and the end)."""
    files = tokenizer or default_tokenizer()

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        own = codec(*files)
        ids, begin = own.encode(texts)
        offsets = [own.offsets(ids[a:b]) for a, b in pairwise(begin.tolist())]
        return {"ids": pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids)), "offsets": pa.array(offsets, pa.list_(pa.int64()))}

    return map_texts(docs, text, run, "ids array<int>, offsets array<long>", keep)


def decode_documents(encoded: DataFrame, ids: str = "ids", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """encoded with ``decoded``, the bytes of its ids; null ids count as none."""
    from pyspark.sql import types as T

    files = tokenizer or default_tokenizer()
    names = [c for c in encoded.columns if c.lower() != "decoded"]
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*files)
        for batch in batches:
            lists = [np.array([k for k in x or () if k is not None and 0 <= k < len(own.tokens)], np.int64) for x in batch.column(at).to_pylist()]
            made = [own.decode(x, own.offsets(x)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*names, "decoded"])

    source = encoded.select(*[f"`{c}`" for c in names])
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, text: str = "text", tokenizer: tuple[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with the digests of encoding and decoding, both done in one Arrow pass: n_tokens, ids_sha256, decoded_sha256."""
    files = tokenizer or default_tokenizer()

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        own = codec(*files)
        number = {text: k for k, text in enumerate(dict.fromkeys(texts))}  # equal texts are worked on once
        ids, begin = own.encode(list(number))
        offsets = own.offsets(ids)
        decoded = own.decode(ids, offsets)
        spelled = list(map(own.decimal.__getitem__, ids.tolist()))
        digest = lambda x: hashlib.sha256(x).hexdigest()
        rows = [(b - a, digest(b" ".join(spelled[a:b])), digest(decoded[offsets[a] : offsets[b]])) for a, b in pairwise(begin.tolist())]
        columns = zip(*[rows[number[text]] for text in texts], strict=True)
        kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        return {name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), columns, strict=True)}

    return map_texts(docs, text, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), keep=["doc_id"])


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id with the number of tokens and the digests of ids and decoded text."""
    return round_trip(docs, keep=["doc_id"])
