"""License scans: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser reads expressions.

A text is lower-cased (A-Z), cut into words (digits, a-z and everything beyond ASCII) and matched as one
string of words, so that a phrase is found across any punctuation. Behind an identifier tag and its colon the raw
text is read as a licence expression: identifiers joined by AND, OR and WITH, with parentheses and a trailing plus. It
may go on in the next line, behind the sign of a comment, where an operator or a parenthesis wants more or where the
line begins with an operator in capitals. A small-lettered operator counts only before an identifier that is known, as
it may be prose. Every licence of the expression is a label, one that is not in the table behind "unknown:"; the exception
that WITH names is none. The words "license" and "licence" are tags too where a colon and known identifiers follow.
Reading takes time in proportion to the text.

Defined cases: null or empty text has no words, empty labels and score 0; a tag without a colon or an identifier, or
with a malformed expression, gives no label of its own and verdict null, the tag is still reported.
"""

from __future__ import annotations

import re
from importlib.resources import files

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, read

#: Phrases of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices, with label and weight of evidence.
NOTICES = {
    "apache license": ("apache", 0.9),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "isc license": ("isc", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "creative commons": ("cc", 0.6),
    "cc0": ("cc0", 0.8),
    "public domain": ("public-domain", 0.5),
    "unlicense": ("unlicense", 0.7),
    "proprietary and confidential": ("proprietary", 0.8),
}
BASE_WEIGHT = {"cc-by": 0.8, "gpl": 0.9, "reserved": 0.7}
TAGS = ("spdx license identifier",)
TAG_WEIGHT = 0.95
#: Tags that are ordinary words: they count only with a colon behind them and identifiers that are all known.
WORD_TAGS = ("license", "licence")
#: Identifiers of the table in lower case, with how freely they may be used.
GRADES = {name.lower(): int(grade) for name, grade in (x.split() for x in files(__package__).joinpath("spdx.txt").read_text().splitlines() if x and not x.startswith("#"))}
UNKNOWN_WEIGHT = 0.5
#: Bytes behind a tag that are looked at first; more where the expression goes on.
WINDOW = 512

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?\+?")
_COLON = re.compile(r"[ \t]*[:=]")
_GAP = re.compile(r"[ \t]*+(?:\r?\n[ \t]*+(?:(?://+|#+|\*+|;+|--|%+)[ \t]*+)?)*+")
_RANK = {"or": 1, "and": 2, "with": 3}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS, *WORD_TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


_machine: list[ahocorasick.Automaton] = []


def parse_expression(text: str) -> list[str] | None:
    """Shunting yard: the expression in postfix order, lower-cased; None if malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(text):
        word = token.lower()
        if word in _RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif word == "(":
            if not operand_next:
                return None
            stack.append(word)
        elif word == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                return None
            out.append(word)
            operand_next = False
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out if out and not operand_next else None


def grade_of(identifier: str) -> int:
    """2 free, 1 with duties, 0 not usable or unknown; a trailing plus and -only / -or-later don't matter."""
    return GRADES.get(re.sub(r"(\+|-only|-or-later)$", "", identifier), 0)


def evaluate(postfix: list[str]) -> int:
    """AND binds to the strictest side, OR to the freest, WITH keeps the licence's grade but at least 1."""
    stack: list[int] = []
    for token in postfix:
        if token not in _RANK:
            stack.append(grade_of(token))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(max(left, right) if token == "or" else min(left, right) if token == "and" else max(left, 1) if left else 0)
    return stack[-1]


def licences_of(postfix: list[str]) -> set[str]:
    """Identifiers of a postfix expression, without those that WITH names as exceptions."""
    stack: list[set[str]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append({token})
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if token == "with" else left | right)
    return stack[-1] if stack else set()


def _is_known(identifier: str) -> bool:
    return re.sub(r"(\+|-only|-or-later)$", "", identifier.lower()) in GRADES


def _word_ends(raw: bytes) -> np.ndarray:
    plain = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    return np.flatnonzero(plain & ~np.append(plain[1:], False)) + 1


def _expression_after(raw: bytes, begin: int) -> str:
    """The expression behind a tag that ends at that byte, and its colon, as far as it goes; tokens joined by blanks.

    It is read in a window of the text, which grows while the expression reaches its end.
    """
    size = WINDOW
    while True:
        text = raw[begin : begin + size].decode(errors="ignore")
        found, ended = _expression(text)
        if ended or begin + size >= len(raw):
            return found
        size *= 4


def _expression(text: str) -> tuple[str, bool]:
    """(tokens, whether the expression ends before the text does)."""
    colon = _COLON.match(text)
    at = colon.end() if colon else len(text)
    if not colon:
        return "", bool(text.strip(" \t"))
    kept, operand_next, depth, loose = [], True, 0, False
    while True:
        gap = _GAP.match(text, at)
        token = _TOKEN.match(text, gap.end())
        # what stops within a few signs of the end may go on behind it
        open_ = (gap.end() if token is None else token.end()) > len(text) - 8
        if token is None:
            break
        word, next_line = token[0], "\n" in gap[0]
        if word == "(" and operand_next:
            depth += 1
        elif word == ")" and depth and not operand_next:
            depth -= 1
        elif word.lower() in _RANK and not operand_next:
            if next_line and not depth and not word.isupper():
                break
            operand_next, loose = True, not word.isupper()
        elif word not in "()" and word.lower() not in _RANK and operand_next:
            if (next_line and not kept) or (loose and not _is_known(word)):
                break
            operand_next = loose = False
        else:
            break
        kept.append(word)
        at = token.end()
    if loose:
        kept.pop()
    return " ".join(kept), not open_


def scan_text(raw: bytes) -> dict:
    """Words, places of phrases as (first word, words, phrase), expressions as (text, grade or None), labels and score."""
    words = raw.translate(_WORDS).split()
    found = {"n_words": len(words), "places": [], "expressions": []}
    if words:
        if not _machine:
            _machine.append(_automaton())
        line = b" ".join([b"", *words, b""])
        hits = list(_machine[0].iter(line.decode("latin-1")))
        if hits:
            blanks, ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32), None
            firsts = np.searchsorted(blanks, [end for end, _ in hits])
            for last, (_, phrase) in zip(firsts.tolist(), hits, strict=True):
                n = phrase.count(" ") + 1
                first = last - n
                if phrase not in WORD_TAGS:
                    found["places"].append((first, n, phrase))
                    if phrase not in TAGS:
                        continue
                ends = _word_ends(raw) if ends is None else ends
                text = _expression_after(raw, int(ends[last - 1]))
                postfix = parse_expression(text)
                if phrase in TAGS or (postfix and all(map(_is_known, licences_of(postfix)))):
                    found["expressions"].append((text, evaluate(postfix) if postfix else None, postfix or []))
    base = {BASE[p] for _, _, p in found["places"] if p in BASE}
    weights = {x: BASE_WEIGHT[x] for x in base}
    for _, _, p in found["places"]:
        if p in NOTICES:
            label, weight = NOTICES[p]
            weights[label] = max(weight, weights.get(label, 0.0))
    for _, _, postfix in found["expressions"]:
        for x in licences_of(postfix):
            weights |= {x: TAG_WEIGHT} if _is_known(x) else {f"unknown:{x}": UNKNOWN_WEIGHT}
    doubt = 1.0
    for x in sorted(weights):
        doubt *= 1.0 - weights[x]
    if not weights and found["expressions"]:
        doubt = 1.0 - 0.5
    return found | {"base_labels": sorted(base), "labels": sorted(weights), "score": 1.0 - doubt}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<first_word:long,n_words:long,phrase:string>>, expressions array<struct<text:string,grade:int>>, usable boolean"


def scan(texts: list[bytes]) -> dict[str, pa.Array]:
    rows = []
    for raw in texts:
        x = scan_text(raw)
        starts = [first for first, _, phrase in x["places"] if phrase in BASE]
        grades = [grade for _, grade, _ in x["expressions"] if grade is not None]
        rows.append((x["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(x["base_labels"]), ",".join(x["labels"]), x["score"],
                     [{"first_word": a, "n_words": n, "phrase": p} for a, n, p in x["places"]], [{"text": t, "grade": g} for t, g, _ in x["expressions"]], min(grades) > 0 if grades else None))
    place = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("phrase", pa.string())]))
    expression = pa.list_(pa.struct([("text", pa.string()), ("grade", pa.int32())]))
    kinds = dict(n_words=pa.int64(), n_base=pa.int64(), first_word=pa.int64(), last_word=pa.int64(), base_labels=pa.string(), labels=pa.string(), score=pa.float64(), places=place, expressions=expression, usable=pa.bool_())
    return {name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), zip(*rows, strict=True), strict=True)}


def license_scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its ``keep`` columns) with places, expressions, labels and score of each text."""
    return map_texts(docs, text, scan, SCHEMA, keep)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    out = license_scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "usable")
