"""License scan: Aho-Corasick over phrases and tags, shunting-yard over expressions.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and
non-ASCII characters. One automaton finds all phrases at once in the words
joined by blanks. Where it finds an identifier tag, the licence expression
behind the tag in the raw text is parsed by the shunting-yard algorithm:
``with`` binds closest, then ``and``, then ``or``; parentheses group.

Defined results: a null or empty text has no words, no places, null word
positions, empty labels and score 0; an expression that does not parse gives
the identifiers that it names and no verdict; repeated rows and rows that
share an id are each returned; very long texts are scanned whole; no rows give
no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import buffers, slices

#: The phrases counted as base places, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices, with label and weight of the evidence.
NOTICES = {
    "apache license": ("apache-2.0", 0.8),
    "licensed under the apache license": ("apache-2.0", 0.9),
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0": ("cc0", 0.6),
    "public domain": ("public-domain", 0.4),
    "gnu general public license": ("gpl", 0.9),
}
TAGS = ("spdx license identifier",)
BASE_WEIGHT = {"cc-by": 0.7, "gpl": 0.8, "reserved": 0.5}
#: Licences that allow reuse with attribution at most.
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib", "0bsd"}
_TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([A-Za-z0-9.+() \t-]+)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = (
    "key long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, expressions array<string>, permissive boolean"
)
_NAMES = ["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's tokens in postfix order; None if it does not parse."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether an operand has just ended
    for token in _TOKEN.findall(expression.lower()):
        if token in _RANK:
            if not operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = False
        elif token == "(":
            if operand:
                return None
            held.append(token)
        elif token == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in held:
        return None
    return out + held[::-1]


def permits(postfix: list[str]) -> bool:
    """Whether some choice among the ``or`` branches is wholly permissive."""
    stack: list[bool] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if token == "or" else left and right if token == "and" else left)
        else:
            stack.append(token in PERMISSIVE)
    return stack.pop()


def licences(postfix: list[str]) -> set[str]:
    """The licences of an expression; what stands behind ``with`` is an exception, not a licence."""
    stack: list[set[str]] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left | right)
        else:
            stack.append({token})
    return stack.pop()


def named(expression: str) -> set[str]:
    """The identifiers of an expression that does not parse, exceptions left out."""
    tokens = _TOKEN.findall(expression.lower())
    return {t for before, t in zip([""] + tokens, tokens, strict=False) if t not in _RANK and t not in "()" and before != "with"}


def expressions(text: str) -> list[str]:
    """The licence expressions behind identifier tags, cut where words stop alternating with operators."""
    found = []
    for m in _TAG.finditer(text):
        taken: list[str] = []
        depth, operand = 0, False
        for token in _TOKEN.findall(m[1]):
            low = token.lower()
            if operand and low not in _RANK and token != ")" or token == ")" and not depth:
                break
            depth += (token == "(") - (token == ")")
            operand = low not in _RANK and token != "("
            taken.append(token)
        while taken and taken[-1].lower() in _RANK:
            taken.pop()
        if taken:
            found.append(" ".join(taken))
    return found


def automaton():
    import ahocorasick

    built = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        built.add_word(f" {phrase} ", phrase)
    built.make_automaton()
    return built


def scan_text(raw: bytes, built) -> tuple:
    """One text's row without its key."""
    words = raw.translate(_WORDS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, [], None
    joined = f" {b' '.join(words).decode('latin-1')} "
    base: list[int] = []
    base_labels, labels, evidence, tagged = set(), set(), {}, False
    at = word = 0  # blanks before ``at``
    for end, phrase in built.iter(joined):
        if phrase in BASE:
            start = end - len(phrase) - 1
            word += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at = start
            base.append(word)
            base_labels.add(BASE[phrase])
            evidence[BASE[phrase]] = max(evidence.get(BASE[phrase], 0), BASE_WEIGHT[BASE[phrase]])
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            evidence[label] = max(evidence.get(label, 0), weight)
        tagged |= phrase in TAGS
    parsed = expressions(raw.decode("utf-8")) if tagged else []
    permissive = None
    for e in parsed:
        postfix = to_postfix(e)
        found = licences(postfix) if postfix else named(e)
        labels.update(found)
        evidence.update(dict.fromkeys(found, 0.95))
        if postfix:
            permissive = (permissive is not False) and permits(postfix)
    doubt = 1.0
    for label in sorted(evidence):
        doubt *= 1 - evidence[label]
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | labels)), 1 - doubt, parsed, permissive,
    )


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, counts, places, labels, score, expressions and their verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
        for b in batches:
            for s in slices(b):
                data, offsets = buffers(s.column(1))
                data = data.tobytes()
                rows = [scan_text(data[i:j], built) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([s.column(0), *columns], _NAMES)

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return common.mapped(chosen, run, SCHEMA).withColumnRenamed("key", key)
