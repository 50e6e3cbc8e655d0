"""Operator 10: license scans.

An Aho-Corasick automaton runs over each whole text, brought to lower-case words
with one blank between them, and finds notice phrases and identifier tags in one
pass whatever their number. Behind each tag the original text holds a licence
expression, which a shunting-yard parser turns to postfix and evaluates: OR offers
the freest of its sides, AND obliges to the strictest, WITH relaxes a copyleft
licence, + keeps the licence.

Rows: null and wordless texts have no findings and score 0. Overlapping phrases all
count. A malformed expression gives its known identifiers, joined by AND. Repeated
rows are scanned alike. Columns other than key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.llm.shared import ALNUM_BYTES, slices, table

# The base phrases and labels of the contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases in words, and the licence that each stands for.
NOTICES = {
    "permission is hereby granted free of charge": "MIT",
    "mit license": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license": "Apache-2.0",
    "gnu general public license": "GPL",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu lesser general public license": "LGPL",
    "gnu affero general public license": "AGPL-3.0-only",
    "mozilla public license": "MPL-2.0",
    "redistribution and use in source and binary forms": "BSD",
    "bsd license": "BSD",
    "boost software license": "BSL-1.0",
    "eclipse public license": "EPL-2.0",
    "creative commons attribution": "CC-BY-4.0",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc0 1 0": "CC0-1.0",
    "public domain": "CC0-1.0",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: How freely a work under a licence may be used: by the start of the identifier, the first that fits.
FREEDOM = [
    ("cc0", 1.0), ("unlicense", 1.0), ("0bsd", 1.0), ("mit", 0.95), ("isc", 0.95), ("bsd", 0.95), ("bsl", 0.95), ("zlib", 0.95),
    ("apache", 0.9), ("cc-by-nc", 0.2), ("cc-by-sa", 0.5), ("cc-by", 0.85), ("mpl", 0.6), ("epl", 0.55), ("lgpl", 0.5), ("gpl", 0.3), ("agpl", 0.15), ("reserved", 0.0),
]
UNKNOWN, RELAXED = 0.4, 0.25
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
_TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")


def freedom(licence: str) -> float:
    name = licence.lower()
    return next((v for start, v in FREEDOM if name.startswith(start)), UNKNOWN)


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard; ValueError if the expression is malformed. Tokens after a complete expression end it."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        op = token.upper()
        if op in PRECEDENCE:
            if operand_next:
                raise ValueError(f"operand expected before {token}")
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[op]:
                out.append(waiting.pop())
            waiting.append(op)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            waiting.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("operand expected before )")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("unmatched )")
            waiting.pop()
        elif operand_next:
            out.append(token)
            operand_next = False
        else:
            break
    if operand_next or "(" in waiting:
        raise ValueError("the expression ends early")
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """The freedom that an expression grants, and its identifiers."""
    stack: list[float] = []
    names: list[str] = []
    exception = set()
    for k, token in enumerate(postfix):
        if token == "WITH":
            stack.pop()
            stack.append(min(1.0, stack.pop() + RELAXED))
        elif token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(max(left, right) if token == "OR" else min(left, right))
        else:
            stack.append(freedom(token))
            if postfix[k + 1 : k + 2] == ["WITH"]:
                exception.add(token)
            names.append(token)
    return stack[0], [n for n in names if n not in exception]


def evaluate_text(expression: str) -> tuple[float, list[str]]:
    try:
        return evaluate(to_postfix(expression))
    except ValueError:
        names = [t for t in _TOKEN.findall(expression) if t not in "()" and t.upper() not in PRECEDENCE and freedom(t) != UNKNOWN]
        return min(map(freedom, names), default=0.0), names


def automaton(notices: dict[str, str] | None = None) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *(NOTICES if notices is None else notices), TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None, find: ahocorasick.Automaton, notices: dict[str, str]) -> dict:
    """All findings of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").translate(ALNUM_BYTES).split()
    plain = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, base, granted, names, tagged = [], set(), [], set(), False
    counted = at = 0
    for end, phrase in find.iter(plain):
        if phrase in BASE_PHRASES:
            start = end - len(phrase) - 1
            if start < at:
                counted = at = 0
            counted += plain.count(" ", at, start)
            at = start
            places.append(counted)
            base.add(BASE_PHRASES[phrase])
        if phrase in notices:
            names.add(notices[phrase])
            granted.append(freedom(notices[phrase]))
        tagged |= phrase == TAG
    expressions = []
    if tagged:
        for m in _TAGGED.finditer(text):
            value, ids = evaluate_text(m[1])
            expressions.append(m[1].strip())
            granted.append(value)
            names.update(ids)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": sorted(base), "licences": sorted(names), "expressions": expressions, "score": min(granted, default=0.0),
    }


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, licences, expressions, score.

    ``score``: how freely the text may be used by all that was found in it, 0 where nothing was.
    """
    kind = docs.schema[key].dataType.simpleString()
    known = NOTICES if notices is None else notices
    schema = f"k {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, licences array<string>, expressions array<string>, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(known)
        strings, types = pa.list_(pa.string()), {"score": pa.float64()}
        for b in slices(batches, "_text"):
            rows = [scan(t, find, known) for t in b.column(1).to_pylist()]
            names = list(rows[0])
            arrays = [pa.array([r[n] for r in rows], types.get(n, strings if n in ("base_labels", "licences", "expressions") else pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["k", *names])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("_text")).mapInArrow(run, schema).withColumnRenamed("k", key)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    own = F.transform("licences", lambda x: F.concat(F.lit("licence:"), x))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", own))), ",").alias("labels"), "score",
    )
