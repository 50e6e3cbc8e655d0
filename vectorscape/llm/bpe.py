"""Operator 2: byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved until the pieces are short; the pieces are encoded alone, and
neighbours are joined. A join re-encodes a window around the seam that grows on
both sides until each of its edges is a place where the splitting pattern has a
boundary whatever stands around it: no alternative of the pattern matches past
the point where a non-blank is followed by white space (white space begins an
alternative or fills it, never ends one that began with something else). Tokens
outside of two such edges can't depend on the text beyond them, so they stand.
If a side has no such edge, the window takes all of that side. Decoding
concatenates the bytes of the halves up the same tree.

Rows: a null text is the empty text; an empty text has no tokens. Repeated rows
are encoded one by one. Input columns other than the key and the text are not
read, whatever their names. The rank file is read from ``ranks`` by each task.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.llm.shared import slices, table

#: Code points of a leaf of the tree, and of the first window on each side of a seam.
LEAF, WINDOW = 512, 64
#: A pattern boundary that holds in every context: a non-blank, then white space. Blanks here are those
#: on which Python's and the pattern's classes agree, so that an edge is never a false one.
EDGE = re.compile(r"[^\s\x1c-\x1f\x85](?=[ \t\n\r])")


@functools.cache
def codec(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=table_, special_tokens={})


@functools.cache
def token_sizes(ranks: str, pattern: str) -> list[int]:
    enc = codec(ranks, pattern)
    return [len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)]


class Tree:
    """The reduction for one rank file."""

    def __init__(self, ranks: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, window: int = WINDOW):
        self.enc, self.sizes = codec(ranks, pattern), token_sizes(ranks, pattern)
        self.leaf, self.window = max(1, leaf), max(1, window)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.enc.encode_ordinary(text)
        mid = len(text) // 2
        return self.join(text[:mid], self.encode(text[:mid]), text[mid:], self.encode(text[mid:]))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The ids of ``left + right`` from those of both."""
        a, b = self.last_edge(left), self.first_edge(right)
        keep = self.count_until(reversed(left_ids), len(left[a:].encode()))
        drop = self.count_until(right_ids, len(right[:b].encode()))
        return left_ids[: len(left_ids) - keep] + self.enc.encode_ordinary(left[a:] + right[:b]) + right_ids[drop:]

    def last_edge(self, text: str) -> int:
        size = self.window
        while size < len(text):
            found = [m.end() for m in EDGE.finditer(text, len(text) - size)]
            if found:
                return found[-1]
            size *= 2
        return 0

    def first_edge(self, text: str) -> int:
        size = self.window
        while size < len(text):
            if found := EDGE.search(text, 0, size):
                return found.end()
            size *= 2
        return len(text)

    def count_until(self, ids, n_bytes: int) -> int:
        """How many of ``ids`` make up just ``n_bytes``; at an edge there is always such a number."""
        count = 0
        for i in ids:
            if n_bytes <= 0:
                break
            n_bytes -= self.sizes[i]
            count += 1
        return count

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.enc.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, ids array<int>): the token ids of every whole text."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(ranks, pattern)
        for b in slices(batches, "_text"):
            ids = [tree.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("_text")).mapInArrow(run, f"k {kind.simpleString()}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, bytes binary): the inverse of ``encode``; null ids are none."""
    kind = encoded.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(ranks, pattern)
        for b in batches:
            out = [tree.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["k", "bytes"])

    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind.simpleString()}, bytes binary").withColumnRenamed("k", key)


def encode_digests(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that ids don't travel."""
    kind = docs.schema[key].dataType
    schema = f"k {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(ranks, pattern)
        names = [str(i) for i in range(tree.enc.n_vocab)]
        for b in slices(batches, "_text"):
            n, coded, decoded = [], [], []
            for t in b.column(1).to_pylist():
                ids = tree.encode(t or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("_text")).mapInArrow(run, schema).withColumnRenamed("k", key)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
