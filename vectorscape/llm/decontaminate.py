"""Operator 9: benchmark decontamination with suffix arrays of the training text.

Each slice of training documents is a shard with a suffix array over its words.
The array is sparse: it leaves out suffixes that can't reach any test window,
those with a word pair that no benchmark item has before the shortest window's
end; a match of w words needs all of its w - 1 pairs, so none is lost. Its suffixes
are ordered by their first ``size`` words, which is all that a window can ask for.
Every test suffix is looked for by binary search; the range that it finds holds all verbatim
matches and their places. Matches on one diagonal of an item and a document are put
together to the longest match. A last check compares the words' bytes, so that a hash
can't add a match.

Windows have ``size`` consecutive words of an item; an item of fewer words is one
window. The benchmark is the stated query set: it is taken in blocks of at most
``block_bytes`` of text, so what a task receives is bounded whatever its size.

Rows: a null or wordless text has no words, is never hit and is no window. Tied
and repeated items each count; repeated documents are judged one by one. An empty
benchmark leaves all documents clean. Columns other than keys and texts are kept
by ``remove`` and otherwise not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.llm.shared import ALNUM_BYTES, discard, materialise, slices, table, utf8, words

SIZE = 10
#: Benchmark text that one pass carries to the tasks.
BLOCK_BYTES = 32 << 20
_BITS = 22


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_BYTES).split()


def pair_hashes(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]
        return x ^ (x >> np.uint64(29))


class Needles:
    """The windows of one block of the benchmark, ready for the search."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        self.size = size
        self.owners: dict[tuple[bytes, ...], list[tuple[object, int]]] = defaultdict(list)
        texts = []
        for item, text in items:
            w = word_list(text)
            for k in range(max(1, len(w) - size + 1) if w else 0):
                self.owners[tuple(w[k : k + size])].append((item, k))
            texts.append(" ".join(x.decode("utf-8", "surrogatepass") for x in w))
        data, offsets = utf8(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()))
        starts, ends, h, first = words(data, offsets)
        self.vocabulary = np.unique(h)
        spelled = {bytes(data[s:e]): x for s, e, x in zip(starts.tolist(), ends.tolist(), h.tolist())}
        same = np.repeat(np.arange(len(items)), np.diff(first))
        self.pairs = np.unique(pair_hashes(h)[same[1:] == same[:-1]]) if len(h) > 1 else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.pairs >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.windows = sorted(self.owners)
        self.shortest = min(map(len, self.windows), default=size)
        ids = {w: int(np.searchsorted(self.vocabulary, np.uint64(x))) + 1 for w, x in spelled.items()}
        low = np.zeros((len(self.windows), size), ">u4")
        high = np.full((len(self.windows), size), 0xFFFFFFFF, ">u4")
        for r, w in enumerate(self.windows):
            low[r, : len(w)] = high[r, : len(w)] = [ids[x] for x in w]
        self.low, self.high = as_keys(low), as_keys(high)
        self.singles = np.array(sorted(spelled[w[0]] for w in self.windows if len(w) == 1), np.uint64)

    def reach(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each word: how many words from it on may match, going by pairs. ``last``: it ends its row."""
        good = np.zeros(len(h), bool)
        if len(h) > 1 and len(self.pairs):
            g = pair_hashes(h)
            at = np.flatnonzero(self.seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)] & ~last[:-1])
            at = at[self.pairs[np.minimum(np.searchsorted(self.pairs, g[at]), len(self.pairs) - 1)] == g[at]]
            good[at] = True
        stops = np.flatnonzero(~good)
        reach = np.zeros(len(h), np.int64)
        at = np.flatnonzero(good)
        reach[at] = stops[np.searchsorted(stops, at)] - at + 1
        if self.shortest <= 1:
            at = np.isin(h, self.singles)
            reach[at] = np.maximum(reach[at], 1)
        return reach


def as_keys(ids: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(ids).view(f"S{4 * ids.shape[1]}").ravel()


def search(data: np.ndarray, offsets: np.ndarray, needles: Needles) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The shard's number of words by row, and (place of the first word in its row's shard, window) of all matches."""
    starts, ends, h, first = words(data, offsets)
    n = len(h)
    if n == 0 or not needles.windows:
        return first, []
    last = np.zeros(n, bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    reach = np.minimum(needles.reach(h, last), np.repeat(first[1:], np.diff(first)) - np.arange(n))  # to the row's end at most
    suffixes = np.flatnonzero(reach >= needles.shortest)
    if len(suffixes) == 0:
        return first, []
    ids = np.zeros((len(suffixes), needles.size), ">u4")
    for k in range(needles.size):
        on = np.flatnonzero(reach[suffixes] > k)
        x = h[suffixes[on] + k]
        at = np.minimum(np.searchsorted(needles.vocabulary, x), len(needles.vocabulary) - 1)
        ids[on, k] = np.where(needles.vocabulary[at] == x, at + 1, 0)
    keys = as_keys(ids)
    order = np.argsort(keys, kind="stable")  # the shard's suffix array
    keys, suffixes = keys[order], suffixes[order]
    low, high = np.searchsorted(keys, needles.low, "left"), np.searchsorted(keys, needles.high, "right")
    found = []
    for w in np.flatnonzero(high > low).tolist():
        window = needles.windows[w]
        for at in suffixes[low[w] : high[w]].tolist():
            if all(bytes(data[starts[at + k] : ends[at + k]]).translate(ALNUM_BYTES) == x for k, x in enumerate(window)):
                found.append((at, w))
    return first, found


def matches(docs: DataFrame, items: list[tuple[object, str | None]], key: str = "doc_id", text: str = "text", item_type: str = "bigint", size: int = SIZE) -> DataFrame:
    """(key, n_words, hit array<int>, spans array<struct<item, start, n_words>>) of one block of items.

    ``hit``: the document's words inside any window, from 0. ``spans``: its longest matches.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(items)  # at most block_bytes
    schema = f"k {kind}, n_words bigint, hit array<int>, spans array<struct<item: {item_type}, start: int, n_words: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles = None
        for b in slices(batches, "_text"):
            needles = needles or Needles(given.value, size)
            data, offsets = utf8(b.column(1))
            first, found = search(data, offsets, needles)
            hit: dict[int, set[int]] = defaultdict(set)
            runs: dict[int, dict[tuple[object, int], set[int]]] = defaultdict(lambda: defaultdict(set))
            rows = np.searchsorted(first, [at for at, _ in found], side="right") - 1
            for row, (at, w) in zip(rows.tolist(), found):
                at -= int(first[row])
                window = needles.windows[w]
                hit[row].update(range(at, at + len(window)))
                for item, k in needles.owners[window]:
                    runs[row][item, at - k].update(range(at, at + len(window)))
            spans = [[] for _ in range(b.num_rows)]
            for row, of in runs.items():
                for (item, _), places in of.items():
                    p = sorted(places)
                    cuts = [0, *(i for i in range(1, len(p)) if p[i] != p[i - 1] + 1), len(p)]
                    spans[row] += [{"item": item, "start": p[i], "n_words": j - i} for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(first)), pa.array([sorted(hit.get(i, ())) for i in range(b.num_rows)], pa.list_(pa.int32())), pa.array(spans, out_type)],
                ["k", "n_words", "hit", "spans"],
            )

    out_type = pa.list_(pa.struct([("item", pa.string() if item_type == "string" else pa.int64()), ("start", pa.int32()), ("n_words", pa.int32())]))
    return docs.select(F.col(key).alias("k"), F.col(text).alias("_text")).mapInArrow(run, schema).withColumnRenamed("k", key)


def blocks_of(benchmark: DataFrame, item: str, item_text: str, block_bytes: int) -> tuple[list[DataFrame], str]:
    """The benchmark in blocks (i, t) of about half of ``block_bytes`` of text each, and the type of its ids."""
    bench = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(total // max(1, block_bytes // 2)) + 1
    kind = "string" if bench.schema["i"].dataType.simpleString() == "string" else "bigint"
    return [bench if n == 1 else bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)], kind


def items_of(block: DataFrame) -> list[tuple[object, str | None]]:
    return [(r.i, r.t) for r in block.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, n_hit, items, spans, contaminated) of every document.

    ``items``: the distinct items with occurring windows, sorted as strings. With more than one block, each
    block is a pass over the documents. The rows are numbered and written out first, and the passes meet by
    those numbers, so null and repeated keys stay rows of their own.
    """
    blocks, kind = blocks_of(benchmark, item, item_text, block_bytes)
    if len(blocks) == 1:
        out = matches(docs, items_of(blocks[0]), key, text, kind, size)
    else:
        rows = docs.select(F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row")).alias("_id"), F.col(text).alias("_t"))
        rows = materialise(rows, "rows")
        out = None
        for b in blocks:  # one after another, so that one block is in memory
            found = matches(rows, items_of(b), "_id", "_t", kind, size)
            part = materialise(found if out is None else found.filter(F.size("hit") > 0), "matches")
            out = part if out is None else out.unionByName(part)
        discard(rows)
        out = out.groupBy("_id").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.flatten(F.collect_list("spans")).alias("spans"))
        out = out.withColumn(key, F.col("_id.key"))
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"].cast("string"))))
    return out.select(key, "n_words", F.size("hit").cast("long").alias("n_hit"), items.alias("items"), "spans", (F.size("hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark window.

    Each row is judged where it stands and keys are not read. Between blocks the rows that are left are
    written out, so a task holds the windows of one block at a time.
    """
    blocks, _ = blocks_of(benchmark, item, item_text, block_bytes)
    at, left = docs.columns.index(text), docs
    for i, block in enumerate(blocks):
        before, left = left, without(left, items_of(block), at, size)
        if i < len(blocks) - 1:
            left = materialise(left, "clean")
        if i and i < len(blocks) - 1:
            discard(before)
    return left


def without(docs: DataFrame, items: list[tuple[object, str | None]], at: int, size: int) -> DataFrame:
    """``docs`` without the rows whose text, column number ``at``, holds a window of ``items``."""
    given = docs.sparkSession.sparkContext.broadcast(items)  # at most block_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles = None
        for b in batches:
            for s in slices(iter([b]), b.schema.names[at]):
                needles = needles or Needles(given.value, size)
                first, found = search(*utf8(s.column(at)), needles)
                keep = np.ones(s.num_rows, bool)
                keep[np.searchsorted(first, [x for x, _ in found], side="right") - 1] = False
                yield s.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS.format("text")}, []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
  SELECT item_id, w[k : k + 9] AS win FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS u(k) WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) AS u(k)),
hits AS (SELECT dw.doc_id, dw.k, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
