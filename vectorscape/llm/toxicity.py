"""Operator 6: toxicity by fuzzy lexicon matching with context windows.

The lexicon is a trie learned from labelled rows: a node is an entry if documents that
hold a word through it are toxic and it was seen between ``support`` different pairs of
neighbouring words (so a text's copies count once). It must stand in a share of the toxic
rows, or be so precise that chance can't explain it, however few rows hold it. A node whose words go on in many
ways is a stem and accepts any ending; else it is a whole word. A Levenshtein automaton
of each text word, bit-parallel, is intersected with the trie: one walk finds all
entries within the distance that an entry's length allows, so misspelled and disguised
terms are caught. Hits are classed by entry, distance and two context windows: whether
the characters around them show a quotation, and how many hits the words around them
hold, as abuse comes in clusters and an ordinary word that looks like a term doesn't.
Each class has the precision that it had over the labelled rows, shrunk to a prior (an
unseen misspelling counts as abuse, unseen quotation doesn't). A document's score is
that of its gravest hit.

``sample``: at most so many labelled rows are learned from, those whose keys have the
smallest hashes; they are written out once. Scoring reads whole texts of all documents;
labels, languages, sources and keys are no inputs.

Rows: a key with several texts teaches by the least of them; null and empty texts have no hits and get the score of documents without hits;
without any labels of a kind the lexicon is empty. Keys with several label rows are
toxic if one of them is; null labels teach nothing. Repeated documents score alike.
``reject`` keeps all columns of what it keeps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.llm.shared import ALNUM_BYTES, LOWER, discard, materialise, slices, table, utf8, words

#: Labelled rows that are learned from.
SAMPLE = 20_000
#: An entry needs so many contexts, this share of the clean rows at most, and this precision: as counted with this share of
#: the toxic rows, or below that share with both counts so many standard errors worse.
SUPPORT, SHARE, COMMON, MIN_PRECISION, ERRORS = 6, 0.03, 0.04, 0.8, 5.0
SHORTEST, LONGEST = 3, 16
#: Characters on each side of a hit in which quotation marks count, and words in which other hits do, up to CROWD.
CONTEXT, NEIGHBOURS, CROWD = 120, 100, 3
#: Beta priors (toxic, clean) of misspelled and of quoted hits; that of exact ones is what all entries show, worth so many rows.
MISSPELLED_PRIOR, QUOTED_PRIOR, POOLED_WEIGHT = (1.2, 1.0), (1.0, 2.0), 4.0
_CACHE = 300_000
#: Offsets in a word at which the sieve looks: no piece of an entry can stand further on.
_OFFSETS = 64 + 16
# Quotation marks that open or close, and those that do both.
_OPEN, _CLOSE, _BOTH = "“„«‹", "”»›", '"'


class Entry(NamedTuple):
    text: str
    stem: bool

    @property
    def distance(self) -> int:
        return (len(self.text) >= 5) + (len(self.text) >= 9)


class Node:
    __slots__ = ("entry", "most", "next")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.entry: Entry | None = None
        self.most = 0  # the greatest distance that an entry below allows


class Lexicon:
    """A trie of entries, intersected with the automaton of a word."""

    def __init__(self, entries: list[Entry]):
        self.root = Node()
        self.entries = entries
        self.most = max((e.distance for e in entries), default=0)
        for e in entries:
            node = self.root
            for c in e.text:
                node = node.next.setdefault(c, Node())
                node.most = max(node.most, e.distance)
            node.entry = e
        self._sieve = self._pieces()

    def _pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Which two and three bytes at which offset let a word match.

        Of distance + 1 pieces of an entry one is spelled right in any match, moved by the edits before it, of
        up to 4 bytes each; edits between pieces count for the right one, so the first piece doesn't move.
        """
        two, three = (np.zeros((_OFFSETS, 1 << 16), bool) for _ in range(2))
        for e in self.entries:
            n, k = len(e.text), e.distance + 1
            for j in range(k):
                piece = e.text[j * n // k : (j + 1) * n // k].encode()
                start = len(e.text[: j * n // k].encode())
                move = 4 * e.distance if j else 0
                for o in range(max(0, start - move), min(_OFFSETS, start + move + 1)):
                    if len(piece) >= 3:
                        three[o, (piece[0] | piece[1] << 8) * 40503 + piece[2] * 30011 & 0xFFFF] = True
                    else:
                        two[o, piece[0] | piece[1] << 8] = True
        return two, three

    def possible(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the words may match at all."""
        out = np.zeros(len(starts), bool)
        for o in range(_OFFSETS):
            two, three = (t[o] for t in self._sieve)
            at = np.flatnonzero(~out & (ends - starts > o + 1))
            if not (two.any() or three.any()) or len(at) == 0:
                continue
            p = starts[at] + o
            g = LOWER[data[p]].astype(np.int64) | LOWER[data[p + 1]].astype(np.int64) << 8
            q = np.minimum(p + 2, len(data) - 1)
            out[at] = two[g] | (three[g * 40503 + LOWER[data[q]].astype(np.int64) * 30011 & 0xFFFF] & (ends[at] - starts[at] > o + 2))
        return out

    def match(self, word: str) -> list[tuple[Entry, int]]:
        """Entries within their distance of ``word``, and the distances.

        Bit i of level e: the walk so far equals the word's first i characters but for e edits.
        """
        if not self.entries or len(word) < 2:
            return []
        mask: dict[str, int] = {}
        for i, c in enumerate(word[: LONGEST + 4]):
            mask[c] = mask.get(c, 0) | 1 << i
        n = len(word)
        full = (1 << (min(n, LONGEST + 4) + 1)) - 1
        found: list[tuple[Entry, int]] = []
        stack = [(self.root, tuple((2 << e) - 1 & full for e in range(self.most + 1)))]
        while stack:
            node, state = stack.pop()
            for c, child in node.next.items():
                m = mask.get(c, 0)
                new = [(state[0] & m) << 1]
                for e in range(1, child.most + 1):
                    new.append(((state[e] & m) << 1 | state[e - 1] | state[e - 1] << 1 | new[-1] << 1) & full)
                if not new[-1]:
                    continue
                entry = child.entry
                if entry is not None:
                    for e in range(entry.distance + 1):
                        if new[e] if entry.stem else new[e] >> n & 1 and n <= LONGEST + 4:
                            found.append((entry, e))
                            break
                if child.next:
                    stack.append((child, tuple(new)))
        return found


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit shows it between an opening and a closing quotation mark, on its own line."""
    before, after = text[max(0, start - CONTEXT) : start].rpartition("\n")[2], text[end : end + CONTEXT].partition("\n")[0]
    opened = before.count(_BOTH[0]) % 2 == 1 or any(before.rfind(a) > max(before.rfind(z) for z in _CLOSE) for a in _OPEN)
    return opened and any(c in after for c in _BOTH + _CLOSE)


class Class(NamedTuple):
    """What is known of a hit: the entry, its distance, whether it is quoted, and the hits around it, itself included."""

    entry: str
    distance: int
    quoted: bool
    crowd: int


NOTHING = Class("", 0, False, 0)


def within(places: np.ndarray, first: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """How many of ``hits`` stand up to NEIGHBOURS words from each place, in the same row."""
    low, high = np.maximum(places - NEIGHBOURS, first[rows]), np.minimum(places + NEIGHBOURS, first[rows + 1] - 1)
    return np.searchsorted(hits, high, side="right") - np.searchsorted(hits, low, side="left")


class Scanner:
    """Finds the hits of texts, with a bounded memory of words seen before."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[int, tuple[tuple[str, int], ...]] = {}

    def classes(self, batch: pa.Array) -> list[set[Class]]:
        """For each text, its classes of hits."""
        out: list[set[Class]] = [set() for _ in range(len(batch))]
        data, offsets = utf8(batch)
        starts, ends, hashes, first = words(data, offsets)
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        hot = np.zeros(len(unique), bool)
        if len(self.known) > _CACHE:
            self.known.clear()
        meaning: dict[int, tuple[tuple[str, int], ...]] = {}
        likely = np.flatnonzero(self.lexicon.possible(data, starts[at], ends[at]))
        for k, h in zip(likely.tolist(), unique[likely].tolist()):
            hits = self.known.get(h)
            if hits is None:
                w = bytes(data[starts[at[k]] : ends[at[k]]]).translate(ALNUM_BYTES).decode("utf-8", "replace")
                hits = tuple((e.text, d) for e, d in self.lexicon.match(w))
                self.known[h] = hits
            if hits:
                hot[k] = True
                meaning[k] = hits
        places = np.flatnonzero(hot[inverse]) if len(unique) else np.zeros(0, np.int64)
        rows = np.searchsorted(first, places, side="right") - 1
        exact = np.array([any(d == 0 for _, d in meaning[k]) for k in inverse[places].tolist()], bool)
        crowds = [np.minimum(CROWD, within(places, first, rows, every)) for every in (places[exact], places)]
        for n, (place, row) in enumerate(zip(places.tolist(), rows.tolist())):
            low, high = max(int(offsets[row]), int(starts[place]) - 4 * CONTEXT), min(int(offsets[row + 1]), int(ends[place]) + 4 * CONTEXT)
            left = bytes(data[low : starts[place]]).decode("utf-8", "ignore")
            hit = bytes(data[starts[place] : ends[place]]).decode("utf-8", "replace")
            around = left + hit + bytes(data[ends[place] : high]).decode("utf-8", "ignore")
            said = quoted(around, len(left), len(left) + len(hit))
            out[row].update(Class(e, d, said, int(crowds[d > 0][n])) for e, d in meaning[int(inverse[place])])
        return out


class Model(NamedTuple):
    """The lexicon, the odds of the classes of hits, and the score where there is none."""

    entries: list[Entry]
    seen: dict[Class, tuple[int, int]]
    none: float

    def prior(self, c: Class) -> tuple[float, float]:
        if c.quoted:
            return QUOTED_PRIOR
        if c.distance:
            return MISSPELLED_PRIOR
        same = [v for k, v in self.seen.items() if not k.quoted and k.distance == 0 and k.crowd == c.crowd]
        toxic, clean = sum(t for t, _ in same) + 1.5, sum(n for _, n in same) + 0.5
        return POOLED_WEIGHT * toxic / (toxic + clean), POOLED_WEIGHT * clean / (toxic + clean)

    def score(self, classes: set[Class]) -> float:
        best = self.none
        for c in classes:
            toxic, clean = self.seen.get(c, (0, 0))
            a, b = self.prior(c)
            best = max(best, (toxic + a) / (toxic + clean + a + b))
        return best


def word_strings(text: str | None) -> list[str]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_BYTES).decode("utf-8", "replace").split(" ")


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """(_text, _toxic) of at most ``sample`` labelled keys, the least text of each; the broadcast side has no more rows than that."""
    picked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_toxic"))
    picked = picked.orderBy(F.xxhash64("_k"), "_k").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_key") == F.col("_k"))
    return materialise(rows.groupBy("_key").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"), F.first("_toxic").alias("_toxic")).select("_text", "_toxic"), "labelled")


def candidate_nodes(toxic: DataFrame, support: int) -> dict[str, tuple[int, int]]:
    """Trie nodes with their contexts in toxic rows, and the contexts in which they are whole words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for t in b.column(0).to_pylist():
                w = [x for x in word_strings(t) if x]
                for k, x in enumerate(w):
                    context = xxhash.xxh64_intdigest("\x00".join((w[k - 1] if k else "", x, w[k + 1] if k + 1 < len(w) else "")).encode()) >> 1
                    rows.update((x[:n], context, n == len(x)) for n in range(SHORTEST, min(len(x), LONGEST) + 1))
            node, context, whole = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(context, pa.int64()), pa.array(whole, pa.bool_())], ["node", "context", "whole"])

    seen = toxic.select("_text").mapInArrow(run, "node string, context bigint, whole boolean").distinct()
    nodes = seen.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.col("whole").cast("long")).alias("n_whole")).filter(F.col("n") >= support)
    return {r.node: (r.n, r.n_whole) for r in nodes.collect()}  # bounded by the sample


def document_counts(rows: DataFrame, nodes: set[str]) -> Counter:
    """In how many documents each node stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                count.update({x[:n] for x in set(word_strings(t)) for n in range(SHORTEST, min(len(x), LONGEST) + 1)} & nodes)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["node", "n"])

    counts = rows.select("_text").mapInArrow(run, "node string, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
    return Counter({r.node: r.n for r in counts.collect()})


def precision(toxic: int, clean: int, n_toxic: int, n_clean: int, errors: float = 0.0) -> float:
    """The precision among as many toxic as clean rows, with both counts ``errors`` standard errors worse."""
    low = max(0.0, toxic - errors * toxic**0.5) / max(1, n_toxic)
    high = (clean + 0.5 + errors * (clean + 0.5) ** 0.5) / max(1, n_clean)
    return low / (low + high)


def choose_entries(nodes: dict[str, tuple[int, int]], toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, min_precision: float) -> list[Entry]:
    """The topmost nodes of high precision, each taken down to where its words part."""
    children: dict[str, list[str]] = {}
    for x in nodes:
        children.setdefault(x[:-1], []).append(x)
    entries: list[Entry] = []
    for x in sorted(nodes, key=lambda x: (len(x), x)):
        if any(x.startswith(e.text) or e.text.startswith(x) for e in entries):
            continue
        frequent = toxic[x] >= max(2, SHARE * n_toxic) and nodes[x][0] >= int(SHARE * n_toxic)
        if clean[x] + 0.5 > COMMON * max(1, n_clean) or precision(toxic[x], clean[x], n_toxic, n_clean, 0.0 if frequent else ERRORS) < min_precision:
            continue
        node = x
        while len(down := [c for c in children.get(node, []) if nodes[c][0] >= 0.9 * nodes[node][0]]) == 1 and nodes[node][1] < 0.5 * nodes[node][0]:
            node = down[0]
        entries.append(Entry(node, nodes[node][1] < 0.5 * nodes[node][0]))
    return entries


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, support: int = SUPPORT, min_precision: float = MIN_PRECISION) -> Model:
    """Fit lexicon and class odds on at most ``sample`` rows of ``labels``; the documents are scanned once."""
    rows = training_rows(docs, labels, key, text, label, sample)
    sizes = {bool(r._toxic): r["count"] for r in rows.groupBy("_toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    toxic, clean = rows.filter("_toxic > 0"), rows.filter("_toxic <= 0")
    nodes = candidate_nodes(toxic, support)
    names = set(nodes)
    entries = choose_entries(nodes, document_counts(toxic, names), document_counts(clean, names), n_toxic, n_clean, min_precision) if nodes else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, count = Scanner(Lexicon(entries)), Counter()
        for b in slices(batches, "_text"):
            for classes, toxic_ in zip(scanner.classes(b.column(0)), b.column(1).to_pylist()):
                count.update((*c, toxic_ > 0) for c in classes or {NOTHING})
        keys = list(count)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_()))), pa.array([count[k] for k in keys], pa.int64())],
            [*Class._fields, "toxic", "n"],
        )

    counts = rows.mapInArrow(run, "entry string, distance int, quoted boolean, crowd int, toxic boolean, n bigint").groupBy(*Class._fields).agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("c")
    )
    seen = {Class(r.entry, r.distance, r.quoted, r.crowd): (r.t, r.c) for r in counts.collect()}  # at most 18 rows an entry
    discard(rows)
    t, c = seen.pop(NOTHING, (0, 0))
    return Model(entries, seen, min(0.49, (t + 0.5) / (t + c + 10)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, hits array<struct<entry, distance, quoted, crowd>>) of every document."""
    kind = docs.schema[key].dataType.simpleString()
    hits_type = pa.list_(pa.struct([("entry", pa.string()), ("distance", pa.int32()), ("quoted", pa.bool_()), ("crowd", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Lexicon(model.entries))
        for b in slices(batches, "_text"):
            found = scanner.classes(b.column(1))
            hits = [[h._asdict() for h in sorted(c)] for c in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(c) for c in found], pa.float64()), pa.array(hits, hits_type)], ["k", "score", "hits"])

    schema = f"k {kind}, score double, hits array<struct<entry: string, distance: int, quoted: boolean, crowd: int>>"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("_text")).mapInArrow(run, schema).withColumnRenamed("k", key)


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Lexicon(model.entries))
        for b in batches:
            for s in slices(iter([b]), b.schema.names[at]):
                yield s.filter(pa.array([model.score(c) < threshold for c in scanner.classes(s.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learning_rows(labels: DataFrame) -> DataFrame:
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, learn(docs, learning_rows(labels)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
