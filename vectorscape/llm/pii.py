"""Operator 5: personal data, with information-theoretic sanitisation.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers.
Then the corpus says which terms give an entity away although no pattern knows them. A
term is a word within ``reach`` words of an entity. With n(t) its occurrences in the
whole corpus and n(e, t) those in reach of entity e, the term reveals e to the degree

    PMI(e; t) / IC(e) = 1 + log2 p(e|t) / IC(e),   p(e|t) = n(e, t) / (n(t) + prior),   IC(e) = -log2 (n(e) / N).

``prior`` shrinks p(e|t): it stands for occurrences elsewhere that the corpus doesn't
show. A term that is seen only beside e nears degree 1 as it is seen more often, and one
sight is evidence where e is rare enough: with a prior of 1 it has p = 1/2, which is
degree 0.9 from IC(e) = 10 on. All counts take each different text once, and both counts of
a term each different context of an entity once, so copies change nothing. An occurrence in
reach of several mentions of an entity is one. Terms from ``generalise_at`` on are generalised in reach of their entity, terms from
``remove_at`` on removed. All counts cover the whole corpus. Terms are counted in a second scan: texts that
aren't copies are counted where they are read, copies send the counts of one text each.

Base spans are the leftmost, non-overlapping matches of each kind; positions are code
points, ends exclusive. Spans of different kinds may overlap and all are listed.

Rows: a null text is empty, an empty text has no spans. Rows with tied or repeated keys
are each scanned; ``sanitise`` keeps all columns but its own, by position, whatever they
are called. An empty table has no entities and no terms.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.llm.shared import ALNUM_BYTES, discard, materialise, slices, table, utf8, words

# Kinds in the contract's order, then the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
REACH, PRIOR = 8, 1.0
GENERALISE_AT, REMOVE_AT = 0.9, 0.97
MIN_TERM = 3
#: Terms that may be sent to every task, about 16 MB; more are joined.
SEND_TERMS = 1_000_000

_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that doesn't match from its first digit doesn't match from a later one.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _AFTER_AT.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """One spelling for all spellings of an entity."""
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else value if kind == 1 else only_digits(value)}"


def near_words(text: str, start: int, end: int, reach: int) -> list[tuple[int, int]]:
    """Spans of up to ``reach`` whole words on each side of a span."""
    if reach < 1:
        return []
    size = 32 * reach
    while True:  # backwards, in growing windows that begin at a word's edge
        low = max(0, start - size)
        before = [m.span() for m in _WORD.finditer(text, low, start)]
        if low == 0 or len(before) > reach:
            break
        size *= 2
    after = []
    for m in _WORD.finditer(text, end):
        if len(after) == reach:
            break
        after.append(m.span())
    return [(s, e) for s, e in before[-reach:] + after]


def hashes_of(values: list[str]) -> np.ndarray:
    """The hashes that ``words`` gives to lower-cased words."""
    data, offsets = utf8(pa.array([v.encode("utf-8", "surrogatepass") for v in values], pa.binary()))
    return words(data, offsets)[2].view(np.int64)


_FOUND = "array<struct<start: int, kind: int, end: int, entity: bigint>>"
_NEAR = "array<struct<entity: bigint, context: bigint, term: bigint, start: int, end: int>>"
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("entity", pa.int64())]))
_NEAR_TYPE = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))


def overlaps(spans: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch of text overlaps one of ``spans``, which are sorted by start."""
    starts = [s for s, _, _ in spans]
    ends = list(accumulate((e for _, _, e in spans), max))  # the furthest end so far

    def inside(start: int, end: int) -> bool:
        k = bisect_left(starts, end)  # the spans that begin before the end
        return k > 0 and ends[k - 1] > start

    return inside


def scan_batch(texts: list[str | None], reach: int) -> tuple[list[list[dict]], list[list[dict]]]:
    """Base spans of each text, and the terms in reach of them."""
    found, near = [], []
    pending: list[tuple[dict, str]] = []
    for t in texts:
        t = t or ""
        spans = base_spans(t)
        inside = overlaps(spans)
        mine = [{"start": s, "kind": k, "end": e, "entity": stable(entity(k, t[s:e]))} for s, k, e in spans]
        terms, seen = [], set()
        for x in mine:
            around = near_words(t, x["start"], x["end"], reach)
            context = stable(" ".join(t[s:e] for s, e in around))
            for s, e in around:
                if e - s >= MIN_TERM and (x["entity"], s) not in seen and not inside(s, e):
                    seen.add((x["entity"], s))
                    terms.append({"entity": x["entity"], "context": context, "term": 0, "start": s, "end": e})
                    pending.append((terms[-1], t[s:e]))
        found.append(mine)
        near.append(terms)
    for (row, _), h in zip(pending, hashes_of([w for _, w in pending]).tolist()):
        row["term"] = h
    return found, near


def stable(value: str) -> int:
    """A 64-bit hash that all processes agree on."""
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def text_name(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def find_base(docs: DataFrame, key: str, text: str, reach: int) -> DataFrame:
    """(key, text_name, n_words, found, near) of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            found, near = scan_batch(b.column(1).to_pylist(), reach)
            data, offsets = utf8(b.column(1))
            raw = [data[s:e].tobytes() for s, e in zip(offsets.tolist(), offsets[1:].tolist())]
            n_words = [len(t.translate(ALNUM_BYTES).split()) for t in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(text_name, raw), pa.binary()), pa.array(n_words, pa.int64()), pa.array(found, _FOUND_TYPE), pa.array(near, _NEAR_TYPE)], ["k", "text_name", "n_words", "found", "near"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("_text")).mapInArrow(run, f"k {kind}, text_name binary, n_words bigint, found {_FOUND}, near {_NEAR}").withColumnRenamed("k", key)


#: Bits of the filter that says which texts may be copies: 8 MB, whatever the input. What it lets through too often is only counted another way.
FILTER_BITS = 1 << 26


def filter_of(names: DataFrame) -> np.ndarray:
    """A bit map of the names of texts (text_name), merged in the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = bits_of(b.column(0).to_pylist())
                word, at = np.unique(h >> 6, return_inverse=True)
                bits = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bits, at, np.uint64(1) << (h & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = names.select("text_name").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def bits_of(names: list[bytes]) -> np.ndarray:
    return (np.frombuffer(b"".join(n[:8] for n in names), np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)


def count_terms(docs: DataFrame, base: DataFrame, text: str, terms: DataFrame, send: int) -> DataFrame:
    """(term, n): how often each of ``terms`` stands in the different texts of the corpus."""
    context = docs.sparkSession.sparkContext
    wanted = context.broadcast(np.sort(terms.toArrow().column("term").to_numpy())) if terms.count() <= send else None
    copied = context.broadcast(filter_of(base.groupBy("text_name").count().filter("count > 1")))

    def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if wanted is not None:
            all_ = wanted.value
            at = np.minimum(np.searchsorted(all_, h), max(0, len(all_) - 1))
            h = h[all_[at] == h] if len(all_) else h[:0]
        term, n = np.unique(h, return_counts=True)
        return term, n.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            data, offsets = utf8(b.column(0))
            _, _, h, first = words(data, offsets)
            h = h.view(np.int64)
            names = [text_name(data[s:e].tobytes()) for s, e in zip(offsets.tolist(), offsets[1:].tolist())]
            bit = bits_of(names)
            copy = (copied.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out = [(names[i], *counted(h[first[i] : first[i + 1]])) for i in np.flatnonzero(copy).tolist()]
            out.append((None, *counted(h[~np.repeat(copy, np.diff(first))])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), *(pa.array([o[k].tobytes() for o in out], pa.binary()) for k in (1, 2))], ["text_name", "terms", "counts"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                term, n = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.int64) for k in (0, 1))
                term, at = np.unique(term, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.bincount(at, n, len(term)).astype(np.int64))], ["term", "n"])

    packed = materialise(docs.select(F.col(text).alias("_text")).mapInArrow(run, "text_name binary, terms binary, counts binary"), "counts")
    once = packed.filter("text_name is not null").groupBy("text_name").agg(F.first(F.struct("terms", "counts")).alias("x")).select("x.*")
    counts = packed.filter("text_name is null").select("terms", "counts").unionByName(once).mapInArrow(unpacked, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = materialise(counts if wanted is not None else counts.join(terms, "term", "left_semi"), "term-counts")
    discard(packed)
    return out


def disclosures(docs: DataFrame, base: DataFrame, text: str = "text", prior: float = PRIOR, generalise_at: float = GENERALISE_AT, send: int = SEND_TERMS) -> DataFrame:
    """(entity, term, degree), written out, of the terms that reveal an entity; ``base`` is what ``find_base`` found."""
    texts = materialise(base.groupBy("text_name").agg(*(F.first(c).alias(c) for c in ("n_words", "found", "near"))), "texts")
    near = texts.select(F.explode("near").alias("x")).select("x.entity", "x.context", "x.term").groupBy("entity", "context", "term").agg(F.count("*").alias("again"))
    pairs = materialise(near.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.sum("again").alias("again")), "pairs")
    total = texts.agg(F.sum("n_words")).first()[0] or 0
    terms = materialise(pairs.select("term").distinct(), "near-terms")
    counts = count_terms(docs, base, text, terms, send)
    mentions = texts.select(F.explode("found").alias("x")).groupBy("x.entity").agg(F.count("*").alias("n_entity"))
    both = pairs.join(counts, "term").join(mentions, "entity")
    content = -F.log2(F.least(F.lit(0.5), F.col("n_entity") / F.lit(float(max(total, 1)))))
    n = F.col("n") - F.col("again") + F.col("n_both")  # contexts of the entity once, all else as it stands
    degree = 1 + F.log2(F.least(F.lit(1.0), F.col("n_both") / (n + F.lit(float(prior))))) / content
    out = materialise(both.select("entity", "term", degree.alias("degree")).filter(F.col("degree") >= generalise_at), "terms")
    discard(texts, pairs, terms, counts)
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH, prior: float = PRIOR, generalise_at: float = GENERALISE_AT, send: int = SEND_TERMS) -> DataFrame:
    """(key, spans array<struct<start, kind, end, degree>>) of every document, by start, then kind.

    ``kind`` counts in ``KINDS``; the degree of a base span is 1.
    """
    base = materialise(find_base(docs, key, text, reach).withColumn("_row", F.monotonically_increasing_id()), "pii")
    revealed = disclosures(docs, base, text, prior, generalise_at, send)
    mine = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(1.0).alias("degree")))
    rows = base.select(key, "_row", mine.alias("spans"), "near")
    n = revealed.count()
    if n == 0:
        return rows.select(key, F.array_sort("spans").alias("spans"))
    revealed = F.broadcast(revealed) if n <= send // 8 else revealed
    near = rows.select("_row", F.explode("near").alias("x")).select("_row", "x.*").join(revealed, ["entity", "term"])
    near = near.groupBy("_row", "start", "end").agg(F.max("degree").alias("degree"))
    near = near.groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "degree")).alias("terms"))
    out = rows.select(key, "_row", "spans").join(near, "_row", "left")
    return out.select(key, F.array_sort(F.concat("spans", F.coalesce("terms", F.expr("cast(array() as array<struct<start: int, kind: int, end: int, degree: double>>)")))).alias("spans"))


def replaced(text: str | None, spans: list[tuple[int, int, int, float]], remove_at: float) -> str | None:
    """The text with its spans generalised to their kind or removed; of overlapping spans the first wins."""
    if text is None or not spans:
        return text
    out, done = [], 0
    for start, kind, end, degree in sorted(spans):
        if start < done:
            done = max(done, end)
            continue
        out.append(text[done:start])
        out.append("" if kind == 4 and degree >= remove_at else f"<{KINDS[kind].upper()}>")
        done = end
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH, prior: float = PRIOR, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, send: int = SEND_TERMS) -> DataFrame:
    """``docs``, all columns and rows, with personal data and revealing terms taken out of the text.

    The texts are scanned again rather than shuffled, as long as the list of disclosures is at most ``send`` long.
    """
    base = materialise(find_base(docs, key, text, reach), "pii")
    revealed = disclosures(docs, base, text, prior, generalise_at, send)
    discard(base)
    if (n := revealed.count()) > send:
        return sanitise_joined(docs, text, reach, prior, generalise_at, remove_at, send)
    given = docs.sparkSession.sparkContext.broadcast([revealed.toArrow().column(c).to_numpy() for c in ("entity", "term", "degree")]) if n else None  # at most 24 bytes for each of ``send``
    discard(revealed)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        degree = {}
        if given is not None:
            entities, terms, degrees = (c.tolist() for c in given.value)
            degree = dict(zip(zip(entities, terms), degrees))
        for b in batches:
            for s in slices(iter([b]), b.schema.names[at]):
                texts = s.column(at).to_pylist()
                found, near = scan_batch(texts, reach if degree else 0)
                out = []
                for t, f, m in zip(texts, found, near):
                    spans = [(x["start"], x["kind"], x["end"], 1.0) for x in f]
                    spans += [(x["start"], 4, x["end"], degree[x["entity"], x["term"]]) for x in m if (x["entity"], x["term"]) in degree]
                    out.append(replaced(t, spans, remove_at))
                columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(s.columns)]
                yield pa.RecordBatch.from_arrays(columns, s.schema.names)

    return docs.mapInArrow(run, docs.schema)


def sanitise_joined(docs: DataFrame, text: str, reach: int, prior: float, generalise_at: float, remove_at: float, send: int) -> DataFrame:
    """``sanitise`` for any number of disclosures; rows are numbered and written out, and spans meet their texts by those numbers."""
    numbered = materialise(docs.select(F.struct("*").alias("doc"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_id")), "rows")
    spans = find(numbered, "_id", "_text", reach, prior, generalise_at, send).select("_id", F.col("spans").alias("_spans"))
    both = numbered.join(spans, "_id", "left").select("doc.*", "_spans")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())
            out = [replaced(t, [(x["start"], x["kind"], x["end"], x["degree"]) for x in s or []], remove_at) for t, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(b.columns[:-1])], b.schema.names[:-1])

    return both.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(4)), F.sha2(joined(F.filter("spans", lambda x: x["kind"] < 4)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
