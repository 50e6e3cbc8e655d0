"""Operator 8: removal of repeated substrings by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere.
Suffixes of the whole corpus are never sorted. Each string of ``length`` bytes has an
anchor, the leftmost least of the hashes of its stretches of ``ANCHOR`` bytes, which
depends on the string alone; equal strings have equal anchors at equal places. Strings
with the same anchor start in one interval of the text, and the text from there to the
end of the last of them is the anchor's context. So:

1. equal contexts are counted; where one stands twice, all its strings do;
2. different contexts around equal anchors can share some strings. They are gathered,
   one copy of each, and suffixes from their intervals are sorted. In suffix order the
   nearest neighbours with a smaller and with a greater place in the corpus give the
   longest previous and next factors; a factor of ``length`` bytes or more is a repeat.

Anchors with more contexts than fit a group are split before they are sorted. A string
that starts l bytes before its anchor has l bytes to the left and length - l to the right
of the anchor's start. The range of l is cut into ``WAYS`` parts; what all strings of a
part have in common (its core) parts the group, so contexts that share a string of the
part stay together. Contexts whose whole extent in a part is equal are one from then on,
as they share all its strings. What is still too large is cut again; a part of one l has
a core that is its extent, so this ends. A context makes ``WAYS`` rows a round at most
for each part that it is still alive in, and never a row for each string.

With ``keep_first`` only later copies go and the first of each, by key, stays. Contexts that
stand alone around a unique anchor, nearly all, cost one row of 40 bytes.

Equal contexts and extents are told by 64-bit hashes of their bytes, taken together with
those of their anchors; strings of different ones are compared in suffix arrays by their
bytes.

Rows: a null text is empty; texts shorter than ``length`` lose nothing. Rows that repeat a
key and its text are one place for each; all rows come back. Null keys work as a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.llm.neardup import groups
from vectorscape.llm.shared import discard, join_hot, materialise, mix, slices, table, utf8

LENGTH, ANCHOR = 400, 128
#: Contexts in a group of suffix sorting, parts that a larger one is cut into, bytes of text whose suffixes are sorted at once, bytes of a broadcast.
GROUP, WAYS, SORT_BYTES, SEND_BYTES = 256, 4, 1 << 18, 4 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_POWERS: list[np.ndarray] = []


def both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, from 0, of the base and of its inverse; kept, as slices are of one size."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_B, _B_INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Polynomial hashes of any stretch of a byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.inverse = both_powers(n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            x = data.astype(np.uint64)
            x += np.uint64(1)
            x *= up[:n]
            np.cumsum(x, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours; len(x) - width + 1 of them."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, low, high, anchor hash, context hash) of all anchors: strings start in [low, high], places within the row."""
    n, width = len(data), length - anchor + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    rolling = Rolling(data)
    at = np.arange(n - anchor + 1)
    h = rolling.of(at, at + anchor)
    least = sliding_least((h & ~np.uint64((1 << 30) - 1)) | at.astype(np.uint64), width)
    place = (least & np.uint64((1 << 30) - 1)).astype(np.int64)  # of the anchor of the string that starts at each byte
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    valid = np.arange(len(place)) + length <= offsets[row + 1]
    starts = np.flatnonzero(valid)
    if len(starts) == 0:
        return none, none, none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (place[starts[1:]] != place[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
    low = starts[new]
    high = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    a = place[low]
    with np.errstate(over="ignore"):
        context = mix(rolling.of(low, high + length) + mix(((a - low).astype(np.uint64) << np.uint64(32)) + (high - low).astype(np.uint64)))
    r = row[low]
    return r, low - offsets[r], high - offsets[r], h[a].view(np.int64), context.view(np.int64)


def ranks(data: np.ndarray, depth: int) -> list[np.ndarray]:
    """Level k ranks all suffixes by their first 2 ** k bytes, for prefix doubling up to ``depth``; ends rank first."""
    out = [data.astype(np.int64) + 1]
    size = 1
    while 2 * size <= depth:
        r = out[-1]
        after = np.zeros(len(r), np.int64)
        after[: max(0, len(r) - size)] = r[size:]
        out.append(np.unique(r * (int(r.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1)
        size *= 2
    return out


def common(levels: list[np.ndarray], p: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes the suffixes at p and q share, ``depth`` at most."""
    got = np.zeros(len(p), np.int64)
    n = len(levels[0])
    for k in [len(levels) - 1, *range(len(levels) - 1, -1, -1)]:
        fits = np.maximum(p, q) + got + (1 << k) <= n
        i, j = np.where(fits, p + got, 0), np.where(fits, q + got, 0)
        got += np.where(fits & (levels[k][i] == levels[k][j]), 1 << k, 0)
    return np.minimum(got, depth)


def factors(data: np.ndarray, places: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and next factor of the suffixes at ``places``, up to ``depth`` bytes.

    ``order`` says where in the corpus each suffix stands. In suffix order the longest earlier match of a
    suffix is with the nearest before or after it that has a smaller place; the longest later one likewise.
    """
    levels = ranks(data, depth)
    top = len(levels) - 1
    rest = np.minimum(places + depth - (1 << top), len(data) - 1)
    sorted_ = np.lexsort((order, levels[top][rest], levels[top][places]))
    n = len(places)
    best = {}
    for name, key in (("previous", order[sorted_]), ("next", -order[sorted_])):
        before, after, stack = np.full(n, -1), np.full(n, -1), []
        values = key.tolist()
        for i, v in enumerate(values):  # nearest smaller values on both sides
            while stack and values[stack[-1]] > v:
                after[stack.pop()] = i
            if stack:
                before[i] = stack[-1]
            stack.append(i)
        longest = np.zeros(n, np.int64)
        for near in (before, after):
            on = np.flatnonzero(near >= 0)
            longest[on] = np.maximum(longest[on], common(levels, places[sorted_[on]], places[sorted_[near[on]]], depth))
        best[name] = np.zeros(n, np.int64)
        best[name][sorted_] = longest
    return best["previous"], best["next"]


def repeated_starts(contexts: list[bytes], widths: np.ndarray, first: list[tuple], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context, its starts with an earlier and with any other occurrence among the contexts.

    ``first``: where each context stands in the corpus first; strings start in the first ``widths`` bytes.
    """
    sizes = np.array(list(map(len, contexts)))
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    position = np.empty(len(contexts), np.int64)
    position[sorted(range(len(contexts)), key=first.__getitem__)] = np.arange(len(contexts))
    of = np.repeat(np.arange(len(contexts)), widths)
    within = np.arange(len(of)) - np.repeat(np.cumsum(widths) - widths, widths)
    stride = int(widths.max()) + 1
    previous, following = factors(data, base[of] + within, position[of] * stride + within, length)
    earlier, any_ = previous >= length, (previous >= length) | (following >= length)
    cuts = np.cumsum(widths)[:-1]
    return [np.flatnonzero(x) for x in np.split(earlier, cuts)], [np.flatnonzero(x) for x in np.split(any_, cuts)]


def runs(starts: np.ndarray, length: int) -> list[dict]:
    """The stretches that strings from sorted ``starts`` cover, end exclusive."""
    if len(starts) == 0:
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [{"s": int(p[0]), "e": int(p[-1]) + length} for p in np.split(starts, cut)]


#: Bits of the filter that keeps texts which aren't concerned out of a shuffle: 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def filter_of(rows: DataFrame) -> np.ndarray:
    """A bit map of hashes of the names in ``rows`` (row), merged in the executors, 2 ** 20 words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = name_hashes(b.column(0).to_pylist())
                word, at = np.unique(h >> 6, return_inverse=True)
                bits = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bits, at, np.uint64(1) << (h & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = rows.select("row").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def name_hashes(names: list[bytes]) -> np.ndarray:
    return (np.frombuffer(b"".join(n[-8:] for n in names), np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)


def in_filter(names: list[bytes], bits: np.ndarray) -> np.ndarray:
    h = name_hashes(names)
    return (bits[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def named(docs: DataFrame, bits=None, concerned: bool = True) -> DataFrame:
    """(row, *columns) of (_key, _text); with a broadcast filter, only the rows that are, or aren't, in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            names = row_names(b, *utf8(b.column(1)))
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *b.columns], ["row", "_key", "_text"])
            yield out if bits is None else out.filter(pa.array(in_filter(names, bits.value) == concerned))

    return docs.mapInArrow(run, f"row binary, _key {docs.schema['_key'].dataType.simpleString()}, _text string")


_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def all_anchors(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(row, low, high, a, c) of rows (_key, _text); ``row`` hashes key and text to 16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            data, offsets = utf8(b.column(1))
            r, low, high, a, c = anchors(data, offsets, length, anchor)
            names = pa.array(row_names(b, data, offsets), pa.binary())
            for k in range(0, len(r), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(r[s])), pa.array(low[s].astype(np.int32)), pa.array(high[s].astype(np.int32)), pa.array(a[s]), pa.array(c[s])], ["row", "low", "high", "a", "c"])

    return docs.mapInArrow(run, "row binary, low int, high int, a bigint, c bigint")


def row_names(b: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes for each row: integer keys in their order, then a hash of the text; else a hash of both."""
    raw = data.tobytes()
    out = []
    for i, k in enumerate(b.column(0).to_pylist()):
        t = raw[offsets[i] : offsets[i + 1]]
        out.append((k + (1 << 63)).to_bytes(8) + xxhash.xxh3_64_digest(t) if isinstance(k, int) else xxhash.xxh3_128_digest(f"{k}\x00".encode() + t))
    return out


def repeated_runs(docs: DataFrame, length: int, anchor: int, keep_first: bool, group: int, send: int) -> DataFrame:
    """(row, runs array<struct<s, e>>) of the rows that lose anything, from rows (_key, _text)."""
    found = materialise(all_anchors(docs, length, anchor), "anchors")
    contexts = materialise(found.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("row", "low", "high")).alias("first")), "contexts")
    several = contexts.groupBy("a").agg(F.count("*").alias("n_contexts")).filter("n_contexts > 1")
    wanted = materialise(contexts.join(several, "a").select("a", "c", "n_contexts", "first.*"), "wanted")

    # One copy of each context is cut out of the text of the row where it stands first.
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("a", "c", "n_contexts", "low", "high")).alias("wanted"))
    small = wanted.count() * 80 <= send
    bits = None if small else docs.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            out = []
            for row, text, of in zip(*(c.to_pylist() for c in b.columns)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out += [(w["n_contexts"], w["a"], w["c"], row, w["low"], 0, raw[w["low"] : w["high"] + length]) for w in of]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["n_contexts", "a", "c", "row", "low", "shift", "context"])

    cuts = named(docs, bits).join(F.broadcast(by_row) if small else by_row, "row").select("row", "_text", "wanted").mapInArrow(cut, f"n_contexts bigint, {_CONTEXT}")
    cuts = materialise(cuts, "cuts")
    flagged = small_groups(cuts.filter(F.col("n_contexts") <= group), length, anchor, keep_first)
    large = cuts.filter(F.col("n_contexts") > group).drop("n_contexts")
    if not large.isEmpty():
        flagged = flagged.unionByName(large_groups(large, length, anchor, keep_first, group))
    flagged = materialise(flagged.groupBy("a", "c").agg(F.flatten(F.collect_list("flags")).alias("flags")), "flagged")  # a few runs for each part of a context

    whole = F.array(F.struct(F.lit(0).alias("s"), (F.col("high") - F.col("low") + length).cast("int").alias("e")))
    marks = materialise(contexts.select("a", "c", "n", "first").join(flagged, ["a", "c"], "left").filter("n > 1 or flags is not null").withColumnRenamed("first", "_first"), "marks")
    hit = join_hot(found, marks, ["a", "c"], "n", found.count())
    if keep_first:
        mine = (F.col("_first.row") == F.col("row")) & (F.col("_first.low") == F.col("low"))
        hit = hit.withColumn("of", F.when(mine, F.col("flags")).otherwise(whole)).filter("of is not null")
    else:
        hit = hit.withColumn("of", F.when(F.col("n") > 1, whole).otherwise(F.col("flags")))
    placed = hit.select("row", F.explode("of").alias("x"), "low").select("row", (F.col("x.s") + F.col("low")).alias("s"), (F.col("x.e") + F.col("low")).alias("e"))
    out = materialise(placed.groupBy("row").agg(F.collect_set(F.struct("s", "e")).alias("runs")), "runs")  # within one text
    discard(found, contexts, wanted, cuts, flagged, marks)
    return out


#: A context, or what is left of it: it starts at ``low`` in its row's text and ``shift`` bytes into the context that (a, c) names.
_CONTEXT = "a bigint, c bigint, row binary, low int, shift int, context binary"
_FLAGS = "a bigint, c bigint, flags array<struct<s: int, e: int>>"


def anchor_places(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """How far into each context its anchor stands: the first stretch of all of its first string's with that hash."""
    rolling, within = Rolling(data), np.arange(length - anchor + 1)
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 1024):
        at = offsets[k : min(k + 1024, len(a)), None] + within
        out[k : k + 1024] = (rolling.of(at.ravel(), at.ravel() + anchor).view(np.int64).reshape(at.shape) == a[k : k + 1024, None]).argmax(axis=1)
    return out


def parts(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, ways: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Each of ``ways`` parts of the ranges [lo, hi]: (context, lo, hi, first, last, core, extent) of the contexts that are alive in it.

    Strings start l bytes before the anchor, which stands ``at`` bytes into the context. In [lo, hi] those of
    the context have l in [first, last].
    """
    rolling = Rolling(data)
    base, smallest = offsets[:-1] + at, at - (np.diff(offsets) - length)
    for w in range(ways):
        low, high = lo + (hi - lo + 1) * w // ways, lo + (hi - lo + 1) * (w + 1) // ways - 1
        first, last = np.maximum(low, smallest), np.minimum(high, at)
        on = np.flatnonzero(first <= last)
        low, high, first, last, b = low[on], high[on], first[on], last[on], base[on]
        with np.errstate(over="ignore"):
            core = mix(rolling.of(b - low, b + length - high) + mix((low << 32 | high).astype(np.uint64)))
            extent = mix(rolling.of(b - last, b + length - first) + mix((first << 32 | last).astype(np.uint64)))
        yield on, low, high, first, last, core, extent


def settled(rows: list[dict], length: int, keep_first: bool) -> pa.RecordBatch:
    """(a, c, flags) of contexts, by longest previous and next factors in one suffix array."""
    widths = np.array([len(r["context"]) - length + 1 for r in rows])
    earlier, any_ = repeated_starts([r["context"] for r in rows], widths, [(r["row"], r["low"]) for r in rows], length)
    flags = [runs(s + r["shift"], length) for r, s in zip(rows, earlier if keep_first else any_)]
    on = [k for k, f in enumerate(flags) if f]
    return pa.RecordBatch.from_arrays([pa.array([rows[k]["a"] for k in on], pa.int64()), pa.array([rows[k]["c"] for k in on], pa.int64()), pa.array([flags[k] for k in on], _RUNS)], ["a", "c", "flags"])


def promising(rows: list[dict], length: int, anchor: int) -> list[dict]:
    """Contexts that share the core of a half with another of their group, cut down to the halves that do."""
    data, offsets = utf8(pa.array([r["context"] for r in rows], pa.binary()))
    a = np.array([r["a"] for r in rows], np.int64)
    at = anchor_places(data, offsets, a, length, anchor)
    n = len(rows)
    from_, to = np.full(n, length), np.full(n, -1)
    for on, _, _, first, last, core, _ in parts(data, offsets, at, np.zeros(n, np.int64), np.full(n, length - anchor), 2, length):
        _, inverse, counts = np.unique(core ^ a[on].view(np.uint64), return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        k = on[shared]
        from_[k], to[k] = np.minimum(from_[k], first[shared]), np.maximum(to[k], last[shared])
    out = []
    for k in np.flatnonzero(to >= 0).tolist():
        s = int(at[k] - to[k])
        out.append(rows[k] | {"low": rows[k]["low"] + s, "shift": rows[k]["shift"] + s, "context": rows[k]["context"][s : int(at[k] + length - from_[k])]})
    return out


def sorted_groups(rows: DataFrame, by: list[str], length: int, anchor: int, keep_first: bool) -> DataFrame:
    """(a, c, flags) of contexts in groups of bounded size, many groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for g in groups(batches, len(by)):
            mine = g.to_pylist()
            held += mine
            size += sum(len(r["context"]) for r in mine)
            if size >= SORT_BYTES:
                if some := promising(held, length, anchor):
                    yield settled(some, length, keep_first)
                held.clear()
                size = 0
        if held and (some := promising(held, length, anchor)):
            yield settled(some, length, keep_first)

    names = [*by, *(n for n in ("a", "c", "row", "low", "shift", "context") if n not in by)]
    return rows.repartition(*by).sortWithinPartitions(*by).select(*names).mapInArrow(run, _FLAGS)


def small_groups(cuts: DataFrame, length: int, anchor: int, keep_first: bool) -> DataFrame:
    """Flags of anchors with at most ``group`` contexts."""
    return sorted_groups(cuts.drop("n_contexts"), ["a"], length, anchor, keep_first)


def large_groups(cuts: DataFrame, length: int, anchor: int, keep_first: bool, group: int) -> DataFrame:
    """Flags of anchors with any number of contexts, which are parted until they fit suffix arrays."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "context"):
            if b.num_rows == 0:
                continue
            names = b.schema.names
            data, offsets = utf8(b.column("context"))
            a, low, shift, lo, hi = (b.column(n).to_numpy() for n in ("a", "low", "shift", "lo", "hi"))
            at = anchor_places(data, offsets, a, length, anchor) if "at" not in names else b.column("at").to_numpy().astype(np.int64)
            raw = data.tobytes()
            for on, l, h, first, last, core, extent in parts(data, offsets, at, lo.astype(np.int64), hi.astype(np.int64), WAYS, length):
                start, stop = offsets[on] + at[on] - last, offsets[on] + at[on] + length - first
                pick = pa.array(on)
                moved = at[on] - last
                ints = [pa.array(x.astype(np.int32)) for x in (low[on] + moved, shift[on] + moved)]
                contexts = pa.array([raw[s:e] for s, e in zip(start.tolist(), stop.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column("a").take(pick), b.column("c").take(pick), b.column("row").take(pick), *ints, contexts, pa.array(last.astype(np.int32)), pa.array(l.astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(extent.view(np.int64))],
                    ["a", "c", "row", "low", "shift", "context", "at", "lo", "hi", "core", "extent"],
                )

    schema = f"{_CONTEXT}, at int, lo int, hi int, core bigint, extent bigint"
    live = cuts.select("*", F.lit(0).alias("lo"), F.lit(length - anchor).alias("hi"))
    flagged: list[DataFrame] = []
    both = None
    while both is None or not live.isEmpty():
        now = materialise(live.mapInArrow(split, schema), "parts")
        if both is not None:
            discard(both)
        x = F.struct("row", "low", "a", "c", "shift", "context", "at", "lo", "hi")
        classes = materialise(now.groupBy("core", "a", "extent").agg(F.count("*").alias("n"), F.min(x).alias("x")), "classes")
        # Contexts of one extent share all strings of the part; the first of them stands for all from here on.
        same = join_hot(now.select("a", "core", "extent", "c", "shift", F.octet_length("context").alias("bytes")), classes.filter("n > 1").select("a", "core", "extent", "n", F.col("x.c").alias("_c")), ["a", "core", "extent"], "n", now.count())
        if keep_first:
            same = same.filter("c <> _c")
        mine = materialise(same.select("a", "c", F.array(F.struct(F.col("shift").alias("s"), (F.col("shift") + F.col("bytes")).cast("int").alias("e"))).alias("flags")), "same")
        sizes = classes.groupBy("core", "a").agg(F.count("*").alias("size")).filter("size > 1")
        both = materialise(join_hot(classes.select("core", "a", "x"), sizes, ["core", "a"], "size", classes.count()).select("core", "size", "x.*"), "both")
        flagged += [mine, materialise(sorted_groups(both.filter(F.col("size") <= group), ["core", "a"], length, anchor, keep_first), "fits")]
        discard(now, classes)
        live = both.filter(F.col("size") > group).drop("core", "size")
    out = flagged[0]
    for more in flagged[1:]:
        out = out.unionByName(more)
    out = materialise(out, "large")
    discard(both, *flagged)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, keep_first: bool = False, group: int = GROUP, send: int = SEND_BYTES) -> DataFrame:
    """(key, removed array<struct<s, e>>, kept binary): maximal removed runs of bytes, and what stays."""
    if not 0 < anchor <= length:
        raise ValueError("anchor must lie between 1 and length")
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    lost = repeated_runs(plain, length, anchor, keep_first, group, send)
    n_bytes = lost.agg(F.sum(F.size("runs") * 24 + 64)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(iter([b]), "_text"):
                removed, kept = [], []
                for t, of in zip(s.column(1).to_pylist(), s.column(2).to_pylist()):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    cut = merged([(x["s"], x["e"]) for x in of or []])
                    ends = [0, *(e for _, e in cut)]
                    kept.append(b"".join(raw[a:z] for a, z in zip(ends, [*(x for x, _ in cut), len(raw)])))
                    removed.append([{"s": x, "e": z} for x, z in cut])
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(removed, _RUNS), pa.array(kept, pa.binary())], ["k", "removed", "kept"])

    if n_bytes <= send:
        both = named(plain).join(F.broadcast(lost), "row", "left")
    else:
        bits = docs.sparkSession.sparkContext.broadcast(filter_of(lost))
        rest = named(plain, bits, concerned=False).withColumn("runs", F.lit(None).cast(lost.schema["runs"].dataType))
        both = named(plain, bits).join(lost, "row", "left").unionByName(rest)
    out = both.select("_key", "_text", "runs").mapInArrow(run, f"k {kind}, removed array<struct<s: int, e: int>>, kept binary")
    return out.withColumnRenamed("k", key)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", (F.octet_length("kept") + lost).cast("long").alias("n_bytes"), lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
