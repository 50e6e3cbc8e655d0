"""Operator 7: n-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts with the same set of word shingles are one class from the start. Each class has a
signature of ``trees * DEPTH`` minima in ``trees`` stretches, a stretch being its label in
one prefix trie. A trie is the sorted labels; its nodes are runs of equal prefixes. What
shares a whole label is compared first, by whole signatures and widely enough that no
pair at the threshold fails (``SLACK`` standard deviations). Then prefixes are shortened
by a value at a time, and only where a run still holds texts that aren't joined, down to
the depth at which two sets at the threshold share a prefix in some tree with the target
recall, 1 - (1 - threshold ** depth) ** trees (``last_depth``).

A run that is too large for one task is cut along its sorted labels first. What its pieces
have joined counts as one afterwards, and of runs that are still divided only texts outside
the largest part meet the others, block by block.

This yields candidate components. In each, all pairs are verified on the exact sets, of
which only the difference from one set of the component travels: the symmetric difference
of two sets is that of their differences, so their similarity follows exactly. No pairs
are emitted: a component is cut into blocks of bounded size, each pair of blocks is a
task's group, and a group returns one row for each member: its number of links and a root.

Two documents are linked if their texts are equal or their sets have a Jaccard
similarity of ``threshold`` or more; a class is a connected component, named by its
smallest key; ``n_links`` counts the different texts linked to a document's text.

Rows: null texts are empty; texts without words are linked to equal texts only; texts of
fewer words than a shingle are one shingle. Null keys stand alone, with null class and
no links. Rows that repeat a key are one node. Keys are integers of any width; others
raise. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vectorscape.llm.components import components
from vectorscape.llm.shared import discard, fresh, join_hot, materialise, mix, slices, table, utf8, windows, words

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, SLACK = 32, 8, 0.9999, 6.0
#: Signatures and bytes of differences in a block, each difference counting ROW_BYTES more; keys that may be sent to every task, 8 bytes each.
BLOCK_SIGNATURES, BLOCK_BYTES, ROW_BYTES, SEND_KEYS = 4096, 1 << 20, 64, 1_000_000


def last_depth(threshold: float, trees: int = TREES, recall: float = RECALL, longest: int = DEPTH) -> int:
    """Where shortening ends: the longest prefix that reaches the target recall at the threshold."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words than ``size`` is one shingle."""
    _, _, h, first = words(data, offsets)
    found, at = windows(h, first, size)
    cut = np.searchsorted(at, first)
    out = []
    for i in range(len(offsets) - 1):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(found[cut[i] : cut[i + 1]]))
        elif first[i + 1] > first[i]:
            x = h[first[i] : first[i + 1]]
            with np.errstate(over="ignore"):
                out.append(mix(np.array([xxhash.xxh3_64_intdigest(x.tobytes())], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 32, n, dtype=np.uint32), r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minima of ``n`` permutations of each set, 16 bits of each; sets are not empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), np.uint16)
    with np.errstate(over="ignore"):
        for k, (c, a) in enumerate(zip(*permutations(n))):
            y = (x ^ c) * a
            y ^= y >> np.uint32(15)
            low = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), starts)
            out[:, k] = (low ^ (low >> np.uint32(13))) & np.uint32(0xFFFF)
    return out


def prefixes(sig: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One key for each row and tree: the tree and the first ``depth`` values of its stretch."""
    stretch = sig.reshape(len(sig), trees, -1)[:, :, :depth].astype(np.uint64)
    key = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), stretch.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(depth):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + stretch[:, :, k])
    return key.view(np.int64)


def describe(docs: DataFrame, size: int, trees: int) -> DataFrame:
    """(k, text_key, set_key, sig) of rows (k, _text): keys of 16 bytes; sig is null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            data, offsets = utf8(b.column(1))
            sets = shingles(data, offsets, size)
            raw = data.tobytes()
            of_text = [xxhash.xxh3_128_digest(raw[offsets[i] : offsets[i + 1]]) for i in range(b.num_rows)]
            of_set = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else xxhash.xxh3_128_digest(t, seed=1) for s, t in zip(sets, of_text)]
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full, trees * DEPTH)) if full else iter(())
            sig = [next(sigs).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of_text, pa.binary()), pa.array(of_set, pa.binary()), pa.array(sig, pa.binary())], ["k", "text_key", "set_key", "sig"])

    return docs.mapInArrow(run, "k bigint, text_key binary, set_key binary, sig binary")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first ``keys`` columns of sorted batches; a group is bounded by its block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in b.columns[:keys]:
            v = c.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            part = b.slice(i, j - i)
            if i == 0 and held and any(held[-1].column(c)[-1] != part.column(c)[0] for c in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            elif i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted batches in pieces of about ``rows`` rows, which end where the first column changes if it does within them."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        for k in range(0, b.num_rows, rows):
            held.append(b.slice(k, rows))
            n += held[-1].num_rows
            if n >= rows:
                t = pa.Table.from_batches(held)
                first = t.column(0).to_numpy()
                end = int(np.flatnonzero(first != first[-1])[-1]) + 1 if first[0] != first[-1] else n
                yield t.slice(0, end)
                held, n = t.slice(end).to_batches(), n - end
    if n:
        yield pa.Table.from_batches(held)


def blocked(df: DataFrame, group: str, member: str, n_blocks) -> DataFrame:
    """Rows dealt to pairs of blocks (i <= j) of their group: in each pair that has the row's block."""
    mine = F.pmod(F.xxhash64(member, F.lit(7)), F.col("_n"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda x: F.struct(F.least(x, F.col("_b")).alias("i"), F.greatest(x, F.col("_b")).alias("j")))
    out = df.withColumn("_n", n_blocks.cast("long")).withColumn("_b", mine).withColumn("_p", F.explode(pairs))
    out = out.select(group, F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), *[c for c in df.columns if c != group], "_b")
    return out.repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j")


def join_run(sig: np.ndarray, root: np.ndarray, low: int, high: int, least: int) -> None:
    """Join the parts of one run whose signatures agree in ``least`` values somewhere; parts that are joined already stay so."""
    left = np.arange(low, high)
    while len(left):
        mine = root[left[0]]
        own = root[left] == mine
        queue, left = left[own].tolist(), left[~own]
        while queue and len(left):
            near = (sig[left] == sig[queue.pop()]).sum(1) >= least
            if near.any():
                other = np.unique(root[left[near]])
                on = np.isin(root[left], other)
                queue += left[on].tolist()
                left = left[~on]
                root[np.isin(root, other)] = mine


def shortened(bucket: np.ndarray, label: np.ndarray, sig: np.ndarray, last: int, least: int) -> np.ndarray:
    """A root for each row, from rows sorted by bucket and label: prefixes get shorter where runs are still divided."""
    n = len(label)
    root = np.arange(n)
    for depth in range(label.shape[1], last - 1, -1):
        new = np.ones(n, bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (label[1:, :depth] != label[:-1, :depth]).any(axis=1)
        low = np.flatnonzero(new)
        high = np.append(low[1:], n)
        two = low[(high - low == 2) & (root[low] != root[np.minimum(low + 1, n - 1)])]
        for i in two[(sig[two] == sig[two + 1]).sum(1) >= least].tolist() if len(two) else ():
            root[root == root[i + 1]] = root[i]
        for i, j in zip(low[high - low > 2].tolist(), high[high - low > 2].tolist()):
            if (root[i:j] != root[i]).any():
                join_run(sig, root, i, j, least)
    return root


def signatures_of(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), -1)


def candidate_edges(nodes: DataFrame, trees: int, last: int, least: int) -> list[DataFrame]:
    """Written links (a, b) that span the candidate components, from nodes (k, sig)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, -1)
                tree = np.tile(np.arange(trees, dtype=np.int32), b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), trees)), pa.array(tree), pa.array(prefixes(sig, trees, last).ravel())], ["k", "tree", "bucket"])

    signed = nodes.filter("sig is not null").select("k", "sig")
    entries = signed.mapInArrow(keys, "k bigint, tree int, bucket bigint")
    sizes = materialise(entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    mine = join_hot(entries, sizes, ["bucket"], "size", nodes.count() * trees).groupBy("k").agg(F.collect_list(F.struct("tree", "bucket", "size")).alias("of"))  # at most one for each tree
    found = mine.join(signed, "k").select("k", "sig", F.explode("of").alias("x"))
    found = materialise(found.select("x.bucket", F.expr(f"substring(sig, x.tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("label"), "k", "sig", "x.size"), "forest")
    discard(sizes)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in pieces(batches, BLOCK_SIGNATURES):
            k = g.column("k").to_numpy()
            label = signatures_of(g.column("label"))
            root = shortened(g.column("bucket").to_numpy(), label, signatures_of(g.column("sig")), last, least)
            on = root != np.arange(len(k))
            yield pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(k[root[on]])], ["a", "b"])

    small, large = found.filter(F.col("size") <= BLOCK_SIGNATURES), found.filter(F.col("size") > BLOCK_SIGNATURES)
    trie = ["bucket", "label", "k", "sig"]
    out = [materialise(small.repartition("bucket").select(trie).sortWithinPartitions("bucket", "label").mapInArrow(links, "a bigint, b bigint"), "links")]
    if not large.isEmpty():
        stretches = large.repartitionByRange("bucket", "label", "k").select(trie).sortWithinPartitions("bucket", "label", "k")
        out.append(materialise(stretches.mapInArrow(links, "a bigint, b bigint"), "links"))
        out.append(divided_edges(large, components(out[0].unionByName(out[1])), least))
    discard(found)
    return out


def divided_edges(large: DataFrame, joined: DataFrame, least: int) -> DataFrame:
    """Links (a, b) between parts of large buckets that ``joined`` (node, root) has left apart.

    Of a bucket all but the largest part are guests. A group has one block of a bucket's rows and one of its
    guests, so nothing is copied for rows of the largest part if the guests fit a block.
    """
    rows = large.join(joined, F.col("k") == F.col("node"), "left").withColumn("part", F.coalesce("root", "k"))
    counts = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("most")).filter("parts > 1")
    mixed = materialise(mixed.select("bucket", "n", F.col("most.part").alias("main"), (F.col("n") - F.col("most.n")).alias("guests")), "mixed")
    rows = join_hot(rows.select("bucket", "k", "sig", "part"), mixed, ["bucket"], "n", large.count())
    n_rows, n_guests = F.ceil(F.col("n") / BLOCK_SIGNATURES), F.ceil(F.col("guests") / BLOCK_SIGNATURES)

    def block(n, seed: int):
        return F.pmod(F.xxhash64("k", F.lit(seed)), n)

    hosts = rows.select("bucket", block(n_rows, 3).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), n_guests - 1)).alias("j"), F.lit(False).alias("guest"), "part", "sig")
    guests = rows.filter("part <> main").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), n_rows - 1)).alias("i"), block(n_guests, 5).alias("j"), F.lit(True).alias("guest"), "part", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            part, guest, sig = g.column("part").to_numpy(), g.column("guest").to_numpy(), signatures_of(g.column("sig"))
            host, found = np.flatnonzero(~guest), set()
            for x in np.flatnonzero(guest).tolist():
                others = host[part[host] != part[x]]
                near = others[(sig[others] == sig[x]).sum(1) >= least]
                found.update((int(part[x]), y) for y in np.unique(part[near]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    dealt = hosts.unionByName(guests).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    out = materialise(dealt.mapInArrow(run, "a bigint, b bigint"), "links")
    discard(mixed, joined)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, send: int) -> DataFrame:
    """(k, set_key, shingles binary) of the rows (k, _text) whose keys are in ``wanted`` (node), one row for each set of a key."""
    rows = docs.filter("k is not null")
    given = None
    if wanted.count() <= send:
        given = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column("node").to_numpy()))
    else:
        rows = rows.join(wanted, F.col("k") == F.col("node"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            if given is not None:
                k, keys = b.column(0).to_numpy(), given.value
                at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
                b = b.filter(pa.array(keys[at] == k if len(keys) else np.zeros(len(k), bool)))
            if b.num_rows:
                sets = [s.tobytes() for s in shingles(*utf8(b.column(1)), size)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["k", "set_key", "shingles"])

    return rows.mapInArrow(run, "k bigint, set_key binary, shingles binary").groupBy("k", "set_key").agg(F.first("shingles").alias("shingles"))


def differences(held: DataFrame) -> DataFrame:
    """(root, k, set_key, n_texts, size, delta): what each set of ``held`` and one set of its component don't share."""
    base = held.filter("k = root").groupBy("root").agg(F.min(F.struct("set_key", "shingles")).alias("x"))
    base = base.join(held.groupBy("root").agg(F.count("*").alias("members")), "root").select("root", F.col("x.shingles").alias("base"), "members")
    base = materialise(base, "bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "shingles"):
            sets, bases = ([np.frombuffer(x, np.uint64) for x in b.column(n).to_pylist()] for n in ("shingles", "base"))
            delta = [np.setxor1d(x, y, assume_unique=True).tobytes() for x, y in zip(sets, bases)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("root", "k", "set_key", "n_texts")), pa.array(list(map(len, sets)), pa.int64()), pa.array(delta, pa.binary())], ["root", "k", "set_key", "n_texts", "size", "delta"])

    out = materialise(join_hot(held, base, ["root"], "members", held.count()).mapInArrow(run, "root bigint, k bigint, set_key binary, n_texts bigint, size bigint, delta binary"), "differences")
    discard(base)
    return out


def verify(deltas: list[np.ndarray], sizes: np.ndarray, weight: np.ndarray, block: np.ndarray, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each set within a pair of blocks, and the place of its root there.

    ``deltas``: the symmetric difference of each set and one that is the same for all; ``sizes`` are those of the sets.
    """
    n = len(deltas)
    lengths = np.array(list(map(len, deltas)))
    _, value = np.unique(np.concatenate(deltas), return_inverse=True)
    row, order = np.repeat(np.arange(n), lengths), np.argsort(value, kind="stable")
    holders, begin = row[order], np.searchsorted(value[order], np.arange(value.max(initial=-1) + 2))
    first = np.cumsum(lengths) - lengths
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left = np.flatnonzero(block == i)
    right = np.flatnonzero(block == j)
    for x in left.tolist():
        others = right[right > x] if i == j else right
        low, high = sizes[others] * threshold <= sizes[x], sizes[x] * threshold <= sizes[others]
        others = others[low & high]
        if len(others) == 0:
            continue
        mine = value[first[x] : first[x] + lengths[x]]
        many = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(holders[at], minlength=n)[others]  # of the differences
        both = (sizes[others] + sizes[x] - (lengths[others] + lengths[x] - 2 * common)) // 2
        near = others[both / (sizes[others] + sizes[x] - both) >= threshold]
        links[x] += weight[near].sum()
        links[near] += weight[x]
        for y in near[root[near] != root[x]].tolist():  # equal roots are one component already
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
    return links, np.array([find(x) for x in range(n)])


def near_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, recall: float = RECALL, send: int = SEND_KEYS) -> DataFrame:
    """(key, class_id, n_links) of every document; keys are integers."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must have integers")
    plain = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("_text"))
    n_values = trees * DEPTH
    least = max(1, math.floor(n_values * (threshold - SLACK * math.sqrt(threshold * (1 - threshold) / n_values))))
    told = materialise(describe(plain, size, trees), "signatures")
    texts = told.filter("k is not null").groupBy("set_key", "text_key").agg(F.min("k").alias("k"), F.any_value("sig").alias("sig"), F.count("*").alias("n_rows"))
    nodes = materialise(texts.groupBy("set_key").agg(F.min("k").alias("k"), F.count("*").alias("n_texts"), F.any_value("sig").alias("sig"), F.sum("n_rows").alias("n_rows")), "nodes")
    edges = candidate_edges(nodes, trees, last_depth(threshold, trees, recall), least)
    rough = components(reduce(lambda a, b: a.unionByName(b), edges))

    members = rough.join(nodes.select("k", "set_key", "n_texts"), F.col("node") == F.col("k")).select("k", "set_key", "root", "n_texts")
    held = materialise(members.join(sets_of(plain, rough.select("node"), size, send), ["k", "set_key"]), "sets")
    apart = differences(held)
    discard(held, *edges)
    sizes = materialise(apart.groupBy("root").agg(F.sum(F.octet_length("delta") + ROW_BYTES).alias("bytes"), F.count("*").alias("members")), "blocks")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("bytes") / BLOCK_BYTES))
    dealt = blocked(join_hot(apart, sizes, ["root"], "members", apart.count()), "root", "k", blocks).select("root", "_i", "_j", "k", "set_key", "n_texts", "size", "delta", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            k, i, j = g.column("k").to_numpy(), g.column("_i")[0].as_py(), g.column("_j")[0].as_py()
            found = [np.frombuffer(x, np.uint64) for x in g.column("delta").to_pylist()]
            links, root = verify(found, g.column("size").to_numpy(), g.column("n_texts").to_numpy(), g.column("_b").to_numpy(), i, j, threshold)
            smallest = np.full(len(k), np.iinfo(np.int64).max)
            np.minimum.at(smallest, root, k)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(links), pa.array(smallest[root]), g.column("set_key").combine_chunks()], ["k", "links", "root", "set_key"])

    checked = materialise(dealt.mapInArrow(run, "k bigint, links bigint, root bigint, set_key binary"), "links")
    final = components(checked.filter("k <> root").select(F.col("k").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("k", "set_key").agg(F.sum("links").alias("links"))
    named = nodes.select("set_key", "k", "n_texts", "n_rows").join(final, F.col("k") == F.col("node"), "left").join(links, ["k", "set_key"], "left")
    named = materialise(named.select("set_key", "n_rows", F.coalesce("root", "k").alias("class_id"), (F.col("n_texts") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    out = join_hot(told.filter("k is not null").select("k", "set_key"), named, ["set_key"], "n_rows", told.count()).select("k", "class_id", F.col("n_links").cast("long").alias("n_links"))
    out = out.unionByName(told.filter("k is null").select("k", F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    out = materialise(out, "joined")
    discard(told, nodes, rough, apart, sizes, checked, final, named)
    return out.withColumnRenamed("k", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs``, all columns, with one document of each class: that with the smallest key, and one row of it.

    Null keys stay; so do different texts under the smallest key.
    """
    joined = near_join(docs, key, text, **how).select(F.col(key).alias("k"), "class_id")
    copies, other = materialise(joined.filter("k <> class_id").select("k").distinct(), "copies"), fresh(docs, "copy")
    left = docs.join(copies.select(F.col("k").alias(other)), F.col(key) == F.col(other), "left_anti")
    again = joined.filter("k = class_id").groupBy("k").count().filter("count > 1").select("k")
    if again.isEmpty():
        return left
    again = materialise(again, "again").select(F.col("k").alias(other))
    once = left.join(again, F.col(key) == F.col(other), "left_semi").dropDuplicates([key, text])
    return left.join(again, F.col(key) == F.col(other), "left_anti").unionByName(once)


def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text),
w AS (SELECT id, {_WORDS} AS w FROM t),
s AS (SELECT DISTINCT id, array_to_string(w[k : k + 4], ' ') AS s FROM w, unnest(range(1, greatest(2, len(w) - 3))) AS u(k) WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.8e0),
r(id, root) AS (SELECT id, id FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links
FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN c USING (id) LEFT JOIN l ON l.a = t.id
"""
