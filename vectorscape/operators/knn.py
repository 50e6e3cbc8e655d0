"""The cosine nearest-neighbour graph: exact neighbours in blocks, affinities, symmetry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorscape.functions.vectors import clip01, dot
from vectorscape.operators.vectors import check_vectors, matrix_of
from vectorscape.storage import written

#: Bytes of vectors that one pass sends to the tasks.
BLOCK_BYTES = 64 << 20


def unit_rows(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    if (length == 0).any():
        raise ValueError("a vector has norm 0")
    return x / length


def nearest(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", queries: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, validate: bool = True, keep: bool = True) -> DataFrame:
    """(src, dst, rank, similarity): for each row of ``queries`` (else of ``df``) its k most similar other rows.

    The searched side is sent in blocks of bounded size, a pass over the queries for each; a pass returns k
    candidates a query, of which the k best are kept. Ties go by id; a row is itself by id, not by position.
    With ``keep`` the vectors are computed once and written out. Queries are dealt to all cores, as the work is
    in the products.
    """
    if keep:
        df = written(df.select(key, vector), "vectors")
    n = check_vectors(df, k if queries is None else None, vector, 1 if queries is not None else 2) if validate else df.count()
    if k < 1:
        raise ValueError("k must be positive")
    q = (df if queries is None else queries).select(F.col(key).alias("src"), F.col(vector).cast("array<double>").alias("v"))
    q = q.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // 50_000)))
    width = df.select(F.size(vector)).first()[0]
    blocks = max(1, -(-n * (width * 8 + 8) // block_bytes))
    base = df.select(F.col(key).alias("dst"), F.col(vector).cast("array<double>").alias("v"))
    parts = []
    for b in range(blocks):
        rows = (base if blocks == 1 else base.filter(F.pmod(F.xxhash64("dst"), F.lit(blocks)) == b)).toArrow()
        ids = rows.column("dst").to_numpy()
        if len(ids) == 0:
            continue
        order = np.argsort(ids)
        matrix = unit_rows(rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))[order]
        sent = df.sparkSession.sparkContext.broadcast((ids[order], matrix))  # at most block_bytes
        parts.append(q.mapInArrow(_search(sent, k), "src bigint, dst bigint, similarity double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    w = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("src", "dst", F.col("rank").cast("long").alias("rank"), "similarity")


def best_of(src: np.ndarray, x: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> pa.RecordBatch:
    """(src, dst, similarity): the k best of the unit vectors ``matrix`` for each of ``x``, itself left out; ``ids`` are sorted."""
    s = x @ matrix.T
    s[src[:, None] == ids[None, :]] = -np.inf
    take = min(k, len(ids))
    # all that ties with the k-th, so that the choice among ties is by id
    least = -np.partition(-s, take - 1, axis=1)[:, take - 1 : take]
    row, col = np.nonzero((s >= least) & (s > -np.inf))
    order = np.lexsort((ids[col], -s[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(src)))
    keep = np.arange(len(row)) - first[row] < take
    row, col = row[keep], col[keep]
    return pa.RecordBatch.from_arrays([pa.array(src[row]), pa.array(ids[col]), pa.array(s[row, col])], ["src", "dst", "similarity"])


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        for b in batches:
            step = max(1, (16 << 20) // (8 * len(ids)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                yield best_of(part.column(0).to_numpy(), unit_rows(matrix_of(part.column(1))), ids, matrix, k)

    return run


def cell_centres(sample: np.ndarray, cells: int, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """Unit centres of ``cells`` groups of unit vectors, by spherical k-means; empty groups keep their centre."""
    random = np.random.default_rng(seed)
    centres = sample[random.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        of = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, n_queries: int = 500) -> int:
    """How many nearest cells hold the share ``recall`` of the exact neighbours, within the sample, of its first rows."""
    queries = sample[:n_queries]
    s = queries @ sample.T
    s[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = max(1, min(k, len(sample) - 1))
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, (sample @ centres.T).argmax(1)[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def approximate_nearest(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", recall: float = 0.95, cells: int | None = None, probes: int | None = None, sample: int = 100_000, cell_rows: int = 50_000, seed: int = 42) -> DataFrame:
    """``nearest`` by an inverted file, for tables whose squares are out of reach: each row meets the rows of its ``probes`` nearest cells.

    Cells (by default the square root of the rows, 4,096 at most) are fitted on at most ``sample`` rows, those with
    the smallest key hashes; every row is in one. Unless given, ``probes`` is what reaches ``recall`` for 500 rows
    of the sample against the whole sample, so vectors without groups are probed more widely. A cell of more than ``cell_rows`` rows is dealt in blocks, each of which all its queries meet, so a
    task holds ``cell_rows`` vectors at most. With all cells probed the result is exact.
    """
    df = written(df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")), "vectors")
    n = check_vectors(df, k, "v")
    some = df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toArrow()
    cells = min(cells or max(1, min(4096, round(n**0.5))), some.num_rows)
    fitted = unit_rows(matrix_of(some.column("v").combine_chunks()))
    found = cell_centres(fitted, cells, seed)
    probes = min(probes or probes_for(fitted, found, k, recall), cells)
    centres = df.sparkSession.sparkContext.broadcast(found)  # at most 4,096 vectors by default

    def dealt(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = unit_rows(matrix_of(b.column(1))) @ centres.value.T
                    cell = np.argpartition(-near, count - 1, axis=1)[:, :count].astype(np.int32)
                    row = pa.array(np.repeat(np.arange(b.num_rows), count))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), b.column(0).take(row), b.column(1).take(row)], ["cell", "id", "v"])

        return df.mapInArrow(run, "cell int, id bigint, v array<double>")

    base = written(dealt(1), "cells")
    blocks = F.broadcast(written(base.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).alias("blocks")), "sizes"))  # a row for each cell
    rows = base.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(False).alias("asks"), "id", "v")
    queries = dealt(probes).join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, matrix = None, [], [], None
        for b in batches:
            where = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            cuts = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1]), len(where)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if where[i][:2] != now:
                    now, ids, held, matrix = where[i][:2], [], [], None
                part, x = b.column(3).slice(i, j - i).to_numpy(), unit_rows(matrix_of(b.column(4).slice(i, j - i)))
                if not where[i][2]:
                    ids.append(part)
                    held.append(x)
                    continue
                if not ids:  # a block without rows
                    continue
                if matrix is None:
                    names = np.concatenate(ids)
                    order = np.argsort(names)
                    names, matrix = names[order], np.concatenate(held)[order]
                yield best_of(part, x, names, matrix, k)

    out = rows.unionByName(queries).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks").mapInArrow(run, "src bigint, dst bigint, similarity double")
    w = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("src", "dst", F.col("rank").cast("long").alias("rank"), "similarity")


def nearest_by_expression(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The same for small tables, in expressions only, to check ``nearest`` by; every row meets every other."""
    a = df.select(F.col(key).alias("src"), F.col(vector).alias("a"))
    b = df.select(F.col(key).alias("dst"), F.col(vector).alias("b"))
    s = a.join(b, F.col("src") != F.col("dst")).select("src", "dst", (dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))).alias("similarity"))
    w = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def directed_affinity(neighbours: DataFrame, drop_zero: bool = True) -> DataFrame:
    """(src, dst, weight): 1 - distance in [0, 1], as float32; no loops, and no edges of weight 0 if ``drop_zero``."""
    e = neighbours.filter("src <> dst").select("src", "dst", clip01(F.col("similarity")).cast("float").alias("weight"))
    return e.filter("weight <> 0") if drop_zero else e


def symmetrize(edges: DataFrame, mode: str = "max") -> DataFrame:
    """(src, dst, weight) in both directions; a missing edge weighs 0, and edges of weight 0 vanish."""
    if mode not in ("max", "min", "mean"):
        raise ValueError(f"unknown mode {mode!r}")
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    value = {"max": F.max("weight"), "min": F.when(F.count("*") > 1, F.min("weight")).otherwise(F.lit(0).cast("float")), "mean": (F.sum("weight") * 0.5).cast("float")}[mode]
    return both.groupBy("src", "dst").agg(value.alias("weight")).filter("weight <> 0")


def build_knn(df: DataFrame, k: int = 15, mode: str = "max", key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The directed edges and the symmetric ones."""
    directed = directed_affinity(nearest(df, k, key, vector))
    return directed, symmetrize(directed, mode)


def reciprocity(edges: DataFrame) -> DataFrame:
    """One row: the share of edges whose reverse is an edge, 0 without edges."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    r = edges.join(back, ["src", "dst"], "left").agg(F.count("*").alias("n"), F.count("back").alias("m"))
    return r.select(F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.0).alias("reciprocity"))


def diagonal_abs_sum(edges: DataFrame) -> DataFrame:
    return edges.filter("src = dst").agg(F.coalesce(F.sum(F.abs("weight")), F.lit(0.0)).alias("diagonal_abs_sum"))
