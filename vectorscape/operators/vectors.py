"""Embedding tables: mean, second moments, centring, sanity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorscape.functions.vectors import as_doubles, dot, has_inf, has_nan, norm, subtract, unit
from vectorscape.storage import discard, written


def matrix_of(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, a row each; ValueError if they differ in length. Nulls are left out."""
    column = column.drop_null()
    width = np.diff(column.offsets.to_numpy())
    if len(width) and (width != width[0]).any():
        raise ValueError("vectors must have one dimension")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(parts: DataFrame) -> DataFrame:
    """The sums of arrays ``row`` by ``i``, streamed; there is a row for each task and ``i``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(1)):
                x = row.values.to_numpy()
                total[i] = total[i] + x if i in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "row"])

    return parts.repartition("i").mapInArrow(run, parts.schema)


def moments(df: DataFrame, vector: str = "embedding", scale_by: float | None = None) -> DataFrame:
    """(i, row): row i of the Gram matrix of all vectors, then the sum of dimension i, then the number of vectors.

    A task sends its own matrix only, d * d numbers. With ``scale_by`` each vector is first divided by its
    length plus that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = total = None
        n = 0
        for b in batches:
            x = matrix_of(b.column(0))
            if len(x) == 0:
                continue
            if scale_by is not None:
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + scale_by)
            gram, total, n = (x.T @ x if gram is None else gram + x.T @ x), (x.sum(0) if total is None else total + x.sum(0)), n + len(x)
        if n:
            rows = np.column_stack([gram, total, np.full(len(total), float(n))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(list(rows), pa.list_(pa.float64()))], ["i", "row"])

    return summed(df.select(as_doubles(F.col(vector)).alias("v")).mapInArrow(run, "i bigint, row array<double>"))


def mean_vector(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: ``mean``, the vector of column means; null without vectors. A task sends d sums and a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            x = matrix_of(b.column(0))
            if len(x):
                total, n = (x.sum(0) if total is None else total + x.sum(0)), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.append(total, float(n))], pa.list_(pa.float64()))], ["i", "row"])

    sums = summed(df.select(as_doubles(F.col(vector)).alias("v")).mapInArrow(run, "i bigint, row array<double>"))
    mean = F.transform(F.slice("row", 1, F.size("row") - 1), lambda x: x / F.element_at("row", -1))
    return sums.agg(F.first(mean).alias("mean"))


def center_and_normalize(df: DataFrame, vector: str = "embedding", single: bool = False) -> DataFrame:
    """``df`` with centred vectors of length 1, as float32 if ``single``; a vector that equals the mean raises."""
    mean = mean_vector(df, vector)  # one row
    out = df.join(F.broadcast(mean)).withColumn(vector, unit(subtract(F.col(vector), F.col("mean")))).drop("mean")
    return out.withColumn(vector, F.col(vector).cast("array<float>")) if single else out


def embedding_flags(df: DataFrame, vector: str = "embedding", eps: float = 1e-12) -> DataFrame:
    """One row: n, d, has_nan, has_inf, has_zero_norm."""
    v = F.col(vector)
    return df.select(v.alias("v")).agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d"),
        *(F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in (("has_nan", has_nan(F.col("v"))), ("has_inf", has_inf(F.col("v"))), ("has_zero_norm", norm(F.col("v")) <= eps))),
    )


def embedding_sanity(df: DataFrame, vector: str = "embedding", eps: float = 1e-12, key: str | None = None, n_pairs: int | None = None, seed: int = 42) -> DataFrame:
    """One row: n, d, has_nan, has_inf, has_zero_norm, cosine_mean, cosine_std of pairs of different rows.

    Without ``n_pairs`` the moments are exact over all pairs: with z the unit vectors, sums over pairs follow
    from the sum vector and the Gram matrix, d numbers and d * d. With it, that many pairs are drawn by hash
    from consecutive numbers given to ``key``.
    """
    v = F.col(vector)
    z, flags = df.select(F.transform(as_doubles(v), lambda x: x / (norm(v) + eps)).alias("z")), embedding_flags(df, vector, eps)
    if n_pairs is None:
        # Row i of the Gram matrix ends in the sum of dimension i and the number of vectors.
        rows = moments(df, vector, eps).select(F.slice("row", 1, F.size("row") - 2).alias("g"), F.element_at("row", -2).alias("s"))
        sums = rows.agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum(dot(F.col("g"), F.col("g"))).alias("g2"))
        own = z.select(dot(F.col("z"), F.col("z")).alias("q")).agg(F.sum("q").alias("q"), F.sum(F.col("q") * F.col("q")).alias("q2"))
        both = flags.join(F.broadcast(sums)).join(F.broadcast(own))  # one row each
        pairs = F.nullif(F.col("n").cast("double") * (F.col("n") - 1), F.lit(0.0))
        mean = (F.col("s2") - F.col("q")) / pairs
        second = (F.col("g2") - F.col("q2")) / pairs
        return both.select("n", "d", "has_nan", "has_inf", "has_zero_norm", F.coalesce(mean, F.lit(0.0)).alias("cosine_mean"), F.coalesce(F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))), F.lit(0.0)).alias("cosine_std"))
    if key is None:
        raise ValueError("drawn pairs need a key")
    ids = numbered(df, key)
    n = ids.count()
    if n < 2:
        return flags.select("*", F.lit(0.0).alias("cosine_mean"), F.lit(0.0).alias("cosine_std"))
    drawn = written(draw_pairs(df.sparkSession, n, n_pairs, seed), "drawn")
    wanted = written(drawn.select(F.col("a").alias("at")).union(drawn.select("b")).distinct().join(ids, "at"), "wanted")
    keyed = df.withColumnRenamed(key, "_k").join(wanted.withColumnRenamed("k", "_k"), "_k").select("at", F.transform(as_doubles(v), lambda x: x / (norm(v) + eps)).alias("z"))
    cos = drawn.join(keyed.toDF("a", "za"), "a").join(keyed.toDF("b", "zb"), "b").select(dot(F.col("za"), F.col("zb")).alias("c"))
    return flags.join(F.broadcast(cos.agg(F.avg("c").alias("cosine_mean"), F.stddev_pop("c").alias("cosine_std"))))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """(k, at), written out: the distinct keys, numbered from 0 in their order. Only partition sizes reach the driver."""
    sorted_ = df.select(F.col(key).alias("k")).distinct().repartitionByRange("k").sortWithinPartitions("k")
    rows = written(sorted_.select("k", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "numbered")
    sizes = sorted((r.p, r["count"]) for r in rows.groupBy("p").count().collect())
    starts = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "p int, start long")
    out = written(rows.join(F.broadcast(offsets), "p").select("k", (F.col("start") + F.col("at")).alias("at")), "numbered")  # a row for each partition
    discard(rows)
    return out


def draw_pairs(spark, n: int, n_pairs: int, seed: int) -> DataFrame:
    """(a, b): min(n_pairs, n (n - 1) / 2) pairs of different numbers below n, with replacement, the same for a seed."""
    draws = min(n_pairs, n * (n - 1) // 2)
    drawn = spark.range(draws).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("a"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n - 1)).alias("b"))
    return drawn.select("a", F.when(F.col("b") >= F.col("a"), F.col("b") + 1).otherwise(F.col("b")).alias("b"))


def check_vectors(df: DataFrame, k: int | None = None, vector: str = "embedding", min_rows: int = 2) -> int:
    """The number of rows, or ValueError: too few rows, unequal or no dimensions, values that aren't finite, k out of range."""
    r = df.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.bool_or(has_nan(F.col(vector)) | has_inf(F.col(vector))).alias("bad")).first()
    if r.n < min_rows:
        raise ValueError(f"{r.n} vectors; at least {min_rows} are needed")
    if r.low != r.high or r.low < 1:
        raise ValueError("vectors must have one dimension, 1 at least")
    if r.bad:
        raise ValueError("vectors must be finite")
    if k is not None and not 0 < k < r.n:
        raise ValueError(f"k must lie between 1 and {r.n - 1}")
    return r.n
