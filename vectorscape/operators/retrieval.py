"""Retrieval: an index of centred unit vectors, and exact cosine top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorscape.functions.vectors import dot, subtract, unit
from vectorscape.operators.vectors import center_and_normalize, mean_vector


def build_index(df: DataFrame, key: str = "track_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Vectors (key, vector) and their mean (one row), as float32."""
    mean = mean_vector(df, vector).select(F.col("mean").cast("array<float>").alias("mean"))
    return center_and_normalize(df.select(key, vector), vector, single=True), mean


def prepare_query(queries: DataFrame, mean: DataFrame, vector: str = "embedding") -> DataFrame:
    """Queries centred by the index's mean, at length 1, as float32; one that equals the mean raises."""
    out = queries.join(F.broadcast(mean))  # one row
    return out.withColumn(vector, unit(subtract(F.col(vector), F.col("mean"))).cast("array<float>")).drop("mean")


def retrieve(index: DataFrame, query: Sequence[float], k: int = 10, key: str = "track_id", vector: str = "embedding") -> DataFrame:
    """(key, score) of the min(k, n) best rows for one prepared query; ties by id. One scan, no shuffle of vectors."""
    if k < 1:
        raise ValueError("k must be positive")
    q = F.array(*(F.lit(float(x)) for x in query))
    return index.select(key, dot(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def with_metadata(results: DataFrame, metadata: DataFrame, key: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Results with columns of metadata, ``?`` where it has no row. Of rows that repeat a key the last by ``order`` counts, else the greatest."""
    row = F.struct(*columns)
    one = metadata.groupBy(key).agg((F.max(F.struct(F.col(order).alias("_at"), row.alias("x")))["x"] if order else F.max(row)).alias("_m"))
    out = results.join(one, key, "left")
    return out.select(*results.columns, *(F.coalesce(F.col(f"_m.{c}").cast("string"), F.lit("?")).alias(c) for c in columns))


def align(vectors: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Metadata of the ids that have a vector; ids are matched as text, and others drop out."""
    ids = vectors.select(F.col(key).cast("string").alias("_id")).distinct()
    return metadata.join(ids, F.col(key).cast("string") == F.col("_id")).drop("_id")


def place(metadata: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Metadata with the columns of tables (node, ...), such as communities and coordinates; rows without any keep nulls."""
    for t in tables:
        metadata = metadata.join(t.withColumnRenamed("node", key), key, "left")
    return metadata
