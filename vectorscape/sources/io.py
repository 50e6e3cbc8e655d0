"""Sinks and readers of results: vectors, indexes, cluster labels, CSV files."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_vectors(df: DataFrame, path: str) -> None:
    df.select("track_id", "embedding").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("track_id", "embedding")


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of an NPZ archive (track_ids, embeddings), for moving existing files in."""
    with np.load(path, allow_pickle=False) as z:
        if missing := {"track_ids", "embeddings"} - set(z.files):
            raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
        ids, x = z["track_ids"].astype(str), np.ascontiguousarray(z["embeddings"], np.float32)
    if x.ndim != 2 or len(ids) != len(x):
        raise ValueError(f"{path} has {len(ids)} ids and embeddings of shape {x.shape}")
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    return spark.createDataFrame(pa.table({"track_id": pa.array(ids), "embedding": vectors}))


def save_index(vectors: DataFrame, mean: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    mean.write.mode("overwrite").parquet(f"{path}/mean")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/mean")


def write_cluster_labels(clusters: DataFrame, path: str) -> None:
    """(cluster, tag) rows as a JSON object of sorted tags; cluster tables are as small as a vocabulary."""
    rows = clusters.groupBy("cluster").agg(F.array_sort(F.collect_list("tag")).alias("tags")).orderBy("cluster").collect()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({r.cluster: r.tags for r in rows}, indent=2, ensure_ascii=False), encoding="utf-8")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, tag) rows of a JSON object of lists."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("label", "tags")).select("label", F.explode("tags").alias("tag"))


def write_csv(df: DataFrame, path: str) -> None:
    """Rows with a header; arrays are comma-joined."""
    flat = [F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')
