"""Retrieval for a stream of queries: each micro-batch meets the static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vectorscape.operators.knn import nearest
from vectorscape.operators.retrieval import prepare_query


def stream_retrieval(queries: DataFrame, index: DataFrame, mean: DataFrame, k: int, sink: str, checkpoint: str, key: str = "vec_id", vector: str = "embedding", **trigger) -> StreamingQuery:
    """Write (src, dst, rank, similarity, batch) for streamed (key, vector) rows to Parquet at ``sink``."""

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        found = nearest(index, k, key, vector, queries=prepare_query(df, mean, vector), validate=False)
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a batch that is repeated replaces itself

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
