"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorscape.llm.shared import discard, join_hot, materialise


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around the smallest node of each of its components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(a), find(c)
            if a != c:
                root[max(a, c)] = min(a, c)
    stars = [(x, find(x)) for x in list(root)]
    stars = [s for s in stars if s[0] != s[1]]
    yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], ["a", "b"])


def settled(edges: DataFrame) -> bool:
    """Whether all edges (a, b) make stars: a node has one root, and roots have none."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("b", F.lit(0), F.lit(1)))
    return roles.groupBy("node").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).filter("low > 1 or (low > 0 and high > 0)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root), written out, for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Edges are first contracted within their partitions, which keeps the components and shortens paths. Then it
    alternates the large-star and small-star steps (Kiveris et al. 2014): each edge moves towards the smallest
    neighbour until all are stars. A node with many edges is met by partial minima, which are sent to where its
    edges are.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(contracted, "a bigint, b bigint"), "edges")
    for _ in range(rounds):
        if settled(now):
            break
        total = 2 * now.count()
        both = now.union(now.select("b", "a"))
        smallest = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")), "smallest")
        large = join_hot(both, smallest, ["a"], "n", total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # An edge's lower end moves as well.
        large = large.union(join_hot(now.select("b"), smallest.withColumnRenamed("a", "b"), ["b"], "n", total).filter("m < b").select("b", "m")).filter("a <> b").distinct()
        large = materialise(large, "large")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = join_hot(large, least, ["a"], "n", total)
        small = small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").filter("a > b").distinct()
        after = materialise(small, "edges")
        discard(now, smallest, large, least)
        now = after
    else:
        raise RuntimeError("components did not settle")
    out = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct()), "components")
    discard(now)
    return out
