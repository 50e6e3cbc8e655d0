"""Tag statistics: counts, pairs, NPMI, the tag graph and its pruning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorscape.functions.text import assign_labels, parse_tags, top_weight_tags

# Fixed values: (tag column, weight column, result column) of the four groups.
TOP_GROUPS = (
    ("genre", "genre_weights", "top_k_genre"),
    ("theme", "theme_weights", "top_k_theme"),
    ("mood_all", "mood_all_weights", "top_k_mood"),
    ("style", "style_weights", "top_k_style"),
)


def with_top_tags(df: DataFrame, groups: Sequence[tuple[str, str, str]] = TOP_GROUPS) -> DataFrame:
    """``df`` with the tags of greatest weight; a missing tag column gives none, a missing weight column all."""
    for tags, weights, out in groups:
        if tags not in df.columns:
            value = F.array().cast("array<string>")
        elif weights not in df.columns:
            value = F.array_distinct(F.transform(parse_tags(F.col(tags)), F.lower))
        else:
            value = top_weight_tags(F.col(tags), F.col(weights))
        df = df.withColumn(out, value)
    return df


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """(tag, n): occurrences, repeats within a row included."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def n_tags(df: DataFrame, tags: str) -> DataFrame:
    """One row: the number of different tags."""
    return df.select(F.explode(tags).alias("tag")).agg(F.count_distinct("tag").alias("n_tags"))


def top_tags(df: DataFrame, tags: str, n: int) -> DataFrame:
    """The n most frequent tags, ties by name, with their percentage of those n."""
    if n < 1:
        raise ValueError("n must be positive")
    top = tag_counts(df, tags).orderBy(F.desc("n"), "tag").limit(n)
    return top.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def tag_pairs(df: DataFrame, tags: str) -> DataFrame:
    """(tag_a, tag_b, n_both), a < b: rows that have both. Pairs are made within a row; nothing is joined."""
    rows = df.select(F.array_sort(F.array_distinct(tags)).alias("s"))
    left = rows.select("s", F.posexplode("s").alias("i", "tag_a"))
    pairs = left.select("tag_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("tag_b"))
    return pairs.groupBy("tag_a", "tag_b").agg(F.count("*").alias("n_both"))


def npmi(n_a: Column, n_b: Column, n_both: Column, n: Column, on_degenerate: str = "raise") -> Column:
    """ln(p_ab / (p_a p_b)) / -ln(p_ab); 0 if a count is 0.

    A pair in all rows divides by 0: ``on_degenerate`` is ``raise`` (as ANSI division does) or ``null``.
    """
    if on_degenerate not in ("raise", "null"):
        raise ValueError(f"unknown on_degenerate {on_degenerate!r}")
    a, b, both, total = (c.cast("double") for c in (n_a, n_b, n_both, n))
    top, bottom = F.log(both * total / (a * b)), -F.log(both / total)
    value = F.try_divide(top, bottom) if on_degenerate == "null" else top / bottom
    return F.when((n_a == 0) | (n_b == 0) | (n_both == 0) | (n == 0), 0.0).otherwise(value)


def npmi_table(df: DataFrame, tags: str, min_tag_count: int = 3, min_pairs: int = 2, on_degenerate: str = "raise") -> DataFrame:
    """(tag_a, tag_b, n_a, n_b, n_both, n_total, npmi) of pairs of tags that are frequent enough."""
    counts = tag_counts(df, tags).filter(F.col("n") >= min_tag_count)
    pairs = tag_pairs(df, tags).filter(F.col("n_both") >= min_pairs)
    total = df.agg(F.count("*").alias("n_total"))
    out = pairs.join(counts.toDF("tag_a", "n_a"), "tag_a").join(counts.toDF("tag_b", "n_b"), "tag_b").join(F.broadcast(total))  # one row
    return out.select("tag_a", "tag_b", "n_a", "n_b", "n_both", "n_total", npmi(F.col("n_a"), F.col("n_b"), F.col("n_both"), F.col("n_total"), on_degenerate).alias("npmi"))


def tag_graph(df: DataFrame, tags: str, min_cooccurrence: int = 2, min_tag_count: int = 3) -> tuple[DataFrame, DataFrame]:
    """Vertices (name), isolated ones too, and edges (src, dst, weight), src < dst, of positive NPMI."""
    if tags not in df.columns:
        raise ValueError(f"no column {tags!r}")
    vertices = tag_counts(df, tags).filter(F.col("n") >= min_tag_count).select(F.col("tag").alias("name"))
    table = npmi_table(df, tags, min_tag_count, min_cooccurrence, "null")
    return vertices, table.filter("npmi > 0").select(F.col("tag_a").alias("src"), F.col("tag_b").alias("dst"), F.col("npmi").alias("weight"))


def threshold_graph(table: DataFrame, at_least: float = 0.15) -> DataFrame:
    """Edges of an NPMI table from a threshold on, which is included; other tags vanish."""
    return table.filter(F.col("npmi") >= at_least).select(F.col("tag_a").alias("src"), F.col("tag_b").alias("dst"), F.col("npmi").alias("weight"))


def prune_topk(edges: DataFrame, k: int = 10) -> DataFrame:
    """Edges that are among the k heaviest of either end; ties by name."""
    if k < 1:
        raise ValueError("k must be positive")
    both = edges.select(F.col("src").alias("v"), "src", "dst", "weight").union(edges.select(F.col("dst").alias("v"), "src", "dst", "weight"))
    w = Window.partitionBy("v").orderBy(F.desc("weight"), "src", "dst")
    return both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("src", "dst", "weight").distinct()


def cooccurrence_matrix(df: DataFrame, tags: str, names: Sequence[str]) -> DataFrame:
    """A row and a column for each of ``names`` (a short list); the diagonal holds tag counts, other cells common rows."""
    pairs = tag_pairs(df, tags).toDF("tag", "other", "n")
    cells = pairs.union(pairs.select("other", "tag", "n")).union(tag_counts(df, tags).select("tag", F.col("tag").alias("other"), "n"))
    cells = cells.filter(F.col("tag").isin(*names) & F.col("other").isin(*names))
    return cells.groupBy("tag").pivot("other", list(names)).sum("n").na.fill(0)


def cluster_pair_similarity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_a, cluster_b, similarity): the mean weight of the edges between two clusters of (tag, cluster)."""
    e = edges.join(clusters.toDF("src", "a"), "src").join(clusters.toDF("dst", "b"), "dst").filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("cluster_a"), F.greatest("a", "b").alias("cluster_b")).agg(F.avg("weight").alias("similarity"), F.count("*").alias("n_edges"))


def with_labels(df: DataFrame, tags: str, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    return df.withColumn("labels", assign_labels(F.col(tags), labels))


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("labels").agg(F.count("*").alias("n"))


def sweep_cooccurrence(df: DataFrame, tags: str, thresholds: Sequence[int] = (2, 3, 5, 7, 10), min_tag_count: int = 3) -> DataFrame:
    """(min_cooccurrence, n_nodes, n_edges, mean_weight): all thresholds from one table of pairs."""
    table = npmi_table(df, tags, min_tag_count, min(thresholds), "null").filter("npmi > 0")
    each = table.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("min_cooccurrence")).filter("n_both >= min_cooccurrence")
    nodes = each.select("min_cooccurrence", F.explode(F.array("tag_a", "tag_b")).alias("tag")).groupBy("min_cooccurrence").agg(F.count_distinct("tag").alias("n_nodes"))
    return each.groupBy("min_cooccurrence").agg(F.count("*").alias("n_edges"), F.avg("npmi").alias("mean_weight")).join(nodes, "min_cooccurrence")
