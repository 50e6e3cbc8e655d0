"""Inputs of the registered queries, derived from the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAXONOMY = {"Small goods": ["SMALL", "ECONOMY"], "Large goods": ["LARGE"], "Plain goods": ["STANDARD"]}
EXCLUDED = ("PROMO",)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    """(id, tag_csv, w_csv) of every order: messy tags and their weights."""
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", name.alias("t"), F.col("l_quantity").cast("int").cast("string").alias("w"))
    rows = items(spark, sf).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("x"))  # an order's lines
    return rows.select("id", F.array_join(F.transform("x", lambda s: s["t"]), ",").alias("tag_csv"), F.array_join(F.transform("x", lambda s: s["w"]), ",").alias("w_csv"))


BASKETS = """b AS (SELECT l_orderkey AS id,
  string_agg(CASE WHEN l_linenumber % 2 = 0 THEN ' ' || upper(p_name) || ' ' ELSE p_name END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS tag_csv,
  string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS w_csv
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
t AS (SELECT id, w_csv, list_filter(list_transform(string_split(tag_csv, ','), lambda x: trim(x)), lambda x: x <> '') AS raw FROM b)"""


def tag_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(id, tags) of every order: its distinct part names."""
    return items(spark, sf).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("p_name")).alias("tags"))


TAG_ROWS = """r AS (SELECT DISTINCT l_orderkey AS id, p_name AS tag FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT tag, count(*) AS n FROM r GROUP BY tag),
tot AS (SELECT count(DISTINCT id) AS n_total FROM r),
p AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n_both FROM r x JOIN r y ON x.id = y.id AND x.tag < y.tag GROUP BY ALL),
npmi AS (SELECT tag_a, tag_b, ca.n AS n_a, cb.n AS n_b, n_both, n_total,
  ln(n_both * CAST(n_total AS DOUBLE) / (CAST(ca.n AS DOUBLE) * cb.n)) / -ln(n_both / CAST(n_total AS DOUBLE)) AS npmi
  FROM p JOIN c ca ON ca.tag = tag_a JOIN c cb ON cb.tag = tag_b, tot WHERE n_both >= 2 AND ca.n >= 3 AND cb.n >= 3),
g AS (SELECT tag_a AS src, tag_b AS dst, npmi AS weight FROM npmi WHERE npmi > 0)"""

VECTORS = """mm AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i),
mv AS (SELECT list(m ORDER BY i) AS mean FROM mm),
cv AS (SELECT vec_id, label, list_transform(list_zip(CAST(embedding AS DOUBLE[]), mean), lambda z: z[1] - z[2]) AS v FROM embeddings, mv),
e AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM cv)"""


def knn_sql(k: int) -> str:
    return VECTORS + f""",
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.v, b.v) AS similarity FROM e a, e b WHERE a.vec_id <> b.vec_id),
knn AS (SELECT src, dst, rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM s) WHERE rank <= {k}),
d AS (SELECT src, dst, CAST(least(greatest(similarity, 0), 1) AS FLOAT) AS weight FROM knn WHERE similarity > 0),
u AS (SELECT src, dst, weight FROM d UNION ALL SELECT dst, src, weight FROM d),
sym AS (SELECT src, dst, max(weight) AS weight FROM u GROUP BY ALL)"""


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the place of catalogue metadata, all as text."""
    d = table(spark, sf, "documents")
    genre = F.when(F.col("lang") == "en", "Pop/Rock, Holiday").when(F.col("lang") == "de", "Holiday").when(F.col("lang") == "fr", "Polka").otherwise("Latin,Rap,Reggae")
    return d.select(
        F.col("doc_id").cast("string").alias("song_id"), F.col("lang").alias("quadrant"), F.col("source").alias("artist"), F.lit(None).cast("string").alias("title"), F.col("n_chars").cast("string").alias("duration"),
        F.col("lang").alias("mood"), F.concat_ws(", ", "lang", "source").alias("mood_all"), F.lit("1,2").alias("mood_all_weights"), genre.alias("genre"), F.lit("1").alias("genre_weights"),
        F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("source")).alias("theme"), F.lit("1").alias("theme_weights"), F.col("lang").alias("style"), F.lit("1").alias("style_weights"),
    )


def affect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("song_id"), F.col("quality").cast("string").alias("arousal"), F.col("toxic").cast("string").alias("valence"))


def moods(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of affect: label, tag, arousal and valence of all signs."""
    return table(spark, sf, "events").select(F.col("user_id").alias("label"), F.array("event_type").alias("tags"), (F.col("value") / F.lit(50.0) - 1.0).alias("arousal"), (F.col("event_id") % 201 / 100.0 - 1.0).alias("valence"))
