"""All queries over the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.functions import text as T
from vectorscape.functions.tonal import MAJOR, MINOR, encode_key, entropy_bits, scale_alignment
from vectorscape.functions.tonal import variation as tonal_variation
from vectorscape.functions.vectors import describe, total
from vectorscape.operators import audio, community, embedding, graph, knn, layout, quality, retrieval, tags, vectors
from vectorscape.plans import tables as t
from vectorscape.sources import catalog, io
from vectorscape.sources.schemas import METADATA_COLUMNS
from vectorscape.storage import new_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
K = 15


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles of ``names``, to six decimals."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


# Catalogue


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS track_id, 'audio/' || lang || '/' || d.doc_id || '.mp3' AS audio_path, lang AS quadrant, CAST(n_chars AS DOUBLE) AS duration_s, source AS artist,
  CAST(quality AS DOUBLE) AS arousal, CAST(toxic AS DOUBLE) AS valence, CASE lang WHEN 'en' THEN 'Rock/Pop' WHEN 'fr' THEN '' ELSE 'World,Hip-Hop/Rap' END AS genres, lang || ',' || source AS moods
FROM documents d JOIN labels USING (doc_id) WHERE d.doc_id % 7 <> 0 AND lang <> 'de'""")
def catalog_inner_join(spark, sf):
    tracks = catalog.load_catalog(t.metadata(spark, sf), t.affect(spark, sf))
    return tracks.select("track_id", "audio_path", "quadrant", "duration_s", "artist", "arousal", "valence", T.join_tags(F.col("genre_tags_consolidated")).alias("genres"), T.join_tags(F.col("mood_tags")).alias("moods"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def catalog_semi_join(spark, sf):
    return t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '?') AS quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def catalog_left_default(spark, sf):
    return retrieval.with_metadata(t.table(spark, sf, "documents").select("doc_id"), t.table(spark, sf, "labels"), "doc_id", ["quality"], order="quality")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def loader_last_wins(spark, sf):
    return catalog.last_wins(t.table(spark, sf, "conversations"), "conv_id", "turn")


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS track_id, lang AS quadrant, CAST(n_chars AS DOUBLE) AS duration_s, CAST(quality AS DOUBLE) AS arousal, CAST(toxic AS DOUBLE) AS valence, '' AS title, 'train' AS split
FROM documents d JOIN labels USING (doc_id)""")
def loader_split(spark, sf):
    split = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("song_id"), F.col("lang").alias("quadrant"))
    return catalog.load_split(t.metadata(spark, sf), t.affect(spark, sf), split).select("track_id", "quadrant", "duration_s", "arousal", "valence", "title", "split")


@query(f"WITH {t.BASKETS} SELECT id, array_to_string(raw, '|') AS tags, len(raw) AS n FROM t")
def parse_tags(spark, sf):
    return t.baskets(spark, sf).select("id", T.parse_tags(F.col("tag_csv")).alias("x")).select("id", F.array_join("x", "|").alias("tags"), F.size("x").cast("long").alias("n"))


@query(f"""WITH {t.BASKETS}, x AS (SELECT id, unnest(raw) AS v, generate_subscripts(raw, 1) AS i FROM t),
y AS (SELECT id, lower(v) AS v, min(i) AS i FROM x GROUP BY ALL)
SELECT id, string_agg(v, '|' ORDER BY i) AS tags FROM y GROUP BY id""")
def clean_tags(spark, sf):
    return t.baskets(spark, sf).select("id", F.array_join(T.clean_tags(F.col("tag_csv")), "|").alias("tags"))


@query(f"""WITH {t.BASKETS}, x AS (SELECT id, lower(unnest(raw)) AS v, CAST(unnest(string_split(w_csv, ',')) AS INT) AS w, generate_subscripts(raw, 1) AS i FROM t),
y AS (SELECT *, max(w) OVER (PARTITION BY id) AS top FROM x), z AS (SELECT id, v, min(i) AS i FROM y WHERE w = top GROUP BY ALL)
SELECT id, string_agg(v, '|' ORDER BY i) AS tags FROM z GROUP BY id""")
def top_weight_tags(spark, sf):
    df = tags.with_top_tags(t.baskets(spark, sf), [("tag_csv", "w_csv", "top")])
    return df.select("id", F.array_join("top", "|").alias("tags"))


_TYPES = """y AS (SELECT l_orderkey AS id, p_type, min(l_linenumber) AS i FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def type_rows(spark, sf):
    rows = t.items(spark, sf).groupBy(F.col("l_orderkey").alias("id"), "p_type").agg(F.min("l_linenumber").alias("i"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "p_type"))).alias("x")).select("id", F.transform("x", lambda s: s["p_type"]).alias("types"))


@query(f"""WITH {_TYPES}, z AS (SELECT id, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'Small goods' WHEN p_type = 'LARGE' THEN 'Large goods' WHEN p_type = 'STANDARD' THEN 'Plain goods' END AS g FROM y)
SELECT id, coalesce(string_agg(DISTINCT g, '|' ORDER BY g), '') AS groups FROM z GROUP BY id""")
def consolidate_categories(spark, sf):
    return type_rows(spark, sf).select("id", F.array_join(F.array_sort(T.consolidate(F.col("types"), t.TAXONOMY)), "|").alias("groups"))


@query(f"WITH {_TYPES} SELECT id, bool_or(p_type <> 'PROMO') AS valid FROM y GROUP BY id")
def valid_category_filter(spark, sf):
    return type_rows(spark, sf).select("id", T.has_valid_category(F.col("types"), t.EXCLUDED).alias("valid"))


@query(f"""WITH {_TYPES}, z AS (SELECT id, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'Small goods' WHEN p_type = 'LARGE' THEN 'Large goods' WHEN p_type = 'STANDARD' THEN 'Plain goods' END AS g FROM y)
SELECT id, coalesce(string_agg(DISTINCT g, '|' ORDER BY g), '') AS groups FROM z GROUP BY id""")
def consolidate_ignoring_case(spark, sf):
    given = F.transform("types", lambda x: F.concat(F.lit(" "), F.lower(x)))
    return type_rows(spark, sf).select("id", F.array_join(F.array_sort(T.consolidate(given, t.TAXONOMY, ignore_case=True)), "|").alias("groups"))


@query(f"WITH {_TYPES} SELECT id, bool_or(p_type <> 'PROMO') OR id % 2 = 0 AS valid FROM y GROUP BY id")
def valid_category_text(spark, sf):
    """Text with a trailing comma for every other order, whose empty part is valid."""
    given = F.concat(F.array_join("types", ","), F.when(F.col("id") % 2 == 0, ",").otherwise(""))
    return type_rows(spark, sf).select("id", T.has_valid_category_text(given, t.EXCLUDED).alias("valid"))


@query("SELECT l_linenumber, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS variation, 0e0 AS of_zero FROM lineitem GROUP BY l_linenumber")
def variation(spark, sf):
    by = t.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg("l_quantity").cast("double").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return r6(by.select("l_linenumber", tonal_variation(F.col("m"), F.col("s")).alias("variation"), tonal_variation(F.lit(0.0), F.col("s")).alias("of_zero")), "variation")


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS track_id, lang AS quadrant FROM documents d JOIN labels USING (doc_id) WHERE d.doc_id % 7 <> 0 AND lang IN ('en', 'es')""")
def require_groups(spark, sf):
    return catalog.filter_tracks(catalog.load_catalog(t.metadata(spark, sf), t.affect(spark, sf)), ["mood", "genre", "theme", "style"]).select("track_id", "quadrant")


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_distinct FROM documents")
def uniform_sample(spark, sf):
    return catalog.sample_uniform(t.table(spark, sf, "documents").select("doc_id"), 100, "doc_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


@query("SELECT CAST(doc_id AS VARCHAR) AS song_id, lang AS quadrant, source AS artist, sha256(coalesce(text, '')) AS title_sha256, CAST(n_chars AS VARCHAR) AS duration FROM documents")
def csv_metadata(spark, sf):
    """Whole texts as titles, through a CSV file with quotes and line feeds in its cells."""
    rows = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("Song"), F.col("lang").alias("Quadrant"), F.col("source").alias("Artist"), F.coalesce("text", F.lit("")).alias("Title"), F.col("n_chars").alias("Duration"))
    path = new_path(spark, "csv")
    io.write_csv(rows, path)
    columns = {c: METADATA_COLUMNS[c] for c in rows.columns}
    read = catalog.read_csv(spark, path, columns)
    return read.select("song_id", "quadrant", "artist", F.sha2(F.coalesce("title", F.lit("")), 256).alias("title_sha256"), "duration")


@query("SELECT CAST(vec_id AS VARCHAR) AS track_id, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def saved_vectors(spark, sf):
    path = new_path(spark, "vectors")
    io.save_vectors(t.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("track_id"), "embedding"), path)
    return io.load_vectors(spark, path).select("track_id", F.size("embedding").cast("long").alias("dim"), F.round(total(F.col("embedding").cast("array<double>")), 5).alias("total"))


# Tags


@query(f"WITH {t.TAG_ROWS} SELECT tag, n FROM c")
def tag_counts(spark, sf):
    return tags.tag_counts(t.tag_rows(spark, sf), "tags")


@query(f"WITH {t.TAG_ROWS}, top AS (SELECT tag, n FROM c ORDER BY n DESC, tag LIMIT 10) SELECT tag, n, round(100e0 * n / sum(n) OVER (), 6) AS share FROM top")
def top_tags_share(spark, sf):
    return r6(tags.top_tags(t.tag_rows(spark, sf), "tags", 10), "share")


@query(f"WITH {t.TAG_ROWS} SELECT tag_a, tag_b, n_both FROM p")
def tag_pairs(spark, sf):
    return tags.tag_pairs(t.tag_rows(spark, sf), "tags")


@query(f"WITH {t.TAG_ROWS} SELECT tag_a, tag_b, n_a, n_b, n_both, n_total, round(npmi, 6) AS npmi FROM npmi")
def npmi_table(spark, sf):
    return r6(tags.npmi_table(t.tag_rows(spark, sf), "tags"), "npmi")


@query(f"WITH {t.TAG_ROWS} SELECT src, dst, round(weight, 6) AS weight FROM g")
def tag_graph_edges(spark, sf):
    return r6(tags.tag_graph(t.tag_rows(spark, sf), "tags")[1], "weight")


@query(f"WITH {t.TAG_ROWS} SELECT tag_a AS src, tag_b AS dst, round(npmi, 6) AS weight FROM npmi WHERE npmi >= 0.02e0")
def threshold_graph(spark, sf):
    return r6(tags.threshold_graph(tags.npmi_table(t.tag_rows(spark, sf), "tags"), 0.02), "weight")


_TOP = 30


@query(f"""WITH {t.TAG_ROWS}, a AS (SELECT tag, row_number() OVER (ORDER BY n DESC, tag) AS k FROM c),
cell AS (SELECT tag_a AS x, tag_b AS y, n_both AS n FROM p UNION ALL SELECT tag_b, tag_a, n_both FROM p UNION ALL SELECT tag, tag, n FROM c),
f AS (SELECT x.k AS i, y.k AS j, n FROM cell JOIN a x ON x.tag = cell.x JOIN a y ON y.tag = cell.y WHERE x.k <= {_TOP} AND y.k <= {_TOP})
SELECT i AS row, {", ".join(f"CAST(coalesce(sum(n) FILTER (j = {k}), 0) AS BIGINT) AS c{k}" for k in range(1, _TOP + 1))} FROM f GROUP BY i""")
def cooccurrence_matrix(spark, sf):
    rows = t.tag_rows(spark, sf)
    names = [r.tag for r in tags.top_tags(rows, "tags", _TOP).orderBy(F.desc("n"), "tag").collect()]
    m = tags.cooccurrence_matrix(rows, "tags", names)
    index = F.array_position(F.array(*map(F.lit, names)), F.col("tag"))
    cells = [F.col(f"`{names[i]}`") if i < len(names) else F.lit(0).cast("long") for i in range(_TOP)]
    return m.select(index.cast("long").alias("row"), *(c.alias(f"c{i + 1}") for i, c in enumerate(cells)))


@query(f"WITH {t.TAG_ROWS} SELECT count(*) AS n_tags FROM c")
def n_tags(spark, sf):
    return tags.n_tags(t.tag_rows(spark, sf), "tags")


_PRUNED = """v AS (SELECT src AS v, * FROM g UNION ALL SELECT dst, * FROM g),
k AS (SELECT DISTINCT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY weight DESC, src, dst) AS r FROM v) WHERE r <= 8)"""


@query(f"WITH {t.TAG_ROWS}, {_PRUNED} SELECT src, dst, round(weight, 6) AS weight FROM k")
def prune_topk(spark, sf):
    return r6(tags.prune_topk(tags.tag_graph(t.tag_rows(spark, sf), "tags")[1], 8), "weight")


def letter_clusters(spark, sf):
    return tags.tag_counts(t.tag_rows(spark, sf), "tags").select("tag", F.substring("tag", 1, 1).alias("cluster"))


@query(f"""WITH {t.TAG_ROWS} SELECT least(src[1:1], dst[1:1]) AS cluster_a, greatest(src[1:1], dst[1:1]) AS cluster_b, round(avg(weight), 6) AS similarity, count(*) AS n_edges
FROM g WHERE src[1:1] <> dst[1:1] GROUP BY ALL""")
def cluster_pair_similarity(spark, sf):
    return r6(tags.cluster_pair_similarity(tags.tag_graph(t.tag_rows(spark, sf), "tags")[1], letter_clusters(spark, sf)), "similarity")


@query(f"""WITH {t.TAG_ROWS}, m AS (SELECT tag, ascii(tag) AS cluster_id FROM c), k AS (SELECT cluster_id, 'C' || row_number() OVER (ORDER BY count(*) DESC, cluster_id) AS cluster FROM m GROUP BY cluster_id)
SELECT tag, cluster FROM m JOIN k USING (cluster_id)""")
def numbered_clusters(spark, sf):
    return community.number_clusters(tags.tag_counts(t.tag_rows(spark, sf), "tags").select("tag", F.ascii("tag").alias("cluster_id")))


LABELS = {"T1": ["ECONOMY", "SMALL"], "T2": ["LARGE"], "T10": ["PROMO"]}
_LABELLED = f"""WITH {_TYPES}, z AS (SELECT DISTINCT id, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'T1' WHEN p_type = 'LARGE' THEN 'T2' WHEN p_type = 'PROMO' THEN 'T10' ELSE 'T0' END AS l FROM y),
w AS (SELECT id, string_agg(l, ',' ORDER BY l) AS labels FROM z GROUP BY id)"""


@query(f"{_LABELLED} SELECT id, labels FROM w")
def label_assignment(spark, sf):
    return tags.with_labels(type_rows(spark, sf), "types", LABELS).select("id", "labels")


@query(f"{_LABELLED} SELECT labels, count(*) AS n FROM w GROUP BY labels")
def label_counts(spark, sf):
    return tags.label_counts(tags.with_labels(type_rows(spark, sf), "types", LABELS))


@query(f"""WITH {t.TAG_ROWS}, h AS (SELECT unnest([2, 30, 50, 70]) AS min_cooccurrence),
x AS (SELECT h.min_cooccurrence, npmi.* FROM npmi, h WHERE npmi > 0 AND n_both >= h.min_cooccurrence)
SELECT min_cooccurrence, count(*) AS n_edges, round(avg(npmi), 6) AS mean_weight, (SELECT count(DISTINCT tag) FROM (SELECT tag_a AS tag, min_cooccurrence AS m FROM x UNION ALL SELECT tag_b, min_cooccurrence FROM x) WHERE m = x.min_cooccurrence) AS n_nodes FROM x GROUP BY min_cooccurrence""")
def sweep_cooccurrence(spark, sf):
    return r6(tags.sweep_cooccurrence(t.tag_rows(spark, sf), "tags", (2, 30, 50, 70)), "mean_weight")


_SWEEP = "w AS (SELECT l_linenumber AS n_neighbors, CAST(l_quantity AS BIGINT) % 4 AS min_dist, avg(l_quantity * (1 + l_linenumber)) AS trustworthiness FROM lineitem GROUP BY ALL)"


def sweep(spark, sf):
    """Line items in the place of a sweep over two settings."""
    rows = t.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("n_neighbors"), (F.col("l_quantity").cast("long") % 4).alias("min_dist"), (F.col("l_quantity") * (1 + F.col("l_linenumber"))).cast("double").alias("v"))
    return rows.groupBy("n_neighbors", "min_dist").agg(F.avg("v").alias("trustworthiness"))


@query(f"WITH {_SWEEP} SELECT min_dist, {', '.join(f'round(max(trustworthiness) FILTER (n_neighbors = {k}), 6) AS k{k}' for k in range(1, 8))} FROM w GROUP BY min_dist")
def sweep_pivot(spark, sf):
    m = layout.sweep_pivot(sweep(spark, sf))
    return m.select("min_dist", *((F.round(F.col(str(k)), 6) if str(k) in m.columns else F.lit(None).cast("double")).alias(f"k{k}") for k in range(1, 8)))


@query(f"WITH {_SWEEP} SELECT n_neighbors, min_dist, round(trustworthiness, 6) AS trustworthiness FROM w ORDER BY trustworthiness DESC, n_neighbors, min_dist LIMIT 1")
def sweep_best(spark, sf):
    return r6(layout.best_setting(sweep(spark, sf)), "trustworthiness")


# Vectors and graphs


def centred(spark, sf):
    return vectors.center_and_normalize(t.table(spark, sf, "embeddings"))


def neighbours(spark, sf, k=K):
    return knn.nearest(centred(spark, sf), k)


@query(f"WITH {t.VECTORS} SELECT i - 1 AS i, round(m, 6) AS m FROM mm")
def mean_vector(spark, sf):
    return vectors.mean_vector(t.table(spark, sf, "embeddings")).select(F.posexplode("mean").alias("i", "m")).select(F.col("i").cast("long").alias("i"), F.round("m", 6).alias("m"))


@query(f"WITH {t.VECTORS} SELECT vec_id, len(v) AS dim, round(v[1], 6) AS first, round(v[-1], 6) AS last, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e")
def center_normalize(spark, sf):
    df = centred(spark, sf).select(describe(F.col("vec_id"), F.col("embedding")).alias("x"))
    return r6(df.select(F.col("x.id").alias("vec_id"), F.col("x.dim").cast("long").alias("dim"), F.get("x.embedding", 0).alias("first"), F.element_at("x.embedding", -1).alias("last"), F.col("x.norm").alias("norm")), "first", "last", "norm")


@query("""WITH z AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS z FROM z),
p AS (SELECT list_dot_product(a.z, b.z) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT (SELECT count(*) FROM z) AS n, (SELECT max(len(v)) FROM z) AS d, (SELECT bool_or(len(list_filter(v, lambda x: isnan(x))) > 0) FROM z) AS has_nan, (SELECT bool_or(len(list_filter(v, lambda x: isinf(x))) > 0) FROM z) AS has_inf,
  (SELECT bool_or(sqrt(list_dot_product(v, v)) <= 1e-12) FROM z) AS has_zero_norm, round(avg(c), 6) AS cosine_mean, round(stddev_pop(c), 6) AS cosine_std FROM p""")
def embedding_sanity(spark, sf):
    return r6(vectors.embedding_sanity(t.table(spark, sf, "embeddings")).withColumn("d", F.col("d").cast("long")), "cosine_mean", "cosine_std")


_ODD = "CASE vec_id % 100 WHEN 1 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) WHEN 2 THEN list_transform(embedding, lambda x: CAST('nan' AS FLOAT)) WHEN 3 THEN list_transform(embedding, lambda x: CAST('-inf' AS FLOAT)) ELSE embedding END"


@query(f"""WITH z AS (SELECT vec_id, label, CAST({_ODD} AS DOUBLE[]) AS v FROM embeddings)
SELECT label, count(*) AS n, max(len(v)) AS d, bool_or(len(list_filter(v, lambda x: isnan(x))) > 0) AS has_nan, bool_or(len(list_filter(v, lambda x: isinf(x))) > 0) AS has_inf, bool_or(sqrt(list_dot_product(v, v)) <= 1e-12) AS has_zero_norm FROM z GROUP BY label""")
def embedding_flags(spark, sf):
    """The flags of each label, over vectors some of which are zero, not numbers or infinite."""
    v, i = F.col("embedding"), F.col("vec_id") % 100
    fill = F.when(i == 1, 0.0).when(i == 2, float("nan")).when(i == 3, float("-inf")).cast("float")
    df = t.table(spark, sf, "embeddings").withColumn("embedding", F.when(i.isin(1, 2, 3), F.transform(v, lambda x: fill)).otherwise(v))
    out = None
    for label in sorted(r.label for r in df.select("label").distinct().collect()):  # a few labels
        row = vectors.embedding_flags(df.filter(F.col("label") == label)).select(F.lit(label).alias("label"), "n", F.col("d").cast("long").alias("d"), "has_nan", "has_inf", "has_zero_norm")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {t.knn_sql(K)} SELECT src, dst, rank, round(similarity, 6) AS similarity FROM knn")
def knn_directed(spark, sf):
    return r6(neighbours(spark, sf), "similarity")


def symmetric(mode):
    return lambda spark, sf: r6(knn.symmetrize(knn.directed_affinity(neighbours(spark, sf)), mode), "weight")


for _mode, _value in (("max", "max(weight)"), ("min", "CASE WHEN count(*) > 1 THEN min(weight) ELSE 0 END"), ("mean", "sum(CAST(weight AS DOUBLE)) * 0.5e0")):
    _QUERIES[f"knn_symmetric_{_mode}"] = symmetric(_mode)
    _SQL[f"knn_symmetric_{_mode}"] = f"WITH {t.knn_sql(K)}, q AS (SELECT src, dst, CAST({_value} AS FLOAT) AS weight FROM u GROUP BY ALL) SELECT src, dst, round(CAST(weight AS DOUBLE), 6) AS weight FROM q WHERE weight <> 0"


@query(f"WITH {t.knn_sql(K)} SELECT round(avg(CASE WHEN b.src IS NULL THEN 0e0 ELSE 1e0 END), 6) AS reciprocity FROM d a LEFT JOIN d b ON a.src = b.dst AND a.dst = b.src")
def knn_reciprocity(spark, sf):
    return r6(knn.reciprocity(knn.directed_affinity(neighbours(spark, sf))), "reciprocity")


def membership(spark, sf):
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community"))


_MODULARITY = """l AS (SELECT a.label AS la, b.label AS lb, CAST(weight AS DOUBLE) AS w FROM sym JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst),
by_label AS (SELECT la, sum(CASE WHEN la = lb THEN w ELSE 0 END) AS inside, sum(w) AS k FROM l GROUP BY la),
q AS (SELECT round(sum(inside / w - (k / w) * (k / w)), 6) AS modularity FROM by_label, (SELECT sum(k) AS w FROM by_label))"""
_COMPONENTS = "r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT sym.dst, r.root FROM r JOIN sym ON sym.src = r.id), comp AS (SELECT id AS node, min(root) AS component FROM r GROUP BY id)"


@query(f"""WITH RECURSIVE {t.knn_sql(K)}, {_MODULARITY}, {_COMPONENTS}
SELECT (SELECT count(*) FROM embeddings) AS n_nodes, (SELECT count(*) // 2 FROM sym) AS n_edges, (SELECT count(DISTINCT component) FROM comp) AS n_components, modularity, (SELECT count(DISTINCT label) FROM embeddings) AS n_communities,
(SELECT string_agg(n, ',' ORDER BY label) FROM (SELECT label, CAST(count(*) AS VARCHAR) AS n FROM embeddings GROUP BY label)) AS community_sizes,
round((SELECT count(*) FROM sym) / (SELECT count(*) FROM embeddings), 6) AS mean_degree FROM q""")
def graph_quality(spark, sf):
    edges = knn.directed_affinity(neighbours(spark, sf))
    row = graph.graph_quality(edges, membership(spark, sf)).withColumn("community_sizes", F.array_join("community_sizes", ","))
    return r6(row, "modularity", "mean_degree")


@query(f"""WITH {t.knn_sql(K)}, {_MODULARITY}, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS n_nodes, count(*) AS n_communities, min(n) AS size_min, max(n) AS size_max, round(avg(n), 6) AS size_mean, round(median(n), 6) AS size_median, (SELECT modularity FROM q) AS modularity FROM sizes""")
def community_diagnostics(spark, sf):
    edges = knn.symmetrize(knn.directed_affinity(neighbours(spark, sf)))
    return r6(community.leiden_diagnostics(edges, membership(spark, sf)), "size_mean", "size_median", "modularity")


_LOOPS = "SELECT l_linenumber AS src, l_suppkey % 8 AS dst, avg(l_quantity) - 25 AS weight FROM lineitem GROUP BY ALL"


@query(f"SELECT round(sum(abs(weight)), 6) AS diagonal_abs_sum FROM ({_LOOPS}) WHERE src = dst")
def diagonal_sum(spark, sf):
    e = t.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("src"), (F.col("l_suppkey") % 8).alias("dst")).agg((F.avg(F.col("l_quantity").cast("double")) - 25).alias("weight"))
    return r6(knn.diagonal_abs_sum(e), "diagonal_abs_sum")


@query(f"WITH {t.TAG_ROWS}, h AS (SELECT tag FROM c WHERE length(tag) % 2 = 0) SELECT src, dst, round(weight, 6) AS weight FROM g WHERE src IN (FROM h) AND dst IN (FROM h)")
def induced_subgraph(spark, sf):
    nodes, edges = tags.tag_graph(t.tag_rows(spark, sf), "tags")
    names = tags.tag_counts(t.tag_rows(spark, sf), "tags").filter(F.length("tag") % 2 == 0).select(F.col("tag").alias("node"))
    return r6(graph.induced(edges, names), "weight")


@query(f"WITH {t.knn_sql(K)} SELECT count(*) AS n, count(*) AS n_valid, min(len(v)) AS dim FROM e WHERE len(list_filter(v, lambda x: NOT isfinite(x))) = 0")
def vector_check(spark, sf):
    df = centred(spark, sf)
    n = vectors.check_vectors(df, K)
    return df.agg(F.lit(n).cast("long").alias("n"), F.count("*").alias("n_valid"), F.min(F.size("embedding")).cast("long").alias("dim"))


@query(f"WITH {t.knn_sql(K)}, {_MODULARITY} SELECT modularity FROM q")
def modularity_by_label(spark, sf):
    return r6(graph.modularity(knn.symmetrize(knn.directed_affinity(neighbours(spark, sf))), membership(spark, sf)), "modularity")


@query(f"WITH RECURSIVE {t.knn_sql(1)}, {_COMPONENTS} SELECT node, component FROM comp")
def connected_components(spark, sf):
    edges = knn.symmetrize(knn.directed_affinity(neighbours(spark, sf, 1)))
    return graph.connected_components(membership(spark, sf).select("node"), edges)


def tag_network(spark, sf):
    nodes, edges = tags.tag_graph(t.tag_rows(spark, sf), "tags")
    both = edges.union(edges.select("dst", "src", "weight"))
    return nodes.select(F.col("name").alias("node")), both


_DEGREES = "gg AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), deg AS (SELECT c.tag AS node, count(gg.dst) AS degree FROM c LEFT JOIN gg ON gg.src = c.tag GROUP BY ALL)"


@query(f"WITH {t.TAG_ROWS}, {_DEGREES}, n AS (SELECT count(*) AS n FROM deg), m AS (SELECT count(*) AS z FROM gg) SELECT n AS n_nodes, z // 2 AS n_edges, round(z / (n * (n - 1e0)), 6) AS density, round(1 - z / (n * CAST(n AS DOUBLE)), 6) AS sparsity FROM n, m")
def graph_density(spark, sf):
    return r6(graph.density(*tag_network(spark, sf)), "density", "sparsity")


@query(f"""WITH {t.TAG_ROWS}, {_DEGREES}, tri AS (SELECT x.src AS node, count(*) AS t2 FROM gg x JOIN gg y ON x.src = y.src JOIN gg z ON z.src = x.dst AND z.dst = y.dst GROUP BY ALL)
SELECT round(avg(CASE WHEN degree > 1 THEN coalesce(t2, 0) / (degree * (degree - 1e0)) ELSE 0 END), 6) AS clustering FROM deg LEFT JOIN tri USING (node)""")
def clustering_coefficient(spark, sf):
    return r6(graph.clustering_coefficient(*tag_network(spark, sf)), "clustering")


@query(f"""WITH {t.TAG_ROWS}, {_DEGREES}, x AS (SELECT min(degree) AS low, max(degree) AS high FROM deg)
SELECT CASE WHEN high > low THEN least(19, CAST(floor((degree - low) * 20e0 / (high - low)) AS BIGINT)) ELSE 0 END AS bin, count(*) AS n FROM deg, x GROUP BY ALL""")
def degree_histogram(spark, sf):
    return graph.degree_histogram(*tag_network(spark, sf))


# Quality


@query("""WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT count(*) AS n_clusters, array_to_string(list(n ORDER BY label), ',') AS sizes, round(stddev_pop(n) / avg(n), 6) AS size_balance FROM s""")
def cluster_sizes_balance(spark, sf):
    q = quality.cluster_quality(t.table(spark, sf, "embeddings"))
    return r6(q.select("n_clusters", F.array_join("sizes", ",").alias("sizes"), "size_balance"), "size_balance")


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT i, li, lj, avg(d) AS d FROM d GROUP BY ALL),
s AS (SELECT i, min(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM m GROUP BY i)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s""")
def silhouette(spark, sf):
    return r6(quality.cluster_quality(t.table(spark, sf, "embeddings")).select("silhouette"), "silhouette")


@query("""WITH m AS (SELECT user_id AS label, event_type AS tag, value / 50e0 - 1e0 AS a, (event_id % 201) / 100e0 - 1e0 AS v FROM events),
w AS (SELECT label, tag, count(*) AS c FROM m GROUP BY ALL), p AS (SELECT label, c / sum(c) OVER (PARTITION BY label) AS p FROM w),
h AS (SELECT label, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS entropy FROM p GROUP BY label),
x AS (SELECT *, avg(a) OVER (PARTITION BY label) AS ca, avg(v) OVER (PARTITION BY label) AS cv FROM m),
y AS (SELECT label, count(*) AS n, stddev_pop(sqrt((a - ca) * (a - ca) + (v - cv) * (v - cv))) AS va_spread,
  count(DISTINCT CASE WHEN a >= 0 AND v >= 0 THEN 1 WHEN a >= 0 THEN 2 WHEN v < 0 THEN 3 ELSE 4 END) / 4 AS coverage FROM x GROUP BY label)
SELECT label, n, round(entropy, 6) AS entropy, round(va_spread, 6) AS va_spread, round(coverage, 6) AS coverage FROM y JOIN h USING (label)""")
def semantic_quality(spark, sf):
    return r6(quality.label_coherence(t.moods(spark, sf), "label", "tags"), "entropy", "va_spread", "coverage")


@query("SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS {s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")) + ", count(*) AS size FROM customer GROUP BY c_nationkey")
def community_crosstab(spark, sf):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]
    x = quality.community_crosstab(t.table(spark, sf, "customer"), "c_nationkey", "c_mktsegment", names)
    return x.select("c_nationkey", *(F.col(n).alias(n.lower()) for n in names), "size")


@query("SELECT c_nationkey, c_mktsegment, least(count(*), 5) AS n FROM customer GROUP BY ALL")
def stratified_sample(spark, sf):
    s = quality.stratified_sample(t.table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 5, "c_custkey")
    return s.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


_INDEX = t.VECTORS + """,
ix AS (SELECT vec_id, label, CAST(CAST(v AS FLOAT[]) AS DOUBLE[]) AS v FROM e), mf AS (SELECT CAST(CAST(mean AS FLOAT[]) AS DOUBLE[]) AS mean FROM mv),
q0 AS (SELECT vec_id AS q, list_transform(list_zip(CAST(embedding AS DOUBLE[]), mean), lambda z: z[1] - z[2]) AS v FROM embeddings, mf),
q1 AS (SELECT q, CAST(CAST(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS FLOAT[]) AS DOUBLE[]) AS v FROM q0)"""


@query(f"WITH {_INDEX}, s AS (SELECT vec_id, list_dot_product(ix.v, q1.v) AS score, label FROM ix, q1 WHERE q = 0 ORDER BY score DESC, vec_id LIMIT 10) SELECT vec_id, round(score, 5) AS score, CAST(label AS VARCHAR) AS label FROM s")
def retrieve_topk(spark, sf):
    base = t.table(spark, sf, "embeddings")
    index, mean = retrieval.build_index(base, "vec_id")
    q = retrieval.prepare_query(base.filter("vec_id = 0").select("vec_id", "embedding"), mean).first().embedding
    found = retrieval.retrieve(index, q, 10, "vec_id")
    return retrieval.with_metadata(found, base.select("vec_id", "label"), "vec_id", ["label"]).withColumn("score", F.round("score", 5))


@query("SELECT count(*) AS n, count(*) AS n_self FROM embeddings")
def self_retrieval(spark, sf):
    base = t.table(spark, sf, "embeddings")
    index, mean = retrieval.build_index(base, "vec_id")
    q = retrieval.prepare_query(base.select((-1 - F.col("vec_id")).alias("vec_id"), "embedding"), mean)
    best = knn.nearest(index, 1, queries=q)
    return best.agg(F.count("*").alias("n"), F.sum(((F.col("dst") == -1 - F.col("src")) & (F.abs(F.col("similarity") - 1) < 1e-6)).cast("long")).alias("n_self"))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, lang FROM documents d WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def aligned_metadata(spark, sf):
    meta = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("vec_id"), "lang")
    return retrieval.align(t.table(spark, sf, "embeddings"), meta, "vec_id").withColumnRenamed("vec_id", "doc_id")


@query("""SELECT d.doc_id, lang, coalesce(label, -1) AS community, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y FROM documents d LEFT JOIN embeddings ON vec_id = doc_id""")
def communities_on_metadata(spark, sf):
    where = projected(spark, sf).select("node", F.get("low", 0).alias("x"), F.get("low", 1).alias("y"))
    out = retrieval.place(t.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", membership(spark, sf), where)
    return r6(out.withColumn("community", F.coalesce("community", F.lit(-1))), "x", "y")


def projected(spark, sf):
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("high"), F.slice("embedding", 1, 2).alias("low"))


_PAIRS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS high, sqrt((a.v[1] - b.v[1]) * (a.v[1] - b.v[1]) + (a.v[2] - b.v[2]) * (a.v[2] - b.v[2])) AS low FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""


@query(f"""WITH {_PAIRS}, n AS (SELECT count(*) AS n FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY high, j) AS rh, row_number() OVER (PARTITION BY i ORDER BY low, j) AS rl FROM p),
x AS (SELECT sum(CASE WHEN rl <= 15 AND rh > 15 THEN rh - 15 ELSE 0 END) AS t, sum(CASE WHEN rh <= 15 AND rl > 15 THEN rl - 15 ELSE 0 END) AS c FROM r)
SELECT n, CAST(15 AS BIGINT) AS k, round(1 - 2e0 * t / (n * 15 * (2 * n - 46)), 6) AS trustworthiness, round(1 - 2e0 * c / (n * 15 * (2 * n - 46)), 6) AS continuity FROM x, n""")
def projection_quality(spark, sf):
    return r6(quality.trustworthiness_continuity(projected(spark, sf), subsample_n=None), "trustworthiness", "continuity")


@query(f"""WITH {_PAIRS}, r AS (SELECT rank() OVER (ORDER BY high) + (count(*) OVER (PARTITION BY high) - 1) / 2e0 AS a, rank() OVER (ORDER BY low) + (count(*) OVER (PARTITION BY low) - 1) / 2e0 AS b FROM p WHERE i < j)
SELECT round(corr(a, b), 6) AS spearman FROM r""")
def shepard(spark, sf):
    return r6(quality.shepard(projected(spark, sf), n_pairs=None), "spearman")


@query(f"""WITH {_PAIRS}, r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY high, j) AS rh, row_number() OVER (PARTITION BY i ORDER BY low, j) AS rl
  FROM (SELECT a.vec_id AS i, b.vec_id AS j, -list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS high,
    -list_dot_product(a.v[1:8], b.v[1:8]) / sqrt(list_dot_product(a.v[1:8], a.v[1:8]) * list_dot_product(b.v[1:8], b.v[1:8])) AS low FROM e a JOIN e b ON a.vec_id <> b.vec_id))
SELECT i AS src, j AS dst FROM r WHERE rl <= 15 AND rh > 15""")
def neighbours_lost(spark, sf):
    """Neighbours by the first eight dimensions that aren't neighbours by all."""
    df = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("high"), F.slice("embedding", 1, 8).alias("low"))
    return quality.neighbour_overlap(df, K, "vec_id", "high", "low")


@query("""WITH l AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT count(*) AS n, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, round(avg(sqrt(x * x + y * y)), 6) AS norm_mean, round(stddev_pop(sqrt(x * x + y * y)), 6) AS norm_std FROM l""")
def layout_diagnostics(spark, sf):
    df = projected(spark, sf).select(F.get("low", 0).alias("x"), F.get("low", 1).alias("y"))
    return r6(quality.layout_diagnostics(df), "x_min", "x_max", "y_min", "y_max", "norm_mean", "norm_std")


@query("""WITH v AS (SELECT vec_id, list_transform(CAST(embedding[1:12] AS DOUBLE[]), lambda x: abs(x)) AS v FROM embeddings), s AS (SELECT *, list_sum(v) AS t FROM v)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: -greatest(least(x / t, 1e0), 1e-12) * log2(greatest(least(x / t, 1e0), 1e-12)))), 6) AS entropy,
round((v[1] + v[3] + v[5] + v[6] + v[8] + v[10] + v[12]) / t, 6) AS major, round((v[1] + v[3] + v[4] + v[6] + v[8] + v[9] + v[11]) / t, 6) AS minor FROM s""")
def entropy_alignment(spark, sf):
    v = t.table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x).cast("double")).alias("v"))
    return r6(v.select("vec_id", entropy_bits(F.col("v")).alias("entropy"), scale_alignment(F.col("v"), MAJOR).alias("major"), scale_alignment(F.col("v"), MINOR).alias("minor")), "entropy", "major", "minor")


@query("""WITH k AS (SELECT vec_id, vec_id % 13 AS i, vec_id % 2 AS m FROM embeddings)
SELECT vec_id, round(cos(CASE WHEN i = 12 THEN 0 ELSE i END / 12e0 * 2 * pi()), 6) AS key_cos, round(sin(CASE WHEN i = 12 THEN 0 ELSE i END / 12e0 * 2 * pi()), 6) AS key_sin, CASE WHEN m = 1 THEN 1e0 ELSE 0e0 END AS is_minor FROM k""")
def key_encoding(spark, sf):
    names = F.array(*map(F.lit, ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B", "Bb"]))
    k = t.table(spark, sf, "embeddings").select("vec_id", F.get(names, (F.col("vec_id") % 13).cast("int")).alias("key"), F.when(F.col("vec_id") % 2 == 1, "minor").otherwise("major").alias("scale"))
    return r6(k.select("vec_id", encode_key(F.col("key"), F.col("scale")).alias("x")).select("vec_id", "x.*"), "key_cos", "key_sin")


@query("""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, """ + ", ".join(f"round(CAST((length(t) - length(replace(t, '{c}', ''))) / greatest(length(t), 1) AS FLOAT), 5) AS {n}" for n, c in zip(("a", "e", "i", "o", "u", "blank"), "aeiou ")) + " FROM x")
def text_embeddings(spark, sf):
    made = embedding.extract_text(t.table(spark, sf, "documents"), embedding.LetterShares, batch_size=64)
    return made.select("doc_id", *(F.round(F.get("embedding", k), 5).alias(n) for k, n in enumerate(("a", "e", "i", "o", "u", "blank"))))


@query("""WITH f(track_id, tones) AS (VALUES ('a3', [220e0]), ('a4', [440e0]), ('mixed', [220e0, 440e0, 880e0])),
y AS (SELECT track_id, CAST(list_avg(list_transform(tones, lambda h: sin(2 * pi() * h * i / 44100e0))) AS FLOAT) AS y FROM f, range(0, 88200) AS r(i))
SELECT track_id, round(sqrt(avg(CAST(y AS DOUBLE) * y)), 4) AS rms, round(abs(avg(y)), 4) AS mean, round(max(abs(CAST(y AS DOUBLE))), 4) AS peak, round(avg(abs(y)), 4) AS level FROM y GROUP BY track_id""")
def audio_embeddings(spark, sf):
    tracks = audio.synthetic_tracks(spark, {"a3": [220.0], "a4": [440.0], "mixed": [220.0, 440.0, 880.0]}).withColumnRenamed("song_id", "track_id")
    made = embedding.extract_audio(tracks, embedding.SignalShape)
    names = ("rms", "mean", "peak", "level")
    return made.select("track_id", *(F.round(F.abs(F.get("embedding", k).cast("double")), 4).alias(n) for k, n in enumerate(names)))


# Seeded and numeric operators without SQL


@query()
def leiden_communities(spark, sf):
    edges = knn.symmetrize(knn.directed_affinity(neighbours(spark, sf)))
    return community.leiden(membership(spark, sf).select("node"), edges)


@query()
def tag_clusters_merged(spark, sf):
    nodes, edges = tags.tag_graph(t.tag_rows(spark, sf), "tags")
    pruned = tags.prune_topk(edges, 8)
    return community.merge_cluster_table(pruned, community.cluster_tags(nodes, pruned, seed=42), target_k=3)


@query()
def sweep_clusters(spark, sf):
    swept = community.sweep_clusters(t.tag_rows(spark, sf), "tags", (2, 30, 50, 70), 3)
    return swept.withColumn("top_sizes", F.array_join("top_sizes", ","))


@query()
def layout_sweep(spark, sf):
    return layout.sweep_layout(t.table(spark, sf, "embeddings"), (10, 15), (0.1, 0.5))


@query()
def umap_layout(spark, sf):
    return layout.umap_layout(t.table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query()
def audio_features(spark, sf):
    return audio.extract_features(audio.synthetic_tracks(spark, {"a3": [220.0], "a4": [440.0], "mixed": [220.0, 440.0, 880.0]}))
