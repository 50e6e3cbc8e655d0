import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorscape.operators import community, graph, knn, layout, quality, retrieval, tags, vectors


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight float")


FIVE = [(1, 2, 0.5), (2, 1, 0.3), (1, 3, 0.7), (3, 4, 0.2), (4, 3, 0.2)]


@pytest.mark.parametrize(("mode", "expected"), [("max", {(1, 2): 0.5, (1, 3): 0.7, (3, 4): 0.2}), ("min", {(1, 2): 0.3, (3, 4): 0.2}), ("mean", {(1, 2): 0.4, (1, 3): 0.35, (3, 4): 0.2})])
def test_symmetrize(spark, mode, expected):
    got = {(r.src, r.dst): round(float(r.weight), 6) for r in knn.symmetrize(edges(spark, FIVE), mode).collect()}
    assert {k: v for k, v in got.items() if k[0] < k[1]} == expected
    assert all(got[b, a] == v for (a, b), v in got.items())


def test_symmetrize_rejects(spark):
    with pytest.raises(ValueError):
        knn.symmetrize(edges(spark, FIVE), "sum")


def test_reciprocity(spark):
    assert knn.reciprocity(edges(spark, FIVE)).first()[0] == 0.8
    assert knn.reciprocity(edges(spark, [])).first()[0] == 0.0


def test_prune(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.1)], "src string, dst string, weight double")
    assert {(r.src, r.dst) for r in tags.prune_topk(e, 1).collect()} == {("a", "b"), ("a", "c")}


def test_blocked_neighbours_equal_expressions(spark):
    x = np.random.default_rng(0).normal(size=(60, 5)).tolist()
    x[7] = x[3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {(r.src, r.dst): r.rank for r in knn.nearest_by_expression(df, 4).collect()}
    for size in (1 << 20, 700):
        assert {(r.src, r.dst): r.rank for r in knn.nearest(df, 4, block_bytes=size).collect()} == want
    with pytest.raises(ValueError):
        knn.nearest(df, 60)


def test_merge():
    e = [("a", "b", 0.9), ("c", "d", 0.8), ("b", "c", 0.4), ("e", "f", 0.7), ("d", "e", 0.2)]
    three = {"C1": ["a", "b"], "C2": ["c", "d"], "C3": ["e", "f"]}
    assert community.merge_clusters(e, three, 2) == {"T1": ["a", "b", "c", "d"], "T2": ["e", "f"]}
    assert community.merge_clusters(e, three, 3) is three
    assert community.merge_clusters([("a", "b", 0.9)], {"C1": ["a", "b"], "C2": ["c"]}, 1) == {"T1": ["a", "b", "c"]}


def test_leiden_finds_cliques(spark):
    rows = [(a + 10 * g, b + 10 * g, 1.0) for g in range(3) for a in range(5) for b in range(5) if a != b]
    rows += [(0, 10, 0.1), (10, 0, 0.1)]
    e = edges(spark, rows)
    nodes = e.select(F.col("src").alias("node")).distinct().union(spark.createDataFrame([(99,)], "node long"))
    found = {r.node: r.community for r in community.leiden(nodes, e).collect()}
    assert len({found[a + 10 * g] for g in range(3) for a in range(5)}) == 3
    assert all(len({found[a + 10 * g] for a in range(5)}) == 1 for g in range(3)) and found[99] == 3
    q = graph.modularity(e, community.leiden(nodes, e)).first()[0]
    assert 0.5 < q <= 1
    with pytest.raises(ValueError):
        community.leiden(nodes, edges(spark, [(1, 2, 1.0)]))


def test_components_and_quality(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0), (5, 6, 1.0), (6, 5, 1.0)])
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "node long")
    assert {r.node: r.component for r in graph.connected_components(nodes, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    one = spark.createDataFrame([(1, 0)], "node long, community long")
    assert tuple(graph.graph_quality(edges(spark, []), one).first())[1:] == (0, 0, 0.0, 0, [], 0.0)


def test_quality_corners(spark):
    df = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(4)], "vec_id long, label int, embedding array<double>")
    assert np.isnan(quality.silhouette(df))
    both = df.select(F.col("vec_id").alias("node"), F.col("embedding").alias("high"), F.col("embedding").alias("low"))
    assert tuple(quality.projection_quality(both, k=4).first())[2:] == (0.0, 0.0, 0.0)
    rows = [("x", ["a"], 0.1, 0.1), ("x", ["a"], 0.1, 0.1), ("y", ["a", "b"], 0.3, -0.5), ("z", [], 0.0, 0.0)]
    c = {r.label: r for r in quality.label_coherence(spark.createDataFrame(rows, "label string, tags array<string>, arousal double, valence double"), "label", "tags").collect()}
    assert (c["x"].entropy, c["y"].entropy, c["z"].entropy, c["z"].va_spread) == (0.0, pytest.approx(1.0), 0.0, 0.0)


def test_isometry_is_trusted(spark):
    x = np.random.default_rng(1).normal(size=(30, 2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), v.tolist()) for i, v in enumerate(x)], "node long, high array<double>, low array<double>")
    r = quality.projection_quality(df, k=5).first()
    assert (r.trustworthiness, r.continuity, r.spearman) == (1.0, 1.0, pytest.approx(1.0))


def test_retrieval_corners(spark):
    df = spark.createDataFrame([(str(i), [float(i == j) for j in range(3)]) for i in range(3)], "track_id string, embedding array<double>")
    index, _ = retrieval.build_index(df)
    assert [r.track_id for r in retrieval.retrieve(index, [1.0, 0.0, 0.0], 9).collect()][0] == "0"
    with pytest.raises(ValueError):
        retrieval.retrieve(index, [1.0], 0)
    same = spark.createDataFrame([("a", [1.0, 2.0])] * 2, "track_id string, embedding array<double>")
    with pytest.raises(Exception, match="norm 0"):
        vectors.center_and_normalize(same).collect()


def test_layout_validation(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    for how in ({"metric": "euclidean"}, {"n_neighbors": 5}, {"min_dist": 2.0}):
        with pytest.raises(ValueError):
            layout.umap_layout(df, **({"n_neighbors": 3} | how))


def test_affinity_checks(spark):
    ok = edges(spark, [(1, 2, 1.0), (2, 1, 1.0)])
    assert graph.validate_affinity(ok) == [] and graph.validate_affinity(edges(spark, [(1, 2, 0.0), (2, 1, 0.0)])) == ["the least weight is 0"]
    for bad in ([], [(1, 2, float("nan")), (2, 1, 1.0)], [(1, 2, -1.0), (2, 1, -1.0)], [(1, 1, 1.0)], [(1, 2, 1.0)]):
        with pytest.raises(ValueError):
            graph.validate_affinity(edges(spark, bad))


def test_edge_bound_holds_for_tags(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert community.cluster_tags(nodes, e, seed=1).count() == 3
    both = e.union(e.select("dst", "src", "weight"))
    with pytest.raises(ValueError, match="prune"):
        community.leiden(nodes.withColumnRenamed("name", "node"), both, validate=False, max_edges=3)


def test_layout_checks_and_norms(spark):
    df = spark.createDataFrame([(i, [float(10**i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert layout.validate_layout(df, 2, 0.1, "cosine")[0].startswith("norms differ") and layout.validate_layout(df.filter("vec_id < 3").limit(3), 2, 0.1, "cosine")
    with pytest.raises(ValueError, match="norm 0"):
        layout.validate_layout(df.union(spark.createDataFrame([(9, [0.0, 0.0])], df.schema)), 2, 0.1, "cosine")


def test_sampled_quality(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist(), v[:2].tolist()) for i, v in enumerate(x)], "node long, high array<double>, low array<double>")
    a, b = (quality.projection_quality(df, 4, subsample_n=n).first() for n in (None, 100))
    assert tuple(a) == pytest.approx(tuple(b)) and -1 <= a.spearman <= 1
    assert quality.projection_quality(df, 4, subsample_n=20).first().n == 20
    drawn = quality.pair_distances(df, "node", "high", "low", 70).collect()
    assert len(drawn) == 70 and all(r.i != r.j for r in drawn)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 100)
    with pytest.raises(ValueError, match="subsample_n"):
        quality.projection_quality(df, 4)


def test_average_ranks(spark):
    r = np.random.default_rng(6)
    a, b = r.integers(0, 12, 200).astype(float), r.integers(0, 30, 200).astype(float)
    rank = [[(x > y).sum() + ((x == y).sum() + 1) / 2 for x in c for y in [c]] for c in (a, b)]
    rank = [np.array([((c < x).sum() + ((c == x).sum() + 1) / 2) for x in c]) for c in (a, b)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = quality.average_rank(df, "a", "r").collect()
    assert sorted((x.a, x.r) for x in got) == sorted(zip(a.tolist(), rank[0].tolist()))
    assert quality.spearman(df, "a", "b").first()[0] == pytest.approx(np.corrcoef(*rank)[0, 1])
    assert quality.spearman(df.select("a", F.lit(1.0).alias("b")), "a", "b").first()[0] == 0.0


def test_moments_and_drawn_pairs(spark):
    x = np.random.default_rng(7).normal(size=(50, 4))
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    rows = np.array([r.row for r in sorted(vectors.moments(df).collect(), key=lambda r: r.i)])
    assert np.allclose(rows[:, :4], x.T @ x) and np.allclose(rows[:, 4], x.sum(0)) and (rows[:, 5] == 50).all()
    assert sorted((r.k, r.at) for r in vectors.numbered(df, "vec_id").collect()) == [(i * 3, i) for i in range(50)]
    r = vectors.embedding_sanity(df, key="vec_id", n_pairs=10_000).first()
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    all_ = (z @ z.T)[np.triu_indices(50, 1)]
    exact = vectors.embedding_sanity(df).first()
    assert exact.cosine_mean == pytest.approx(all_.mean()) and exact.cosine_std == pytest.approx(all_.std())
    assert r.cosine_mean == pytest.approx(all_.mean(), abs=0.1) and r.cosine_std == pytest.approx(all_.std(), abs=0.1)
    one = vectors.embedding_sanity(df.limit(1)).first()
    assert (one.n, one.cosine_mean, one.cosine_std) == (1, 0.0, 0.0)
    with pytest.raises(Exception, match="dimension"):
        vectors.moments(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>").coalesce(1)).collect()


def test_sweeps(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["c", "d"]) for i in range(20)] + [(90 + i, ["a", "d"]) for i in range(2)] + [(99, ["e"])] * 6
    df = spark.createDataFrame(rows, "id long, tags array<string>")
    got = {r.min_cooccurrence: r for r in community.sweep_clusters(df, "tags", (2, 5)).collect()}
    for r in got.values():
        assert r.n_nodes == 5 and sum(r.top_sizes) == r.n_nodes and r.largest == r.top_sizes[0] and r.top_sizes == sorted(r.top_sizes, reverse=True) and len(r.top_sizes) == r.n_clusters
    assert got[5].n_edges == 2 and got[5].n_clusters == 3 and got[5].modularity == pytest.approx(0.5)
    s = spark.createDataFrame([(5, 0.1, 0.5), (5, 0.2, 0.9), (9, 0.1, 0.9), (9, 0.2, None)], "n_neighbors long, min_dist double, trustworthiness double")
    assert {r.min_dist: (r["5"], r["9"]) for r in layout.sweep_pivot(s).collect()} == {0.1: (0.5, 0.9), 0.2: (0.9, None)}
    assert tuple(layout.best_setting(s).first()) == (5, 0.2, 0.9)


def test_metadata_of_results(spark):
    found = spark.createDataFrame([("a", 1.0), ("z", 0.5)], "id string, score double")
    meta = spark.createDataFrame([("a", "first", 1), ("a", "second", 2), ("b", "x", 1)], "id string, title string, at int")
    assert {r.id: r.title for r in retrieval.with_metadata(found, meta, "id", ["title"], "at").collect()} == {"a": "second", "z": "?"}
    assert {r.id for r in retrieval.align(found, meta, "id").collect()} == {"a"}
    assert {r.c for r in retrieval.place(meta.select("id").distinct(), "id", spark.createDataFrame([("a", 7)], "node string, c int")).collect()} == {7, None}


def test_layout_keeps_groups(spark):
    """Three groups of directions: the layout is trusted, and rows stay nearer to their own group."""
    r = np.random.default_rng(11)
    x = np.repeat(np.eye(3, 8), 20, axis=0) + 0.05 * r.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    made = layout.umap_layout(df, 8, epochs=100)
    q = layout.layout_quality(df, made, 8).first()
    assert q.n == 60 and q.trustworthiness > 0.8
    y = np.array([(p.x, p.y) for p in sorted(made.collect(), key=lambda p: p.node)])
    far = np.linalg.norm(y[:, None] - y[None], axis=2)
    own = np.repeat(np.arange(3), 20)
    assert far[own[:, None] == own].mean() < 0.5 * far[own[:, None] != own].mean()
    both = df.select(F.col("vec_id").alias("node"))
    assert [p.node for p in quality.subsample(both, "node", 7).collect()] == [p.node for p in quality.subsample(made, "node", 7).collect()]


def test_approximate_neighbours(spark, sf):
    """Recall of at least 0.9 against the exact neighbours; exact with all cells; hot cells in blocks change nothing."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r.src, r.dst) for r in knn.nearest(df, 10).collect()}
    near = {(r.src, r.dst) for r in knn.approximate_nearest(df, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    for rows in (50_000, 7):
        assert {(r.src, r.dst) for r in knn.approximate_nearest(df, 10, cells=9, probes=9, cell_rows=rows).collect()} == exact


def test_all_pairs_are_ranked_without_a_table_of_them(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, steps = rng.normal(size=(300, 8)), rng.integers(1, 4, size=(300, 3)).astype(float)
    frame = lambda rows: spark.createDataFrame([(i, v.tolist(), v[:2].tolist()) for i, v in enumerate(rows)], "node long, high array<double>, low array<double>")
    exact = quality.shepard(frame(x), n_pairs=None).first()[0]
    monkeypatch.setattr(quality, "STORED_PAIRS", 10_000)
    monkeypatch.setattr(quality, "BINS", 1 << 18)
    for rows in (x, steps):  # different distances, and many equal ones
        _, high, low = quality.both_spaces(frame(rows), "node", "high", "low")
        i, j = np.triu_indices(len(rows), 1)
        ranks = []
        for d in (1 - (high[i] * high[j]).sum(1), np.sqrt(((low[i] - low[j]) ** 2).sum(1))):
            _, at, count = np.unique(d.round(13), return_inverse=True, return_counts=True)
            ranks.append((np.cumsum(count) - (count - 1) / 2)[at])
        rho, error = quality.binned_spearman(spark, high, low)
        assert error < 1e-4 and rho == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=min(error + 1e-12, 1e-6))
    with monkeypatch.context() as m:
        m.setattr(quality, "RHO_ERROR", 1e-4)  # for so few pairs and bins
        m.setattr(quality, "_pairs", lambda *_: pytest.fail("pairs are stored"))
        assert quality.shepard(frame(x), n_pairs=None).first()[0] == pytest.approx(exact, abs=1e-6)
        assert quality.shepard(frame(np.ones((200, 2))), n_pairs=None).first()[0] == 0.0
    assert quality.shepard(frame(x), n_pairs=None).first()[0] == pytest.approx(exact, abs=1e-12)  # not proven: the pairs are stored after all
