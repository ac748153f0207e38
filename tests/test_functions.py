import math

import fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import aggregates, kernels, scalar, scaling
from lamina.operators import embedding, similarity, sparse, walks
from lamina.settings import WalkSettings


def matrix(spark, rows):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(rows) for j, v in enumerate(row) if v], "row_id long, col_id long, value double")


def dense(df, n, value="value"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["row_id"], r["col_id"]] = r[value]
    return out


@pytest.mark.parametrize("q", sorted(fixtures.QUANTILES))
def test_quantiles(spark, q):
    df = spark.createDataFrame([(x,) for x in fixtures.QUANTILE_VALUES], "x double")
    middle, ignoring, linear = fixtures.QUANTILES[q]
    assert aggregates.quantile(df, "x", q).first()[0] == pytest.approx(middle)
    assert aggregates.quantile(df, "x", q, ignore=(-1.0,)).first()[0] == pytest.approx(ignoring)
    assert aggregates.quantile(df, "x", q, "linear").first()[0] == pytest.approx(linear)


def test_pixel_neighbours_in_order(spark):
    p = spark.range(24).withColumnRenamed("id", "point_id")
    near = lambda kind, i: [r["neighbor_id"] for r in scalar.pixel_neighbors(p, 6, 4, kind).where(F.col("point_id") == i).orderBy("ord").collect()]
    assert near("FOUR", 0) == [1, 4] and near("FOUR", 5) == [1, 6, 9, 4] and near("FOUR", 23) == [19, 22]
    assert near("EIGHT", 5) == [0, 1, 2, 4, 6, 8, 9, 10] and near("EIGHT", 20) == [16, 17, 21]


def test_scalar_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0], 0.5)], "a array<float>, b array<float>, x double")
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    row = df.select(scalar.l2(a, b, 2), scalar.inner_product(a, b, 2), scalar.cosine(a, b, 2), scalar.clamp(x, 0.6, 1), scalar.sigmoid(x), scalar.floor_to_zero(x - 0.5), scalar.about_equal(x, x + 1e-7), scalar.contains_ignoring_case(F.lit("Neighbour"), F.lit("BOU"))).first()
    assert row[0] == 5 and row[1] == 16 and row[2] == pytest.approx(16 / math.sqrt(5 * 52)) and row[3] == 0.6
    assert row[4] == pytest.approx(1 / (1 + math.exp(-0.5))) and row[5] == 0 and row[6] and row[7]


def test_step_weights():
    assert [scalar.step_weight(s, 4, "LINEAR") for s in range(4)] == [1, 0.75, 0.5, 0.25]
    assert [scalar.step_weight(s, 4, "ONLYLAST") for s in range(4)] == [0, 0, 0, 1]
    assert scalar.step_weight(2, 4, "NORMAL") == pytest.approx(math.exp(-0.5 * 1.5**2))


def test_scalers(spark):
    p = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0]), (2, [5.0, 5.0])], "point_id long, features array<float>")
    get = lambda df: np.array([r["features"] for r in df.orderBy("point_id").collect()])
    assert np.allclose(get(scaling.standard(p)), [[-1.2247449, 0], [0, 0], [1.2247449, 0]])
    assert np.allclose(get(scaling.uniform(p)), [[0.2, 1], [0.6, 1], [1, 1]])
    assert np.allclose(get(scaling.min_max(p)), [[0, 0], [0.5, 0], [1, 0]])
    assert np.allclose(get(scaling.robust(p)), [[0.2, 1], [0.6, 1], [1, 1]])
    with pytest.raises(ValueError):
        scaling.scale(p, "OTHER")


def test_histogram_counts_what_lies_outside(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 1, 5, 9.9, 10, 11)] + [(None,)], "x double")
    assert {r["bin"]: r["count"] for r in aggregates.histogram(df, "x", 5, 0, 10).collect()} == {-1: 1, 0: 2, 2: 1, 4: 2, 5: 1}


def test_gaussian_rows_have_their_perplexity():
    d = np.random.default_rng(1).random(30)
    p, sigma = kernels.gaussian_row(d, 10)
    assert sigma > 0 and p.sum() == pytest.approx(1) and -(p * np.log(p)).sum() == pytest.approx(math.log(10), abs=1e-5)
    assert np.allclose(kernels.gaussian_or_fallback(np.zeros(4), 9), 0.25)


def test_exponential_rows_sum_to_the_logarithm():
    p = kernels.exponential_row(np.linspace(0.1, 2, 16))
    assert p.max() == 1 and p.sum() == pytest.approx(4, abs=1e-3)


def test_kernels_over_tables(spark):
    rows = [(i, j, abs(i - j) / 3) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "row_id long, col_id long, dist double")
    for scheme in ("TSNE", "UMAP", "LINEAR"):
        sums = kernels.normalized(df, scheme).groupBy("row_id").agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
        assert len(sums) == 6 and all(r["s"] == pytest.approx(1) and r["n"] == 5 for r in sums)


def test_symmetrisation(spark):
    a = np.array([[0, 0.5, 0.5], [0.2, 0, 0.8], [0, 1, 0]])
    m = matrix(spark, a).withColumnRenamed("value", "p")
    assert np.allclose(dense(kernels.symmetric_mean(m), 3, "p"), (a + a.T) / 2)
    assert np.allclose(dense(kernels.symmetric_union(m), 3, "p"), a + a.T - a * a.T)


def test_merging_rows_and_graphs(spark):
    rng = np.random.default_rng(4)
    a = rng.random((9, 9)) * (rng.random((9, 9)) < 0.5)
    parents = spark.createDataFrame([(i, i // 3) for i in range(9)], "component_id long, parent_id long")
    up = np.zeros((3, 9))
    up[np.arange(9) // 3, np.arange(9)] = 1
    assert np.allclose(dense(sparse.merge_rows(matrix(spark, a), parents), 3), up @ a @ up.T)
    w = (a != 0).sum(1)
    assert np.allclose(dense(sparse.merge_rows(matrix(spark, a), parents, True), 3), (up * w) @ a @ up.T / (up @ w)[:, None])
    e = spark.createDataFrame([(0, 3, 1, 0.8), (1, 4, 1, 0.4), (2, 8, 1, 0.3), (3, 0, 1, 0.7), (5, 5, 0, 0.0), (6, 1, 1, 0.13)], "src long, dst long, rank int, dist double")
    found = [(r["src"], r["dst"], r["dist"]) for r in sparse.merge_graph_min(e, parents).orderBy("src", "rank").collect()]
    assert found == [(0, 0, 0), (0, 2, 0.3), (0, 1, 0.4), (1, 1, 0), (1, 0, 0.7), (2, 2, 0), (2, 0, 0.13)]


def test_top_entries_offsets_and_shape(spark):
    m = spark.createDataFrame([(0, c, v) for c, v in {5: 0.8, 3: 0.4, 0: 0.3, 1: 0.9, 2: 0.2, 4: 0.1, 6: 0.0}.items()], "row_id long, col_id long, value double")
    assert [(r["col_id"], r["value"]) for r in sparse.top_k(m, 3).orderBy("col_id").collect()] == [(1, 0.9), (3, 0.4), (5, 0.8)]
    assert [r["col_id"] for r in sparse.top_k(m, 2, largest=False).orderBy("col_id").collect()] == [4, 6]
    degrees = spark.createDataFrame([(i, n) for i, n in enumerate([2, 1, 3, 3, 6])], "src long, degree long")
    assert [r["offset"] for r in sparse.exclusive_offsets(degrees).orderBy("src").collect()] == [0, 2, 3, 6, 9]
    assert not sparse.is_symmetric(m) and sparse.is_same(sparse.transpose(sparse.transpose(m)), m)
    lone = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)], "row_id long, col_id long, value double")
    assert sorted((r["row_id"], r["col_id"]) for r in sparse.remove_diagonal(lone).collect()) == [(0, 0), (1, 2)]


@pytest.mark.parametrize(("heavy", "rows", "log"), [(10**9, 1024, True), (12, 7, True), (0, 16, False)])
def test_nearest_rows_are_the_best_of_the_full_product(spark, monkeypatch, heavy, rows, log):
    monkeypatch.setattr(sparse, "ROWS", rows)
    rng = np.random.default_rng(heavy % 97)
    a = rng.random((40, 60)) * (rng.random((40, 60)) < 0.06)
    a[5:30, 3] = 0.2  # a column that most rows share
    a[38:] = 0
    size = rng.integers(1, 9, 40)
    entries = [(i, j, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    m = spark.createDataFrame([(int(i), int(j), v) for i, j, v in entries], "row_id long, col_id long, value double")
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(size)], "row_id long, size long")
    for weights in (None, sizes):
        whole = sparse.top_k(sparse.pair_similarity(m, 1e-3, log, weights), 4, largest=not log)
        found = sparse.nearest_rows(m, 4, 1e-3, log, weights, heavy)
        assert sorted((r[0], r[1], round(r[2], 9)) for r in found.collect()) == sorted((r[0], r[1], round(r[2], 9)) for r in whole.collect())
    want = np.sqrt(a * size[:, None]) @ np.sqrt(a * size[:, None]).T
    assert all(abs(want[r[0], r[1]] - r[2]) < 1e-9 for r in sparse.pair_similarity(m, 1e-3, False, sizes).collect())


def test_a_column_in_every_row_is_not_one_task(spark):
    n = 3000
    m = spark.range(n).select(F.col("id").alias("row_id"), F.explode(F.array(F.lit(0), F.col("id") % 1500 + 1)).alias("col_id"), F.lit(0.5).alias("value"))
    found = sparse.nearest_rows(m, 2).collect()
    assert len(found) == 2 * n
    best = {r["row_id"]: r for r in found if r["value"] < 1e-9}
    assert len(best) == n and all(r["col_id"] == (i + 1500) % n for i, r in best.items())


def test_pair_similarity_is_the_full_product(spark):
    rng = np.random.default_rng(6)
    a = rng.random((8, 8)) * (rng.random((8, 8)) < 0.5)
    a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
    c = np.sqrt(a) @ np.sqrt(a).T
    want = np.where((c > 1e-4) & ~np.eye(8, dtype=bool), -np.log(np.maximum(c, 1e-9)), 0)
    assert np.allclose(dense(sparse.pair_similarity(matrix(spark, a)), 8), np.maximum(want, 0))


def test_hausdorff(spark):
    a, b = np.random.default_rng(7).random((5, 2)), np.random.default_rng(8).random((4, 2)) + 2
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    want = max(d.min(1).max(), d.min(0).max())
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate([*a, *b])], "point_id long, features array<double>")
    members = spark.createDataFrame([(int(i >= 5), i) for i in range(9)], "component_id long, point_id long")
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    assert similarity.euclid(pairs, members, points).first()["dist"] == pytest.approx(want)
    flat = spark.createDataFrame([(0, 1, i, j, float(d[i, j])) for i in range(5) for j in range(4)], "a long, b long, x long, y long, d double")
    assert similarity.hausdorff(flat).first()["dist"] == pytest.approx(want)
    assert similarity.euclid(pairs, members, points, samples=2).first()["dist"] > 0


def test_walk_hashes_are_those_of_sql(spark):
    df = spark.createDataFrame([(i, i * 7 - 20) for i in range(50)], "a long, b long")
    found = [r[0] for r in df.orderBy("a").select(scalar.uniform(3, F.col("a"), F.col("b"))).collect()]
    assert np.allclose(found, walks.uniforms(3, np.arange(50), np.arange(50) * 7 - 20))


@pytest.mark.parametrize("weighting", ["CONSTANT", "LINEAR", "NORMAL", "ONLYLAST", "FIRST_VISIT"])
def test_walks_do_not_depend_on_partitions_or_method(spark, monkeypatch, weighting):
    a = np.array([[0, 0.5, 0.5, 0], [0.3, 0, 0.7, 0], [0, 0.2, 0, 0.8], [1, 0, 0, 0]])
    steps = matrix(spark, a).withColumnRenamed("value", "p")
    s = WalkSettings(num_walks=12, length=6, weighting=weighting)
    one = dense(walks.hits(steps, s), 4)
    assert np.allclose(one, dense(walks.hits(steps.repartition(3), s, steps.select("row_id").distinct().repartition(4)), 4))
    monkeypatch.setattr(walks, "MOST_ENTRIES", 0)
    assert np.allclose(one, dense(walks.hits(steps, s), 4))
    if weighting == "CONSTANT":
        assert np.allclose(one.sum(1), 12 * 6)
    assert np.allclose(dense(walks.random_walks(steps, s), 4).sum(1), 1)


def test_layout_helpers(spark):
    lay = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0), (2, -5.0, 0.0)], "component_id long, x double, y double")
    up = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "component_id long, parent_id long")
    assert [tuple(r) for r in embedding.children_average(lay, up).orderBy("component_id").collect()] == [(0, 2, 3), (1, -5, 0)]
    assert tuple(embedding.extents(lay).first()) == (-5, 3, 0, 4)
    one = embedding.scale_to_one(lay).collect()
    assert max(max(abs(r["x"]), abs(r["y"])) for r in one) == 1


def test_pca_finds_the_long_axis(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 3)) * [0.1, 5, 0.5] + 3
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<double>")
    got = np.array([(r["x"], r["y"]) for r in embedding.pca(p).orderBy("point_id").collect()])
    assert abs(np.corrcoef(got[:, 0], x[:, 1])[0, 1]) > 0.999 and np.allclose(got.mean(0), 0, atol=1e-9)


def test_layouts_separate_clusters_and_single_components(spark):
    rows = [(i, j, 1.0) for i in range(12) for j in range(12) if i != j and i // 6 == j // 6] + [(0, 6, 0.01), (6, 0, 0.01)]
    p = spark.createDataFrame(rows, "row_id long, col_id long, p double")
    for kind, options in (("TSNE", {"iterations": 150}), ("UMAP", {"epochs": 100})):
        y = np.array([(r["x"], r["y"]) for r in embedding.embed(p, kind, **options).orderBy("component_id").collect()])
        assert np.isfinite(y).all()
        inside = np.linalg.norm(y[:6] - y[:6].mean(0), axis=1).mean()
        assert np.linalg.norm(y[:6].mean(0) - y[6:].mean(0)) > inside
    one = spark.createDataFrame([(3, 3, 1.0)], "row_id long, col_id long, p double")
    assert tuple(embedding.tsne(one).first()) == (3, 0, 0)


def test_interpolated_repulsion_is_near_the_exact_one():
    y = np.random.default_rng(5).standard_normal((3000, 2)) * [12, 5]
    push, z = embedding._repulsion(y)
    near, z_near = embedding._interpolated(y)
    assert z_near == pytest.approx(z, rel=2e-2) and np.linalg.norm(near - push) <= 0.03 * np.linalg.norm(push)


def test_the_spectral_start_by_iteration_is_that_of_the_dense_matrix(spark, monkeypatch):
    rows = [(i, j, 1.0) for i in range(60) for j in range(60) if i != j and abs(i - j) <= 3] + [(i, (i * 7) % 60, 0.02) for i in range(60) if i != (i * 7) % 60]
    p = spark.createDataFrame(rows, "row_id long, col_id long, p double")
    get = lambda: np.array([(r["x"], r["y"]) for r in embedding.spectral(p).orderBy("component_id").collect()])
    dense_ = get()
    monkeypatch.setattr(embedding, "EXACT", 10)
    assert np.allclose(np.abs(get()), np.abs(dense_), atol=2e-3)
    assert embedding.tsne(p, 40).count() == 60


@pytest.mark.parametrize(("width", "dims"), [(64, 3), (2000, 2)])
def test_pca_of_wide_vectors(spark, width, dims):
    rng = np.random.default_rng(width)
    axes = np.linalg.qr(rng.standard_normal((width, 4)))[0]
    x = rng.standard_normal((300, 4)) * [9, 6, 3, 1] @ axes.T + 0.01 * rng.standard_normal((300, width)) + 5
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<double>").repartition(5)
    got = np.array([r[1:] for r in embedding.pca(p, dims, wide=10).orderBy("point_id").collect()])
    c = x - x.mean(0)
    want = np.linalg.svd(c, full_matrices=False)[2][:dims].T
    want = c @ (want * np.sign(want[np.abs(want).argmax(0), np.arange(dims)]))
    assert np.abs(got - want).max() < 1e-6
    if width == 64:
        other = np.array([r[1:] for r in embedding.pca(p, dims).orderBy("point_id").collect()])
        assert np.abs(got - other).max() < 1e-6
