import heapq
import itertools
import random
import tracemalloc

import fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import components, graph, knn, paths, similarity
from lamina.plans import registry
from lamina.sources import generators


def table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def labels(df):
    return {r["node"]: r["label"] for r in df.collect()}


@pytest.mark.parametrize("small", [0, 100])
def test_weak_and_strong_components(spark, small):
    e = table(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 6), (7, 7)])
    assert labels(components.weak_components(e, small=small)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 2}
    assert labels(components.strong_components(e, small=small)) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 3, 7: 4}


def test_components_of_long_paths_and_nothing(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    e = table(spark, list(itertools.pairwise(ids)))
    for small in (0, 1000):
        assert set(labels(components.weak_components(e, small=small)).values()) == {0}
        assert labels(components.weak_components(table(spark, []), small=small)) == {}
        assert labels(components.strong_components(table(spark, []), small=small)) == {}
    assert len(set(labels(components.strong_components(e, small=1000)).values())) == 200


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_agree_with_a_search(spark, one_task):
    rng = random.Random(5)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(pairs, "a long, b long"), one_task=one_task)
    assert {r["node"]: r["component"] for r in found.collect()} == {x: find(x) for x in up}


def brute(x, k, metric):
    d = {"L2": lambda a, b: np.linalg.norm(a - b), "COSINE": lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), "INNER_PRODUCT": lambda a, b: -(a @ b)}[metric]
    return {i: sorted((d(x[i], x[j]), j) for j in range(len(x)) if j != i)[: k - 1] for i in range(len(x))}


@pytest.mark.parametrize("metric", ["L2", "COSINE", "INNER_PRODUCT"])
def test_exact_neighbours(spark, metric):
    x = np.random.default_rng(3).standard_normal((70, 6)).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<float>")
    found = {}
    for r in knn.knn_exact(points, 5, metric, block=20).orderBy("src", "rank").collect():
        found.setdefault(r["src"], []).append((r["dist"], r["dst"]))
    want = brute(x.astype(np.float64), 5, metric)
    for i, row in found.items():
        assert row[0][1] == i and [j for _, j in row[1:]] == [j for _, j in want[i]]
        assert np.allclose([d for d, _ in row[1:]], [d for d, _ in want[i]])


def test_neighbours_by_cells_find_most_and_miss_no_row(spark):
    points = generators.gaussians(spark, 600, [(0, 0, 0), (6, 0, 0), (0, 6, 0)])
    exact = knn.knn_exact(points, 6)
    near = knn.knn_cells(points, 6, cells=20, probes=4)
    assert near.groupBy("src").count().where("count <> 6").isEmpty() and near.count() == 3600
    assert exact.join(near, ["src", "dst"]).count() >= 0.9 * 3600


def test_small_and_repeated_points(spark):
    points = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [1.0])], "point_id long, features array<float>")
    assert [(r["src"], r["dst"]) for r in knn.knn_exact(points, 2).orderBy("src", "rank").collect()] == [(0, 0), (0, 1), (1, 1), (1, 0), (2, 2), (2, 0)]


def test_symmetric_graphs(spark):
    e = spark.createDataFrame([(0, 0, 0, 0.0), (0, 1, 1, 0.4), (1, 1, 0, 0.0), (1, 2, 1, 0.3), (2, 2, 0, 0.0), (2, 1, 1, 0.5)], "src long, dst long, rank int, dist double")
    least = {(r["src"], r["dst"]): r["dist"] for r in graph.symmetric_min(e).collect()}
    assert least == {(0, 0): 0, (0, 1): 0.4, (1, 0): 0.4, (1, 1): 0, (1, 2): 0.3, (2, 1): 0.3, (2, 2): 0}
    mean = {(r["src"], r["dst"]): r["dist"] for r in graph.symmetric_mean(e).collect()}
    assert mean[0, 1] == mean[1, 0] == 0.2 and mean[1, 2] == mean[2, 1] == 0.4 and mean[1, 1] == 0


def test_self_comes_first_and_rows_are_checked(spark):
    e = spark.createDataFrame([(0, 1, 0, 0.1), (0, 2, 1, 0.2), (0, 3, 2, 0.3)], "src long, dst long, rank int, dist double")
    assert [r["dst"] for r in graph.with_self(e, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert graph.incomplete(e, 4).count() == 1 and graph.repeated(e).isEmpty() and graph.decreasing(e).isEmpty()


def test_connecting_yields_one_component(spark):
    points = generators.s_curve(spark, 300, 0.2, seed=123)
    e = graph.symmetric_min(knn.knn_exact(points, 3))
    assert components.weak_components(e).agg(F.max("label")).first()[0] > 0
    joined = graph.connected(points, e)
    assert components.weak_components(joined).agg(F.max("label")).first()[0] == 0
    assert joined.where("src = dst and rank <> 0").isEmpty()


def shortest(edges, a, b):
    best, heap = {a: 0.0}, [(0.0, a)]
    while heap:
        d, x = heapq.heappop(heap)
        if x == b:
            return d
        for s, t, w in edges:
            if s == x and d + w < best.get(t, 1e9):
                best[t] = d + w
                heapq.heappush(heap, (d + w, t))
    return None


def test_shortest_paths_both_ways_of_computing(spark, monkeypatch):
    rng = random.Random(2)
    raw = [(rng.randrange(30), rng.randrange(30), rng.random()) for _ in range(60)]
    e = graph.ranked(spark.createDataFrame(raw, "src long, dst long, dist double").groupBy("src", "dst").agg(F.min("dist").alias("dist")))
    both = [(a, b) for a in range(0, 30, 7) for b in range(0, 30, 5)]
    pairs = spark.createDataFrame(both, "a long, b long")
    want = {p: (0.0 if p[0] == p[1] else shortest(raw, *p)) for p in both}
    for most, at_once in ((paths.MOST_EDGES, paths.ROUND_EDGES), (paths.MOST_EDGES, 0), (1, 0)):
        monkeypatch.setattr(paths, "MOST_EDGES", most)
        monkeypatch.setattr(paths, "ROUND_EDGES", at_once)
        found = {(r["a"], r["b"]): r["dist"] for r in paths.shortest_paths(e, pairs).collect()}
        assert found.keys() == want.keys()
        for p, d in found.items():
            known = any(p[0] in x[:2] for x in raw)
            assert (d is None) == (want[p] is None) if known or p[0] != p[1] else True
            assert d is None or abs(d - want[p]) < 1e-9


def test_fixture_rows_have_themselves_first():
    assert [r[0] for r in fixtures.rows(fixtures.GRID_6X4)] == list(range(24))


def test_closest_pairs_of_all_labels_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, label = rng.standard_normal((200, 64)), np.arange(200) % 10
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["a"], r["b"]): (r["src"], r["dst"], r["dist"]) for r in registry.QUERIES["closest_pair_between_components"](spark, str(tmp_path)).collect()}
    assert len(got) == 45
    for (a, b), (src, dst, dist) in got.items():
        p, q = np.flatnonzero(label == a), np.flatnonzero(label == b)
        d = np.sqrt(((x[p][:, None] - x[q][None]) ** 2).sum(2))
        i, j = np.unravel_index(d.argmin(), d.shape)
        assert (src, dst) == (p[i], q[j]) and abs(dist - d.min()) < 1e-5


@pytest.mark.parametrize("metric", ["L2", "COSINE", "INNER_PRODUCT"])
def test_equal_points_and_distances_go_by_id(spark, metric):
    rng = np.random.default_rng(9)
    x = rng.integers(1, 4, (900, 3)).astype(float)
    x[::3] = [2, 2, 2]
    ids = rng.permutation(900)
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "point_id long, features array<double>")
    own = np.empty_like(x)
    own[ids] = x
    d = {"L2": np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)), "COSINE": 1 - own @ own.T / np.linalg.norm(own, axis=1)[:, None] / np.linalg.norm(own, axis=1)[None], "INNER_PRODUCT": -own @ own.T}[metric]
    d = np.round(d, 9)
    want = {(s, int(t)) for s in range(900) for t in sorted(set(range(900)) - {s}, key=lambda t: (d[s, t], t))[:5]}
    found = {(r["src"], r["dst"]) for r in knn.knn_exact(points, 6, metric, block=128).where("src <> dst").collect()}
    if metric == "COSINE":  # rounding tells equal directions apart
        assert sum(d[s, t] for s, t in found) == pytest.approx(sum(d[s, t] for s, t in want), abs=1e-6)
    else:
        assert found == want


@pytest.mark.parametrize("index", ["IVFFlat", "HNSW", "HNSWSQ", "HNSW_IVFPQ"])
def test_approximate_indexes_find_nine_of_ten(spark, index):
    rng = np.random.default_rng(12)
    x = (rng.standard_normal((12, 16)) * 3)[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 16))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<float>")
    truth = {(r["src"], r["dst"]) for r in knn.knn_exact(points, 9).collect()}
    found = knn.knn(points, 9, index=index).collect()
    assert sum((r["src"], r["dst"]) in truth for r in found) >= 0.9 * len(truth) and len(found) == len(truth)
    near = {(r["src"], r["dst"]): r["dist"] for r in found}
    assert all(d == pytest.approx(float(np.linalg.norm(np.float32(x[s]).astype(float) - np.float32(x[t]).astype(float))), abs=1e-6) for (s, t), d in list(near.items())[:500])


def test_indexes_are_chosen_by_the_number_of_points():
    assert [knn.choose_index(n) for n in (10_000, 10_001, 100_001, 25_000_001, 50_000_001)] == ["BruteForce", "IVFFlat", "HNSW", "HNSWSQ", "HNSW_IVFPQ"]


def test_paths_with_their_nodes_and_a_cache(spark):
    points = generators.s_curve(spark, 200).select("point_id", "features")
    e = graph.connected(points, graph.symmetric_min(knn.knn_exact(points, 6))).cache()
    rng = random.Random(3)
    pairs = spark.createDataFrame([(rng.randrange(200), rng.randrange(200)) for _ in range(40)] + [(7, 7), (3, 999)], "a long, b long").distinct().cache()
    want = {(r["a"], r["b"]): r["dist"] for r in paths.shortest_paths(e, pairs).collect()}
    weight = {(r["src"], r["dst"]): r["dist"] for r in e.collect()}
    for places in (None, points):
        for r in paths.path_nodes(e, pairs, places).collect():
            if want[r["a"], r["b"]] is None:
                assert r["dist"] is None and r["nodes"] is None
                continue
            assert r["dist"] == pytest.approx(want[r["a"], r["b"]], abs=1e-9) and (r["nodes"][0], r["nodes"][-1]) == (r["a"], r["b"])
            assert sum(weight[s, t] for s, t in itertools.pairwise(r["nodes"])) == pytest.approx(r["dist"], abs=1e-9)
    cache = paths.PathCache(e, points)
    assert {(r["a"], r["b"]): r["dist"] and round(r["dist"], 9) for r in cache.distances(pairs).collect()} == {k: v and round(v, 9) for k, v in want.items()}
    some = cache.known.where("a <> b and dist is not null").limit(60)
    parts = {(r["a"], r["b"]): r["dist"] for r in some.collect()}
    again = {(r["a"], r["b"]): r["dist"] for r in paths.shortest_paths(e, some.select("a", "b")).collect()}
    assert parts == pytest.approx(again) and cache.known.count() > pairs.count()


def test_centroids_are_found_through_their_groups():
    rng = np.random.default_rng(4)
    near = rng.standard_normal((600, 8)) + 3 * rng.standard_normal((30, 8))[rng.integers(0, 30, 600)]
    x = near[rng.integers(0, 600, 300)] + 0.2 * rng.standard_normal((300, 8))
    want = np.argsort(((x[:, None] - near[None]) ** 2).sum(2), axis=1)[:, :5]
    assert (knn.Coarse(near, 1).nearest(x, 5) == want).all()
    found = knn.Coarse(near, 1, grouped=100).nearest(x, 5)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found.tolist(), want.tolist(), strict=True)]) >= 0.97 * 5 and (found[:, 0] == want[:, 0]).mean() > 0.98


@pytest.mark.parametrize("metric", ["L2", "INNER_PRODUCT"])
def test_tables_of_letters_give_the_distances_of_the_codes(metric):
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((400, 37)), rng.standard_normal((9, 37))
    code = knn.Coding("PQ", x, 1)
    raw = code.pack(x)
    assert all(len(r) == knn.PARTS for r in raw)
    assert np.allclose(code.looked_up(q, raw, metric), knn._dist(q, code.unpack(raw), metric), atol=1e-3)


def test_paths_by_joins_are_guided_by_landmarks(spark, monkeypatch):
    rng = random.Random(8)
    raw = [(rng.randrange(60), rng.randrange(60), rng.randint(1, 40) / 8) for _ in range(150)] + [(100 + i, 101 + i, 1.0) for i in range(5)] + [(200, 200, 0.0)]
    e = spark.createDataFrame(raw, "src long, dst long, dist double")
    both = [(a, b) for a in range(0, 60, 9) for b in range(0, 60, 7)] + [(100, 105), (105, 100), (3, 3), (999, 999), (999, 1), (100, 7)]
    pairs = spark.createDataFrame(both, "a long, b long")
    want = {(r["a"], r["b"]): r["dist"] for r in paths.path_nodes(e, pairs).collect()}
    monkeypatch.setattr(paths, "MOST_EDGES", 0)
    length = {}
    for s, t, w in raw:
        length[s, t] = min(w, length.get((s, t), w))
    found = paths.path_nodes(e, pairs).collect()
    assert {(r["a"], r["b"]): r["dist"] for r in found} == want and len(found) == len(set(both))
    for r in found:
        if r["dist"] is not None:
            assert (r["nodes"][0], r["nodes"][-1]) == (r["a"], r["b"]) and sum(length[s, t] for s, t in itertools.pairwise(r["nodes"])) == r["dist"]
    bounds = {r["node"]: (r["out"], r["back"]) for r in paths.landmarks(e, 3).collect()}
    assert len(bounds) == len({x for s, t, _ in raw for x in (s, t)}) and all(len(o) == len(b) == 3 for o, b in bounds.values())


@pytest.mark.parametrize("most", [paths.MOST_EDGES, 0])
def test_geodesic_hausdorff_searches_from_sets(spark, monkeypatch, most):
    monkeypatch.setattr(paths, "MOST_EDGES", most)
    rng = random.Random(6)
    raw = [(rng.randrange(40), rng.randrange(40), rng.randint(1, 30) / 4) for _ in range(130)]
    e = spark.createDataFrame(raw, "src long, dst long, dist double")
    members = [(i % 5, i) for i in range(43)]  # some have no edges
    pairs = [(0, 1), (1, 2), (3, 4), (4, 0)]
    d = {(a, b): 0.0 if a == b else shortest(raw, a, b) for a in range(43) for b in range(43)}
    far = lambda x: float("inf") if x is None else x
    table = spark.createDataFrame(members, "component_id long, point_id long")
    asked = spark.createDataFrame(pairs, "a long, b long")
    for drop in (0, 1):
        own = {c: [i for k, i in members if k == c and (not drop or i < 35 and i not in (0,))] for c in range(5)}
        some = table.where("point_id < 35 and point_id <> 0") if drop else table
        found = {(r["a"], r["b"]): r["dist"] for r in similarity.geodesic(asked, some, e).collect()}
        for a, b in pairs:
            there = max(min(far(d[x, y]) for y in own[b]) for x in own[a])
            back = max(min(far(d[x, y]) for x in own[a]) for y in own[b])
            assert far(found[a, b]) == max(there, back)
    drawn = {(r["a"], r["b"]): r["dist"] for r in similarity.geodesic(asked, table.where("point_id < 35"), e, samples=3).collect()}
    assert drawn.keys() == set(pairs)


def test_geodesic_hausdorff_of_thousands_of_members(spark):
    n = 5000  # two rails with a rung at every tenth node
    rungs = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst"), F.lit(2.0).alias("dist")).where("src % 10 = 0")
    rails = spark.range(2 * n - 1).where(f"id <> {n - 1}").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("dist"))
    e = rungs.union(rails)
    e = e.union(paths.reversed_edges(e))
    members = spark.range(2 * n).select((F.col("id") >= n).cast("long").alias("component_id"), F.col("id").alias("point_id"))
    assert similarity.geodesic(spark.createDataFrame([(0, 1)], "a long, b long"), members, e).collect() == [(0, 1, 11.0)]


def test_the_spanning_tree_by_tables_is_the_one_in_the_driver(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.standard_normal((30, 3)) + c for c in ([0, 0, 0], [40, 0, 0], [0, 90, 0])])
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<double>")
    found = {(r["a"], r["b"]) for r in graph.spanning_pairs(centres).collect()}
    assert found == {(min(p), max(p)) for p in graph.spanning_tree(x)}


def test_the_spanning_tree_by_tables_asks_for_no_lists_of_neighbours(spark, monkeypatch):
    """Near groups far apart had lists of neighbours grow until they were as long as a group."""
    asked, whole = [], graph.nearest_of_others
    monkeypatch.setattr(graph, "nearest_of_others", lambda queries, points: asked.append(queries.count()) or whole(queries, points))
    rng = np.random.default_rng(4)
    x = np.concatenate([np.round(rng.standard_normal((40, 2)), 1) + [c * 1000.0, 0] for c in range(4)] + [np.full((30, 2), 7e5)])
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<double>")
    found = [(r["a"], r["b"]) for r in graph.spanning_pairs(centres).collect()]
    assert len(found) == len(set(found)) == len(x) - 1
    length = lambda pairs: sum(float(np.linalg.norm(x[a] - x[b])) for a, b in pairs)
    assert length(found) == pytest.approx(length(graph.spanning_tree(x)))
    assert asked[0] == len(x) and sum(asked) < 4 * len(x)
    e = table(spark, found)
    assert set(labels(components.weak_components(e)).values()) == {0}


def test_small_components_meet_in_batches_as_in_slices(spark, monkeypatch):
    """Each pair of components, of two points even, was a group of its own that a Python function was called for."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 2)), 1)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<double>")
    own = spark.createDataFrame([(i, 40 if i < 30 else i // 3) for i in range(90)], "node long, label long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(10, 29)] + [(12, 40), (29, 40)], "a long, b long")
    monkeypatch.setattr(graph, "SMALL_BYTES", 8 * 2 * 20)
    found = {tuple(r) for r in graph.closest_pairs(points, own, pairs).collect()}
    label = np.array([40 if i < 30 else i // 3 for i in range(90)])
    for a, b, src, dst, dist in found:
        d = np.sqrt(((x[label == a][:, None] - x[label == b]) ** 2).sum(2))
        i, j = np.unravel_index(d.argmin(), d.shape)
        assert (src, dst, dist) == (np.flatnonzero(label == a)[i], np.flatnonzero(label == b)[j], d.min())
    assert len(found) == 21
    called = []
    monkeypatch.setattr(graph, "packed", lambda df, *rest: called.append(df.select("label").distinct().count()) or knn.packed(df, *rest))
    assert {tuple(r) for r in graph.closest_pairs(points, own, pairs).collect()} == found
    assert called == [3]


def test_the_nearest_of_another_group_are_exact():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(900, 3)), np.repeat(rng.normal(size=(3, 3)), 300, axis=0)])
    ids, group = rng.permutation(len(x)), rng.integers(0, 5, len(x))
    group[900:1150] = 9
    src, dst, dist = knn.nearest(ids, x, ids, x, 1, "L2", groups=(group, group))
    assert src.tolist() == ids.tolist()
    for i in range(0, len(x), 37):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[group == group[i]] = np.inf
        best = np.lexsort((ids, d))[0]
        assert (dst[i], dist[i]) == (ids[best], d[best])


def test_neighbours_take_memory_with_the_points_not_with_their_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4096, 16))
    ids = np.arange(4096)
    tracemalloc.start()
    src, dst, dist = knn.nearest(ids, x, ids, x, 3, "L2")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * 4096 * 4096 / 4
    for i in (0, 1000, 4095):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert dst[src == i].tolist() == np.argsort(d)[:3].tolist()
        assert dist[src == i] == pytest.approx(np.sort(d)[:3])


@pytest.mark.parametrize("metric", ["L2", "COSINE", "INNER_PRODUCT"])
@pytest.mark.parametrize("kind", ["outliers", "far", "missing", "tied"])
def test_neighbours_of_odd_vectors_are_exact(kind, metric):
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(1500, 2)) * 4) if kind == "tied" else rng.normal(size=(1500, 5)) + (1e5 if kind == "far" else 0)
    if kind == "outliers":
        x[3], x[900] = 1e7, -1e9
    if kind == "missing":
        x[3], x[900, 1] = np.nan, np.nan
    ids = rng.permutation(1500)
    src, dst, _ = knn.nearest(ids[:50], x[:50], ids, x, 7, metric)
    for i in range(50):
        d = knn._exact(np.broadcast_to(x[i], x.shape), x, metric)
        ok = np.flatnonzero(np.isfinite(d) & (ids != ids[i]))
        assert dst[src == ids[i]].tolist() == ids[ok[np.lexsort((ids[ok], d[ok]))[:7]]].tolist()


def test_equal_points_ask_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, size=(400, 2)).astype(float)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<double>")
    asked = []
    whole = knn._all_pairs
    monkeypatch.setattr(knn, "_all_pairs", lambda queries, *rest, **more: (asked.append(queries.count()), whole(queries, *rest, **more))[1])
    got = {}
    for r in knn.knn_exact(points, 6, block=64).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert asked == [9]
    for i in range(400):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = -1
        assert got[i] == np.lexsort((np.arange(400), d))[:6].tolist()


def test_closest_pairs_of_components_of_many_slices(spark, monkeypatch):
    monkeypatch.setattr(graph, "SLICE", 8)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 40, size=(900, 2)).astype(float)
    label = rng.integers(0, 3, 900)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "node long, label long")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {(r["a"], r["b"]): (r["dist"], r["src"], r["dst"]) for r in graph.closest_pairs(points, labels, pairs).collect()}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert got[a, b] == min((d[i, j], i, j) for i in np.flatnonzero(label == a) for j in np.flatnonzero(label == b))


@pytest.mark.parametrize("weights", ["any", "whole", "one"])
def test_searches_from_both_ends_meet_part_of_the_graph(weights, monkeypatch):
    rng = np.random.default_rng(10)
    n = 6000
    src, dst = np.repeat(np.arange(n), 6), rng.integers(0, n, 6 * n)
    dst[: 6 * 20] = rng.integers(0, 20, 120)  # a part that the others are not reached from
    w = {"any": rng.random(6 * n) + 0.1, "whole": rng.integers(0, 3, 6 * n).astype(float), "one": np.ones(6 * n)}[weights]
    search = paths.TwoWay((np.arange(n), np.arange(0, 6 * n, 6), dst, w))
    settled = []
    for _ in range(12):
        sources, wanted = rng.integers(0, n, 3), rng.integers(0, n, 4)
        best, heap = dict.fromkeys(sources.tolist(), 0.0), [(0.0, int(i)) for i in sources]
        while heap:
            d, i = heapq.heappop(heap)
            if d > best[i]:
                continue
            for j, x in zip(dst[6 * i : 6 * i + 6].tolist(), w[6 * i : 6 * i + 6].tolist(), strict=True):
                if d + x < best.get(j, np.inf):
                    best[j] = d + x
                    heapq.heappush(heap, (d + x, j))
        want = [best.get(t, np.inf) for t in wanted.tolist()]
        assert search.search(sources, wanted) == pytest.approx(want)
        settled.append((search.ahead.dist < search.ahead.radius).sum())
        with monkeypatch.context() as m:
            m.setattr(paths, "MANY_TARGETS", 0)
            assert search.search(sources, wanted) == pytest.approx(want)
    assert weights != "any" or np.median(settled) < n / 4
    assert search.search(np.array([1, 2]), np.array([n - 1, n - 2])).tolist() == [np.inf, np.inf]


@pytest.mark.parametrize("metric", ["L2", "COSINE", "INNER_PRODUCT"])
def test_descent_meets_links_where_they_share_a_point(spark, metric):
    rng = np.random.default_rng(3)
    x = np.float32(rng.standard_normal((40, 5))).astype(float)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<float>")
    now = [(i, (i + s) % 40) for i in range(40) for s in (1, 2, 3)]
    d = {(i, j): float(knn._exact(x[[i]], x[[j]], metric)[0]) for i in range(40) for j in range(40)}
    graph_now = spark.createDataFrame([(i, j, d[i, j]) for i, j in now], "src long, dst long, dist double")
    links = spark.createDataFrame(now, "src long, dst long")
    bound = {i: max(d[p] for p in now if p[0] == i) for i in range(40)}
    want = {(i, j) for v in range(40) for _, i in [p for p in now if p[0] == v] for _, j in [p for p in now if p[0] == v] if i != j and d[i, j] <= bound[i]}
    found = {(r["src"], r["dst"]): r["dist"] for r in knn._met_through(points, links, None, graph_now, 3, metric).collect()}
    assert found.keys() == want and all(abs(found[p] - d[p]) < 1e-6 for p in want)
    # links that were all there a round before were met then
    assert knn._met_through(points, links, links, graph_now, 3, metric).isEmpty()


@pytest.mark.parametrize("coding", ["FLAT", "SQ", "PQ"])
def test_cells_in_buckets_send_a_query_once_a_bucket(spark, monkeypatch, coding):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.standard_normal((300, 6)), np.zeros((150, 6)) + 0.3 * rng.standard_normal((150, 6))))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<double>")
    monkeypatch.setattr(knn, "BUCKET_BYTES", 8 * 6 * 60)
    asked = []
    real = knn.cut
    monkeypatch.setattr(knn, "cut", lambda df, name: (asked.append(df) if name == "asked-in" else None, real(df, name))[1])
    found = knn.knn_cells(points, 6, cells=20, probes=20, coding=coding).where("rank > 0").collect()
    want = {(r["src"], r["dst"]) for r in knn.knn_exact(points, 6).where("rank > 0").collect()}
    assert len({(r["src"], r["dst"]) for r in found} & want) >= (0.9 if coding == "PQ" else 0.99) * len(want)
    n, rows = asked[0].selectExpr("count(distinct bucket)", "count(*)").first()
    assert n >= 8 and rows <= 450 * n and asked[0].groupBy("bucket", "point_id").count().where("count > 1").isEmpty()


def test_searches_by_joins_meet_from_both_ends(spark, monkeypatch):
    rng = random.Random(4)
    raw = list({(i, rng.randrange(600)): rng.randint(8, 16) / 8 for i in range(600) for _ in range(4)}.items())
    raw = [(s, t, w) for (s, t), w in raw]
    e = spark.createDataFrame(raw, "src long, dst long, dist double")
    pairs = [(i, 599 - i) for i in range(40)]
    held = []
    real = paths.cut
    monkeypatch.setattr(paths, "cut", lambda df, name: (lambda out: (held.append(out.count()) if name in ("ends", "known") else None, out)[1])(real(df, name)))
    found = {(r["a"], r["b"]): r["dist"] for r in paths.shortest_paths(e, spark.createDataFrame(pairs, "a long, b long"), most=0).collect()}
    assert found == {p: shortest(raw, *p) for p in pairs}
    assert max(held) < 40 * 600 / 2  # from one end nearly all nodes are met


def test_many_pairs_of_small_components_meet_at_once(spark, monkeypatch):
    for name, value in (("BUCKET_PAIRS", 20), ("FEW", 6), ("SMALL_BYTES", 8 * 3 * 4), ("NUMBERS", 64)):
        monkeypatch.setattr(similarity, name, value)
    rng = np.random.default_rng(3)
    x, of = rng.standard_normal((60, 3)), np.repeat(np.arange(20), [1, 2, 3, 4, 5] * 4)  # five points are too many for SMALL_BYTES
    members = spark.createDataFrame([(int(c), i) for i, c in enumerate(of)], "component_id long, point_id long")
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, features array<double>")
    pairs = [(a, b) for a in range(20) for b in range(20) if a != 7] + [(3, 99)]
    found = {(r["a"], r["b"]): r["dist"] for r in similarity.euclid(spark.createDataFrame(pairs, "a long, b long"), members, points).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    part = lambda a, b: d[np.ix_(of == a, of == b)]
    assert found == pytest.approx({(a, b): max(part(a, b).min(1).max(), part(a, b).min(0).max()) for a, b in pairs if b != 99})


@pytest.mark.parametrize("at_once", [0, 20_000])
def test_groups_are_one_row_a_pair(spark, monkeypatch, at_once):
    monkeypatch.setattr(paths, "ROUND_EDGES", at_once)
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 4.0), (3, 0, 8.0), (8, 9, 1.0)], "src long, dst long, dist double")
    members = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3), (2, 8), (3, 50), (3, 0), (None, 1)], "component_id long, point_id long")
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 2), (0, 0), (3, 3), (3, 1), (0, 77), (77, 0)], "a long, b long")
    for most in (None, 0):
        found = {(r["a"], r["b"]): r["dist"] for r in paths.group_distances(e, members, pairs, most).collect()}
        assert {k: v for k, v in found.items() if 77 not in k} == {(0, 1): 6.0, (1, 0): 9.0, (0, 2): float("inf"), (0, 0): 0.0, (3, 3): 0.0, (3, 1): 7.0}
        assert (0, 77) not in found and found.get((77, 0), float("inf")) == float("inf")


def test_undirected_graphs_are_held_once_for_both_sides(spark):
    rng = random.Random(7)
    raw = {}
    for i in range(300):
        for _ in range(3):
            j, w = rng.randrange(300), rng.randint(4, 12) / 4
            if i != j:
                raw[i, j] = raw[j, i] = min(w, raw.get((i, j), w))
    e = spark.createDataFrame([(s, t, w) for (s, t), w in raw.items()], "src long, dst long, dist double")
    for edges_, shared in ((e, True), (e.where("src < dst or src > 20"), False)):
        g = paths._csr(edges_)
        search = paths.TwoWay(g)
        assert (search.ahead.to is search.back.to) == shared and g[2].dtype == np.int32
        some = [(r["src"], r["dst"], r["dist"]) for r in edges_.collect()]
        for a, b in ((0, 299), (5, 17), (250, 3)):
            at = np.searchsorted(g[0], [a, b])
            assert search.search(at[:1], at[1:])[0] == (shortest(some, a, b) or np.inf)


def test_index_rows_measure_every_distance(spark, tmp_path, monkeypatch):
    from lamina.plans import registry

    rng = np.random.default_rng(11)
    x = np.float32(rng.standard_normal((60, 64)))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(registry, "INDEXES", ("IVFFlat",))
    monkeypatch.setattr(knn, "knn_exact", lambda *a, **k: pytest.fail("all pairs are not asked for"))
    assert registry.knn_index_rows(spark, str(tmp_path)).collect() == [("IVFFlat", 600, 660, True)]
    real = knn.knn
    # a row that the exact search would not have is told too
    monkeypatch.setattr(knn, "knn", lambda *a, **k: real(*a, **k).withColumn("dist", F.when((F.col("src") == 3) & (F.col("rank") == 10), F.col("dist") + 1).otherwise(F.col("dist"))))
    assert registry.knn_index_rows(spark, str(tmp_path)).collect() == [("IVFFlat", 600, 660, False)]
