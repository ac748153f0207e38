import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import levels
from lamina.plans import pipeline, registry, sweep
from lamina.settings import HierarchySettings, KnnSettings, LevelSettings, WalkSettings, from_json, run_id, to_json
from lamina.sources import generators, images, sweeps, tables
from lamina.streaming.iterations import Descent


def test_tiff_round_trip_and_stack(spark, tmp_path):
    rng = np.random.default_rng(1)
    planes = [rng.random((3, 4)).astype(np.float32) for _ in range(3)]
    for i, p in enumerate(planes):
        (tmp_path / f"c{i}.tif").write_bytes(images.encode_tiff(p))
    assert np.array_equal(images.decode_tiff(images.encode_tiff(planes[0])), planes[0])
    assert np.array_equal(images.decode_tiff(images.encode_tiff(planes[0]), flip=True), planes[0][::-1])
    rows = images.tiff_stack(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [r["point_id"] for r in rows] == list(range(12)) and rows[5]["row"] == 1 and rows[5]["col"] == 1
    assert np.array_equal(np.array([r["features"] for r in rows], np.float32), np.stack(planes, 2).reshape(12, 3))
    (tmp_path / "d.tif").write_bytes(images.encode_tiff(np.zeros((2, 2), np.float32)))
    with pytest.raises(ValueError):
        images.tiff_stack(spark, str(tmp_path))


def png(pixels, kinds):
    h, w, _ = pixels.shape
    flat, raw, above = pixels.reshape(h, -1).astype(int), b"", np.zeros(w * 3, int)
    for line, kind in zip(flat, kinds, strict=True):
        left = np.concatenate((np.zeros(3, int), line[:-3]))
        corner = np.concatenate((np.zeros(3, int), above[:-3]))
        guess = left + above - corner
        near = np.array([min((abs(g - a), 0, a), (abs(g - b), 1, b), (abs(g - c), 2, c))[2] for g, a, b, c in zip(guess, left, above, corner, strict=True)])
        base = [np.zeros_like(line), left, above, (left + above) // 2, near][kind]
        raw += bytes([kind]) + ((line - base) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_filters(spark, tmp_path):
    pixels = np.random.default_rng(2).integers(0, 256, (5, 6, 3)).astype(np.uint8)
    data = png(pixels, [0, 1, 2, 3, 4])
    assert np.array_equal(images.decode_png(data), pixels)
    (tmp_path / "a.png").write_bytes(data)
    assert images.rgb(spark, str(tmp_path / "a.png")).count() == 30


def test_generators_do_not_depend_on_partitions(spark):
    a = generators.swiss_roll(spark, 100, 0.1).orderBy("point_id").collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    b = generators.swiss_roll(spark, 100, 0.1).orderBy("point_id").collect()
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert a == b
    g = generators.gaussians(spark, 100, [(0, 0, 0), (50, 0, 0), (0, 50, 0)])
    assert [r["count"] for r in g.groupBy("label").count().orderBy("label").collect()] == [33, 33, 34]
    assert all(0 <= x < 1 for r in generators.uniform_points(spark, 50, 4).collect() for x in r["features"])


def test_settings_round_trip_and_refuse(spark):
    s = HierarchySettings(similarity="NEIGH_WALKS", walks=WalkSettings(length=3))
    assert s.walks.min_length == 3 and from_json(HierarchySettings, to_json(s)) == s
    assert run_id(s) == run_id(from_json(HierarchySettings, to_json(s))) != run_id(HierarchySettings())
    for wrong in ({"similarity": "x"}, {"unknown": 1}):
        with pytest.raises((ValueError, TypeError)):
            from_json(HierarchySettings, json.dumps(wrong))
    with pytest.raises(ValueError):
        KnnSettings(metric="L7")


def test_sweeps_skip_what_makes_no_difference():
    s = sweeps.read_sweep(json.dumps({"path": "x", "scaler": ["NONE", "STANDARD"], "metric": ["L2", "COSINE"], "similarity": ["NEIGH_OVERLAP", "NEIGH_WALKS"], "num_walks": [10, 20]}))
    runs = list(s.runs())
    assert len(runs) == 9 and not any(r["metric"] == "COSINE" and r["scaler"] == "STANDARD" for r in runs)
    with pytest.raises(ValueError):
        sweeps.read_sweep('{"scaler": "SOME"}')


def test_grid_and_tables(spark, tmp_path):
    assert tables.grid(500) == (20, 25) and tables.grid(2000) == (40, 50) and tables.grid(0) == (0, 1)
    df = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "level int, component_id long, parent_id long")
    tables.write(df, str(tmp_path / "p"), by_level=True)
    assert tables.read(spark, str(tmp_path / "p"), "PARENTS").where("level = 1").count() == 1


def test_the_whole_way(spark):
    points = generators.gaussians(spark, 48, [(0, 0, 0), (9, 0, 0)]).select("point_id", "features")
    h, dists = pipeline.compute(points, 6, 8, KnnSettings(k=7, symmetric=True), HierarchySettings(similarity="EUCLID_CENTROID", max_levels=2), LevelSettings(), "STANDARD")
    assert h.sizes[0] == 48 and len(h.sizes) == 3 and 0 in dists
    p = dists[0]
    assert p.join(p.toDF("col_id", "row_id", "q"), ["row_id", "col_id"]).where("abs(p - q) > 1e-12").isEmpty()
    places = pipeline.layouts(h, dists, iterations=30)
    assert places[0].count() == 48
    with pytest.raises(ValueError):
        pipeline.build_hierarchy(points, 5, 5, KnnSettings(), HierarchySettings())


def test_geodesic_hierarchy_connects_its_graph(spark):
    points = generators.s_curve(spark, 30).select("point_id", "features")
    h, edges = pipeline.build_hierarchy(points, 5, 6, KnnSettings(k=3), HierarchySettings(similarity="GEO_CENTROID", max_levels=1, samples=4))
    assert h.sizes[1] < 30 and edges.where("src = dst").count() == 30


def test_neighbor_counts_shrink_with_levels():
    assert levels.neighbor_counts([5000, 800, 60, 3], 91) == [(91, 30.0), (31, 10.0), (31, 10.0), (3, 10.0)]


def test_descent_goes_on_from_where_it_stopped(spark):
    p = spark.createDataFrame([(i, j, 1.0) for i in range(5) for j in range(5) if i != j], "row_id long, col_id long, p double")
    d = Descent(p)
    d.advance(10, lambda i, y: d.stop() if i == 4 else None)
    assert d.done == 5
    d.advance(3)
    assert d.done == 8 and d.layout.count() == 5


def test_every_sql_names_a_query_and_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert e.entry(spark).agg(F.count("*")).first()[0] == 500


def test_stages_are_loaded_only_if_nothing_before_them_changed(spark, tmp_path):
    from lamina.plans.stages import Stages, fingerprint

    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    df = spark.range(5)
    assert fingerprint(df) == fingerprint(df.repartition(3)) != fingerprint(spark.range(6))
    for k in (3, 3, 4):
        s = Stages(spark, str(tmp_path), fingerprint(df))
        assert s.table("knn", KnnSettings(k=k), lambda k=k: build(k)).count() == k
        assert s.table("levels", LevelSettings(), lambda k=k: build(k + 1)).count() == k + 1
    assert calls == [3, 4, 4, 5]


@pytest.mark.parametrize("similarity", ["NEIGH_OVERLAP", "EUCLID_CENTROID"])
def test_large_levels_measure_likely_pairs_only(spark, monkeypatch, similarity):
    points = generators.gaussians(spark, 120, [(0, 0, 0), (9, 0, 0), (0, 9, 0)]).select("point_id", "features")
    settings = HierarchySettings(similarity=similarity, max_levels=1)
    h, edges = pipeline.build_hierarchy(points, 10, 12, KnnSettings(k=6), settings)
    whole = levels.candidates(h, 1, points, edges, similarity, 3)
    assert whole.count() == h.sizes[1] * (h.sizes[1] - 1) // 2
    monkeypatch.setattr(levels, "ALL_PAIRS", 1)
    some = levels.candidates(h, 1, points, edges, similarity, 3)
    assert 0 < some.count() < whole.count() and some.where("a >= b").isEmpty()
    if similarity == "NEIGH_OVERLAP":
        rest = whole.join(some, ["a", "b"], "left_anti")
        from lamina.operators.similarity import overlap

        assert overlap(rest, h.membership[1].select("component_id", "point_id"), edges).where("dist < 1").isEmpty()


def test_exact_levels_measure_every_pair_and_likely_ones_lose_little(spark, monkeypatch):
    points = generators.gaussians(spark, 480, [(0, 0, 0), (9, 0, 0), (0, 9, 0), (9, 9, 9)]).select("point_id", "features")
    settings = HierarchySettings(similarity="EUCLID_CENTROID", max_levels=1)
    h, edges = pipeline.build_hierarchy(points, 20, 24, KnnSettings(k=6), settings)
    n, k = h.sizes[1], 8
    monkeypatch.setattr(levels, "ALL_PAIRS", 1)
    assert levels.candidates(h, 1, points, edges, "EUCLID_CENTROID", k, exact=True).count() == n * (n - 1) // 2
    measure = levels.metric_of(h, 1, points, edges, settings)
    rows = lambda d: {(r["row_id"], r["col_id"]) for r in levels.nearest_components(d, k + 1).collect()}
    whole = rows(measure(levels.candidates(h, 1, points, edges, "EUCLID_CENTROID", k, exact=True)))
    found = rows(levels.descended(measure, levels.candidates(h, 1, points, edges, "EUCLID_CENTROID", k), k))
    assert len(whole & found) >= 0.97 * len(whole)
    # from a few pairs that say nothing, by the distance alone
    ids = sorted(r[0] for r in h.membership[1].select("component_id").distinct().collect())
    some = spark.createDataFrame([(a, b) for i, a in enumerate(ids) for b in (ids[(i + s) % n] for s in (1, 7, 31)) if a < b], "a long, b long")
    assert len(whole & rows(levels.descended(measure, some, k, rounds=12))) >= 0.9 * len(whole)


def test_what_was_measured_while_merging_is_not_measured_again(spark, monkeypatch):
    from lamina.operators import hierarchy

    asked = []

    def make(h, level, points, edges, s):
        def metric(pairs):
            asked.append(sorted(map(tuple, pairs.select("a", "b").collect())))
            return pairs.select("a", "b", (F.abs(F.col("a") - F.col("b")) + 1).cast("double").alias("dist"))

        return metric

    hierarchy.add_metric("COUNTED", make)
    points = generators.gaussians(spark, 24, [(0, 0, 0)]).select("point_id", "features")
    settings = HierarchySettings(similarity="COUNTED", max_levels=2)
    h, edges = pipeline.build_hierarchy(points, 4, 6, KnnSettings(k=4), settings)
    before = {p for part in asked for p in part}
    found = [levels.nearest_components_of(h, 1, pts, edges, settings, LevelSettings(), 3) for pts in (h.measured_on[1], points)]
    assert sorted(found[0].collect()) == sorted(found[1].collect())
    assert len(h.distances) == 2 and before and len(asked[-2]) < len(asked[-1])


def test_level_images_are_written_in_strips(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "STRIP", 7)
    members = spark.createDataFrame([(i, (i * 5) % 4) for i in range(30)], "point_id long, component_id long").repartition(4)
    for seed in (None, 3):
        paths = images.write_level_images({0: members}, 5, 6, f"file://{tmp_path}/{seed}", seed)
        image = images.decode_tiff(open(paths[0].removeprefix("file://"), "rb").read())
        assert image.shape == (5, 6)
        pairs = {(i * 5 % 4, float(v)) for i, v in enumerate(image.ravel())}
        assert len(pairs) == 4 and {v for _, v in pairs} == {0.0, 1.0, 2.0, 3.0} and (seed is not None or all(a == b for a, b in pairs))
    with pytest.raises(ValueError):
        images.write_level_images({0: members}, 5, 7, f"file://{tmp_path}/x")


def test_a_distance_of_ones_own_can_be_named(spark):
    from lamina.operators import hierarchy

    hierarchy.add_metric("LEAST_ID", lambda h, level, points, edges, s: lambda pairs: pairs.select("a", "b", (F.col("a") + F.col("b")).cast("double").alias("dist")))
    points = generators.gaussians(spark, 12, [(0, 0, 0)]).select("point_id", "features")
    h, _ = pipeline.build_hierarchy(points, 3, 4, KnnSettings(k=3), HierarchySettings(similarity="LEAST_ID", max_levels=1))
    assert h.sizes[1] < 12
    with pytest.raises(ValueError):
        HierarchySettings(similarity="UNHEARD_OF")


def test_levels_are_measured_on_scaled_points(spark):
    # the second dimension is large but says nothing; unscaled it would rule the distances
    points = spark.createDataFrame([(i, [float(i // 8), 1000.0 * (i * 5 % 16)]) for i in range(16)], "point_id long, features array<double>")
    settings = HierarchySettings(similarity="EUCLID_CENTROID", max_levels=1)
    _, scaled = pipeline.compute(points, 4, 4, KnnSettings(k=5), settings, LevelSettings(level=1), "STANDARD")
    by_hand = pipeline.scaled_points(points, "STANDARD")
    _, want = pipeline.compute(by_hand, 4, 4, KnnSettings(k=5), settings, LevelSettings(level=1))
    _, plain = pipeline.compute(points, 4, 4, KnnSettings(k=5), settings, LevelSettings(level=1))
    rows = lambda d: sorted((r["row_id"], r["col_id"], round(r["p"], 9)) for r in d[1].collect()) if 1 in d else []
    assert rows(scaled) == rows(want) != rows(plain)


def test_a_sweep_writes_each_run_once(spark, tmp_path):
    points = generators.gaussians(spark, 24, [(0, 0, 0), (9, 0, 0)]).select("point_id", "features")
    text = json.dumps({"path": "x", "scaler": ["NONE", "STANDARD"], "similarity": ["NEIGH_OVERLAP"], "k": 5, "embedding": "TSNE", "init": "PCA"})
    names = sweep.run_sweep(points, 4, 6, sweeps.read_sweep(text), f"file://{tmp_path}", most_levels=2, pictures=True, iterations=5)
    assert len(set(names)) == 2
    for name in names:
        stats = json.loads((tmp_path / name / "stats.json").read_text())
        assert stats["levels"][0]["num_components"] == 24 and stats["distributions"][0]["rows"] == 24
        picture = images.decode_tiff((tmp_path / name / "levels" / "level-1.tif").read_bytes())
        assert picture.shape == (4, 6) and len(np.unique(picture)) == stats["levels"][1]["num_components"]
        assert spark.read.parquet(f"{tmp_path}/{name}/layout").where("level = 0").count() == 24
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert sweep.run_sweep(points, 4, 6, sweeps.read_sweep(text), f"file://{tmp_path}", most_levels=2, pictures=True, iterations=5) == names
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == before


def test_computed_stages_give_what_they_gave(spark, tmp_path):
    from lamina.plans.stages import Stages

    points = generators.gaussians(spark, 24, [(0, 0, 0), (9, 0, 0)]).select("point_id", "features")
    args = (points, 4, 6, KnnSettings(k=5), HierarchySettings(max_levels=2), LevelSettings())
    h, d = pipeline.compute(*args)
    for _ in range(2):
        h2, d2 = pipeline.compute(*args, stages=Stages(spark, f"file://{tmp_path}", "points"))
        assert h2.sizes == h.sizes and d2.keys() == d.keys()
        for level in d:
            rows = lambda x: sorted((r["row_id"], r["col_id"], round(r["p"], 9)) for r in x.collect())
            assert rows(d[level]) == rows(d2[level])
        assert sorted(map(tuple, h2.membership[1].select("point_id", "component_id").collect())) == sorted(map(tuple, h.membership[1].select("point_id", "component_id").collect()))


@pytest.mark.parametrize("init", ["RANDOM", "PCA", "SPECTRAL"])
def test_layouts_start_from_children_or_by_name(spark, init):
    points = generators.gaussians(spark, 48, [(0, 0, 0), (9, 0, 0)]).select("point_id", "features")
    h, d = pipeline.compute(points, 6, 8, KnnSettings(k=7), HierarchySettings(max_levels=1), LevelSettings())
    out = pipeline.layouts(h, d, order="children", init=init, points=points, iterations=5)
    assert {level: out[level].count() for level in out} == {level: h.sizes[level] for level in d}
    with pytest.raises(ValueError):
        pipeline.layouts(h, d, order="sideways")
