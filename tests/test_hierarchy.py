import fixtures
import pytest
from pyspark.sql import functions as F

from lamina.operators import hierarchy
from lamina.settings import HierarchySettings, WalkSettings


def build(spark, text, rows, cols, **options):
    n = rows * cols
    points = spark.range(n).select(F.col("id").alias("point_id"), F.array(F.col("id").cast("float")).alias("features"))
    return hierarchy.build(points, fixtures.edges(spark, text), rows, cols, HierarchySettings(**options))


def level(h, i):
    return [r["component_id"] for r in h.membership[i].orderBy("point_id").collect()]


@pytest.fixture(scope="module")
def small(spark):
    return build(spark, fixtures.GRID_4X4, 4, 4)


def test_overlap_levels_of_the_small_image(small):
    assert [level(small, i) for i in (1, 2, 3)] == fixtures.LEVELS_4X4
    assert small.sizes == [16, 5, 2, 1]


def test_parents_neighbors_and_pixels(small):
    assert [r["parent_id"] for r in small.parents[1].orderBy("component_id").collect()] == [0, 0, 1, 1, 1]
    touch = {}
    for r in small.neighbors[1].orderBy("neighbor_id").collect():
        touch.setdefault(r["component_id"], []).append(r["neighbor_id"])
    assert touch == {0: [1, 2, 3], 1: [0, 2, 4], 2: [0, 1, 3, 4], 3: [0, 2, 4], 4: [1, 2, 3]}
    assert sorted(r[0] for r in small.pixels(1, 4).collect()) == [13, 14]
    assert small.not_merged(3).count() == 0
    assert [r["num_components"] for r in hierarchy.level_stats(small).orderBy("level").collect()] == [16, 5, 2, 1]


def test_overlap_levels_of_the_larger_image(spark):
    h = build(spark, fixtures.GRID_6X4, 6, 4)
    assert [level(h, i) for i in (1, 2, 3)] == fixtures.LEVELS_6X4
    assert [r["parent_id"] for r in h.parents[1].orderBy("component_id").collect()] == [0, 0, 1, 1, 1, 2, 2]


def test_walk_rows_sum_to_one_and_levels_nest(spark):
    walks = WalkSettings(num_walks=20, length=5, min_length=2, handling="MERGE_RW_NEW_WALKS")
    h = build(spark, fixtures.GRID_4X4, 4, 4, similarity="NEIGH_WALKS", normalization="LINEAR", walks=walks)
    assert h.sizes == sorted(h.sizes, reverse=True) and h.sizes[-1] < 16
    for w in h.walks.values():
        assert all(abs(r["s"] - 1) < 1e-9 for r in w.groupBy("row_id").agg(F.sum("value").alias("s")).collect())


def test_levels_stop_where_told(spark):
    assert build(spark, fixtures.GRID_4X4, 4, 4, max_levels=1).sizes == [16, 5]
    assert build(spark, fixtures.GRID_4X4, 4, 4, min_components=5).sizes == [16, 5]


def test_threshold_by_value_leaves_far_components_alone(spark):
    h = build(spark, fixtures.GRID_4X4, 4, 4, max_dist=0.3, use_percentile=False, max_levels=1)
    assert h.stats[-1]["zero_sim"] > 0 and h.sizes[1] > 5


def test_choose_takes_ties_in_order(spark):
    d = spark.createDataFrame([(0, 3, 1, 0.5), (0, 1, 0, 0.5), (0, 2, 2, 0.9)], "component_id long, neighbor_id long, ord long, dist double")
    assert hierarchy.choose(d, float("inf")).first()["neighbor_id"] == 1
    assert hierarchy.choose(d, 0.5).count() == 0
    assert hierarchy.choose(d, 0.95, multiple=True).count() == 3
