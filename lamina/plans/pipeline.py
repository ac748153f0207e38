"""The whole way from points to layouts, stage by stage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.scaling import scale
from lamina.operators import embedding, graph, hierarchy, levels
from lamina.operators.components import strong_components, weak_components
from lamina.operators.knn import knn
from lamina.plans.stages import Stages
from lamina.scratch import cut
from lamina.settings import HierarchySettings, KnnSettings, LevelSettings, one_of

def neighbor_graph(points: DataFrame, settings: KnnSettings) -> DataFrame:
    """Neighbours, completed where an index missed some, with the node itself first; symmetric and connected if asked for."""
    edges = cut(graph.with_self(knn(points, settings.k, settings.metric, settings.index), settings.k), "knn")
    if settings.symmetric or settings.connect:
        edges = cut(graph.symmetric_min(edges), "symmetric")
    return graph.connected(points, edges) if settings.connect else edges


def component_labels(edges: DataFrame, symmetric: bool) -> DataFrame:
    """(node, label): strong components of a symmetric graph are its weak ones, so both go the cheap way; others by direction unless asked."""
    return weak_components(edges) if symmetric else strong_components(edges)


def scaled_points(points: DataFrame, scaler: str) -> DataFrame:
    return cut(scale(points.select("point_id", "features"), scaler), "scaled")


def build_hierarchy(points: DataFrame, rows: int, cols: int, k: KnnSettings, settings: HierarchySettings, scaler: str = "NONE") -> tuple[hierarchy.Hierarchy, DataFrame]:
    """The hierarchy and the neighbour graph it stands on, over scaled points. Geodesic measures connect the graph first; else it keeps a component each at least."""
    if points.count() != rows * cols:
        raise ValueError("the grid has another number of points")
    scaled = scaled_points(points, scaler)
    if settings.similarity.startswith("GEO") and not k.connect:
        k = replace(k, connect=True)
    edges = cut(neighbor_graph(scaled, k), "graph")
    return hierarchy.build(scaled, edges, rows, cols, settings), edges


def compute(
    points: DataFrame, rows: int, cols: int, k: KnnSettings, settings: HierarchySettings, level_settings: LevelSettings, scaler: str = "NONE", stages: Stages | None = None
) -> tuple[hierarchy.Hierarchy, dict[int, DataFrame]]:
    """Neighbours, hierarchy, and the symmetric distribution of each level, all over the scaled points.

    With `stages` the neighbour graph, the hierarchy and the distributions are read from its folder if they were made from the same points and settings, and written there else.
    """
    if points.count() != rows * cols:
        raise ValueError("the grid has another number of points")
    scaled = scaled_points(points, scaler)
    if stages is None:
        h, edges = build_hierarchy(scaled, rows, cols, k, settings)
        return h, levels.level_similarities(h, h.measured_on[1], edges, settings, level_settings, k.k)
    if settings.similarity.startswith("GEO") and not k.connect:
        k = replace(k, connect=True)
    edges = stages.table(f"knn-{scaler}", k, lambda: neighbor_graph(scaled, k))
    h = hierarchy.load(stages.tables("hierarchy", settings, lambda: hierarchy.tables_of(hierarchy.build(scaled, edges, rows, cols, settings))))
    found = stages.table("levels", level_settings, lambda: levels.table_of(levels.level_similarities(h, scaled, edges, settings, level_settings, k.k), points.sparkSession))
    wanted = [r["level"] for r in found.select("level").distinct().collect()]
    return h, {i: found.where(F.col("level") == i).drop("level") for i in sorted(wanted)}


def layouts(h: hierarchy.Hierarchy, distributions: dict[int, DataFrame], kind: str = "TSNE", order: str = "parents", init: str = "RANDOM", points: DataFrame | None = None, seed: int = 1, **options) -> dict[int, DataFrame]:
    """A layout of each level. By `order` a level starts where its parents lie (from the top down), where its children lie on average (from the first level up), or (`each`) as `init` says; so does
    the first level that is laid out. PCA takes the mean of the `points` of each component.
    """
    one_of("order", order, ("parents", "children", "each"))
    out: dict[int, DataFrame] = {}
    for level in sorted(distributions, reverse=order == "parents"):
        start = None
        if order == "parents" and level + 1 in out:
            start = out[level + 1].select(F.col("component_id").alias("parent_id"), "x", "y").join(h.parents[level], "parent_id").select("component_id", (F.col("x") + F.pmod(F.xxhash64("component_id"), F.lit(1000)) * 1e-6).alias("x"), "y")
        elif order == "children" and level - 1 in out:
            start = embedding.children_average(out[level - 1], h.parents[level - 1])
        elif init != "RANDOM":
            means = None
            if points is not None:
                means = graph.centroids(points, h.membership[level].select(F.col("point_id").alias("node"), F.col("component_id").alias("label"))).withColumnRenamed("label", "component_id")
            start = embedding.start(init, distributions[level], means, seed)
        out[level] = embedding.embed(distributions[level], kind, start, seed=seed, **options)
    return out
