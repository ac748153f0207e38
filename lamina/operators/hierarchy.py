"""A hierarchy of regions: level by level, every component merges with its most similar spatial neighbour."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import kernels
from lamina.functions.aggregates import quantile
from lamina.functions.scalar import pixel_neighbors
from lamina.functions.scaling import matrix_unit_sum, row_unit_sum
from lamina.operators import similarity
from lamina.operators.components import weak_components
from lamina.operators.sparse import merge_graph_min, merge_rows, remove_diagonal
from lamina.operators.walks import random_walks
from lamina.scratch import cut
from lamina.settings import ADDED_SIMS, HierarchySettings, WalkSettings

Metric = Callable[[DataFrame], DataFrame]
WALKING = ("NEIGH_WALKS", "NEIGH_WALKS_SINGLE_OVERLAP", "GEO_WALKS")


@dataclass
class Hierarchy:
    """Tables of all levels; level 0 is the single points."""

    membership: dict[int, DataFrame] = field(default_factory=dict)
    parents: dict[int, DataFrame] = field(default_factory=dict)
    neighbors: dict[int, DataFrame] = field(default_factory=dict)
    walks: dict[int, DataFrame] = field(default_factory=dict)
    graphs: dict[int, DataFrame] = field(default_factory=dict)
    #: (component_id, neighbor_id, dist) as measured while a level was merged; what is known there is not measured again.
    distances: dict[int, DataFrame] = field(default_factory=dict)
    #: The settings they were measured by, and the table of points.
    measured_on: tuple[HierarchySettings, DataFrame] | None = None
    stats: list[dict] = field(default_factory=list)

    @property
    def sizes(self) -> list[int]:
        return [s["num_components"] for s in self.stats]

    def table(self, name: str) -> DataFrame:
        """All levels of `membership`, `parents`, `neighbors` or `walks` as one table with a column `level`."""
        parts = [df.select(F.lit(level).alias("level"), "*") for level, df in getattr(self, name).items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def members(self, level: int) -> DataFrame:
        """(component_id, point_id)."""
        return self.membership[level].select("component_id", "point_id")

    def pixels(self, level: int, component: int) -> DataFrame:
        """(point_id) of one component."""
        return self.membership[level].where(F.col("component_id") == component).select("point_id")

    def children(self, level: int) -> DataFrame:
        """(component_id, child_id) of the components of a level above 0."""
        return self.parents[level - 1].select(F.col("parent_id").alias("component_id"), F.col("component_id").alias("child_id"))

    def not_merged(self, level: int) -> DataFrame:
        """(component_id) of the components of a level above 0 that have one child."""
        return self.children(level).groupBy("component_id").agg(F.count("*").alias("n")).where("n = 1").select("component_id")


def spatial_neighbors(adjacency: DataFrame, membership: DataFrame) -> DataFrame:
    """(component_id, neighbor_id, ord): components that touch; ties go by ascending id."""
    a = membership.select("point_id", "component_id")
    b = membership.select(F.col("point_id").alias("neighbor_id"), F.col("component_id").alias("other"))
    touch = adjacency.select("point_id", "neighbor_id").join(a, "point_id").join(b, "neighbor_id").where("component_id <> other")
    return touch.select("component_id", F.col("other").alias("neighbor_id")).distinct().withColumn("ord", F.col("neighbor_id"))


def neighbor_distances(neighbors: DataFrame, metric: Metric) -> DataFrame:
    """`neighbors` with dist; each pair is measured once."""
    pairs = neighbors.select(F.least("component_id", "neighbor_id").alias("a"), F.greatest("component_id", "neighbor_id").alias("b")).distinct()
    d = metric(cut(pairs, "pairs"))
    both = d.union(d.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    return neighbors.join(both.toDF("component_id", "neighbor_id", "dist"), ["component_id", "neighbor_id"], "left")


def threshold(distances: DataFrame, settings: HierarchySettings) -> float:
    """What a distance must stay below: infinite by default, else max_dist itself or the quantile at max_dist of those over 0."""
    if settings.max_dist <= 0:
        return float("inf")
    if not settings.use_percentile:
        return settings.max_dist
    q = quantile(distances.where("dist is not null"), "dist", settings.max_dist, ignore=(0.0, -1.0)).first()
    return float("inf") if q is None or q[0] is None else q[0]


def choose(distances: DataFrame, limit: float, multiple: bool = False) -> DataFrame:
    """(component_id, neighbor_id) that merge: of each component the nearest neighbour (ties by ord), or all, if nearer than the limit."""
    near = distances.where((F.col("dist") < limit) if limit < float("inf") else F.col("dist").isNotNull())
    if multiple:
        return near.select("component_id", "neighbor_id")
    return near.groupBy("component_id").agg(F.min(F.struct("dist", "ord", "neighbor_id")).alias("m")).select("component_id", F.col("m.neighbor_id").alias("neighbor_id"))


def forced(distances: DataFrame, chosen: DataFrame, seed: int) -> DataFrame:
    """A seeded neighbour for each component that chose none."""
    alone = distances.join(chosen.select("component_id").distinct(), "component_id", "left_anti")
    draw = F.min(F.struct(F.xxhash64(F.lit(seed), "component_id", "neighbor_id"), "neighbor_id"))
    return alone.groupBy("component_id").agg(draw.alias("m")).select("component_id", F.col("m.neighbor_id").alias("neighbor_id"))


def merged(ids: DataFrame, choices: DataFrame) -> DataFrame:
    """(component_id, parent_id): choices joined up; parents are numbered from 0 by their least member."""
    loops = ids.select(F.col("component_id").alias("src"), F.col("component_id").alias("dst"))
    return weak_components(choices.select(F.col("component_id").alias("src"), F.col("neighbor_id").alias("dst")).union(loops)).select(F.col("node").alias("component_id"), F.col("label").alias("parent_id"))


def walk_length(s: WalkSettings, rate: float, current: int) -> int:
    """Steps of the walks on the next level; `rate` is the share of components that it keeps."""
    factor = {"NONE": 1.0, "PROPORTIONAL_COMPONENT_REDUCTION": rate, "PROPORTIONAL_HALF": rate / 2, "PROPORTIONAL_DOUBLE": rate * 2, "CONSTANT": 0.5, "CONSTANT_LOW": 0.75, "CONSTANT_HIGH": 0.25}[s.reduction]
    return max(s.min_length, min(s.length, int(min(1.0, factor) * current)))


def new_walks(h: Hierarchy, level: int, parents: DataFrame, settings: HierarchySettings, length: int) -> None:
    """The walks of level + 1: the merged rows themselves, or new walks over them or over merged distances."""
    w = settings.walks
    if w.handling == "MERGE_DATA_NEW_WALKS":
        h.graphs[level + 1] = cut(merge_graph_min(h.graphs[level], parents), "graph")
        steps = kernels.normalized(h.graphs[level + 1].toDF("row_id", "col_id", "rank", "dist"), settings.normalization)
    else:
        rows = merge_rows(h.walks[level], parents, w.weight_by_row_nnz)
        rows = matrix_unit_sum(rows) if w.norm_type == "TWODIM" else row_unit_sum(rows)
        if w.handling == "MERGE_RW_ONLY":
            h.walks[level + 1] = cut(rows, "walks")
            return
        steps = row_unit_sum(remove_diagonal(rows)).withColumnRenamed("value", "p")
    if steps.isEmpty():  # one component is left: it is like itself
        top = parents.select(F.col("parent_id").alias("row_id")).distinct()
        h.walks[level + 1] = cut(top.select("row_id", F.col("row_id").alias("col_id"), F.lit(1.0).alias("value")), "walks")
        return
    h.walks[level + 1] = cut(random_walks(steps, replace(w, length=length)), "walks")


#: Distances between components by name: (hierarchy, level, points, edges, settings) -> pairs (a, b) -> (a, b, dist).
METRICS: dict[str, Callable[[Hierarchy, int, DataFrame, DataFrame, HierarchySettings], Metric]] = {
    "NEIGH_OVERLAP": lambda h, level, points, edges, s: lambda pairs: similarity.overlap(pairs, h.members(level), edges),
    "EUCLID_CENTROID": lambda h, level, points, edges, s: lambda pairs: similarity.euclid(pairs, h.members(level), points, s.samples, s.seed),
    "GEO_CENTROID": lambda h, level, points, edges, s: lambda pairs: similarity.geodesic(pairs, h.members(level), edges, s.samples, s.seed),
    "GEO_WALKS": lambda h, level, points, edges, s: lambda pairs: similarity.geodesic(pairs, h.members(level), edges, s.samples, s.seed),
    "NEIGH_WALKS": lambda h, level, points, edges, s: lambda pairs: similarity.bhattacharyya(pairs, h.walks[level]),
    "NEIGH_WALKS_SINGLE_OVERLAP": lambda h, level, points, edges, s: lambda pairs: similarity.single_overlap(pairs, h.walks[level]),
}


def add_metric(name: str, make: Callable[[Hierarchy, int, DataFrame, DataFrame, HierarchySettings], Metric]) -> None:
    """Let settings name a distance of your own."""
    METRICS[name] = make
    ADDED_SIMS.add(name)


def metric_of(h: Hierarchy, level: int, points: DataFrame, edges: DataFrame, settings: HierarchySettings) -> Metric:
    return METRICS[settings.similarity](h, level, points, edges, settings)


def similarities(pairs: DataFrame, metric: Metric, kind: str) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) under the distance `kind` that `metric` measures, from 0 to 1; 1 for a component and itself.

    Distances between sets of points become 1 / (1 + dist), 0 where no path leads across; the others lie between 0 and 1 and are taken from 1.
    """
    asked = pairs.select("a", "b").distinct()
    other = F.coalesce(1 / (1 + F.col("dist")), F.lit(0.0)) if kind in ("EUCLID_CENTROID", "GEO_CENTROID", "GEO_WALKS") else 1 - F.col("dist")
    found = metric(cut(asked.where("a <> b"), "pairs"))
    return found.select("a", "b", other.alias("similarity")).union(asked.where("a = b").select("a", "b", F.lit(1.0)))


def build(points: DataFrame, edges: DataFrame, rows: int, cols: int, settings: HierarchySettings) -> Hierarchy:
    """The hierarchy over points (point_id, features) on a grid, with the neighbour graph edges (src, dst, rank, dist).

    Stops at min_components, at max_levels, or where a level would keep all components (or, twice running, more than min_reduction percent of them);
    that level is not added. Only counts reach the driver.
    """
    edges = cut(edges.select("src", "dst", "rank", "dist"), "graph")
    h = Hierarchy(measured_on=(settings, points))
    h.membership[0] = cut(points.select("point_id", F.col("point_id").alias("component_id")), "membership")
    adjacency = cut(pixel_neighbors(h.membership[0], rows, cols, settings.connection), "adjacency")
    h.neighbors[0] = adjacency.toDF("component_id", "neighbor_id", "ord")
    h.graphs[0] = edges
    if settings.similarity in WALKING:
        steps = cut(kernels.normalized(edges.toDF("row_id", "col_id", "rank", "dist"), settings.normalization), "steps")
        h.walks[0] = cut(random_walks(steps, settings.walks), "walks")
    n, length = h.membership[0].count(), settings.walks.length
    h.stats.append({"level": 0, "num_components": n, "reduction_rate": 0.0, "zero_sim": 0, "forced_merge": 0, "not_merged": 0})
    slow, level = 0, 0
    while n > settings.min_components and (settings.max_levels < 0 or level < settings.max_levels):
        distances = cut(neighbor_distances(h.neighbors[level], metric_of(h, level, points, edges, settings)), "distances")
        h.distances[level] = distances
        choices = cut(choose(distances, threshold(distances, settings), settings.merge_multiple), "choices")
        chose = choices.select("component_id").distinct().count()
        force = 0
        if settings.max_dist == -1 and chose < n:
            more = cut(forced(distances, choices, settings.seed), "forced")
            force = more.count()
            choices = choices.union(more)
        parents = cut(merged(h.membership[level].select("component_id").distinct(), choices), "parents")
        m = parents.select("parent_id").distinct().count()
        rate = 100.0 * m / n
        slow = slow + 1 if rate > settings.min_reduction else 0
        if m == n or (len(h.stats) > 2 and slow >= 2):
            break
        h.parents[level] = parents
        h.membership[level + 1] = cut(h.membership[level].join(parents, "component_id").select("point_id", F.col("parent_id").alias("component_id")), "membership")
        h.neighbors[level + 1] = cut(spatial_neighbors(adjacency, h.membership[level + 1]), "neighbors")
        if settings.similarity in WALKING:
            length = walk_length(settings.walks, rate / 100, length)
            new_walks(h, level, parents, settings, length)
        level += 1
        h.stats.append({"level": level, "num_components": m, "reduction_rate": rate, "zero_sim": n - chose, "forced_merge": force, "not_merged": h.not_merged(level).count()})
        n = m
    return h


def level_stats(h: Hierarchy) -> DataFrame:
    """(level, num_components, reduction_rate, zero_sim, forced_merge, not_merged): one row a level."""
    spark = h.membership[0].sparkSession
    return spark.createDataFrame([tuple(s.values()) for s in h.stats], "level int, num_components long, reduction_rate double, zero_sim long, forced_merge long, not_merged long")


def tables_of(h: Hierarchy) -> dict[str, DataFrame]:
    """All tables of a hierarchy, by name."""
    return {"stats": level_stats(h), **{name: h.table(name) for name in ("membership", "parents", "neighbors", "walks") if getattr(h, name)}}


def load(tables: dict[str, DataFrame]) -> Hierarchy:
    """The hierarchy whose tables these are."""
    stats = [r.asDict() for r in tables["stats"].orderBy("level").collect()]
    h = Hierarchy(stats=stats)
    for name, df in tables.items():
        if name != "stats":
            last = 1 if name == "parents" else 0
            setattr(h, name, {s["level"]: df.where(F.col("level") == s["level"]).drop("level") for s in stats[: len(stats) - last]})
    return h


def merge_level(ids: DataFrame, neighbors: DataFrame, metric: Metric) -> DataFrame:
    """One merge: (component_id, parent_id) after each component chose its nearest neighbour."""
    return merged(ids, choose(neighbor_distances(neighbors, metric), float("inf")))


def touching(h: Hierarchy, level: int) -> DataFrame:
    """(component_id, neighbor_id) of a level."""
    return h.neighbors[level].select("component_id", "neighbor_id")


def component_sizes(h: Hierarchy, level: int) -> DataFrame:
    w = Window.partitionBy("component_id")
    return h.membership[level].select("component_id", F.count("*").over(w).alias("points")).distinct()
