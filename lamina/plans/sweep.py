"""Runs every combination of a sweep over one image and writes what it gives."""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame

from lamina.plans.pipeline import compute, layouts, scaled_points
from lamina.plans.stages import Stages, fingerprint
from lamina.scratch import exists, put
from lamina.settings import HierarchySettings, KnnSettings, LevelSettings, WalkSettings, run_id
from lamina.sources import images, tables
from lamina.sources.sweeps import Sweep

#: Where the factors of a run belong.
KNN, HIERARCHY, WALKS = {"k": "k", "metric": "metric"}, ("similarity", "connection", "normalization"), ("num_walks", "length", "weighting", "handling", "reduction")


def settings_of(run: dict[str, Any]) -> tuple[KnnSettings, HierarchySettings, LevelSettings]:
    """The settings of one combination; factors that it doesn't name keep their defaults. k of 0 means the default."""
    knn = KnnSettings(**{name: run[key] for key, name in KNN.items() if run.get(key)})
    walks = WalkSettings(**{key: run[key] for key in WALKS if run.get(key)})
    scheme = {"normalization": run["normalization"]} if run.get("normalization") in ("TSNE", "UMAP") else {}
    return knn, HierarchySettings(**{key: run[key] for key in HIERARCHY if key in run}, walks=walks), LevelSettings(**scheme)


def run_sweep(points: DataFrame, rows: int, cols: int, sweep: Sweep, folder: str, most_levels: int = 10, pictures: bool = False, **options: Any) -> list[str]:
    """Computes each combination and writes settings, levels, distributions, layouts and statistics to a folder of its own; the folders' names, in order.

    A run whose statistics are there is not run again; neighbours, hierarchies and distributions that runs share are computed once. `options` go to the layouts.
    """
    spark = points.sparkSession
    data, done = fingerprint(points.select("point_id", "features")), []
    for run in sweep.runs():
        name = run_id(data=f"{data}\n{json.dumps(run, sort_keys=True)}")
        at = f"{folder.rstrip('/')}/{name}"
        done.append(name)
        if exists(spark, f"{at}/stats.json"):
            continue
        knn, hierarchy, level = settings_of(run)
        h, distributions = compute(points, rows, cols, knn, replace(hierarchy, max_levels=most_levels), level, run.get("scaler", "NONE"), Stages(spark, f"{folder.rstrip('/')}/stages", data))
        put(spark, f"{at}/settings.json", json.dumps(run, indent=2, sort_keys=True).encode())
        tables.write_hierarchy(h, at)
        places = layouts(h, distributions, run.get("embedding", "TSNE"), order="children", init=run.get("init", "RANDOM"), points=scaled_points(points, run.get("scaler", "NONE")), **options)
        for i, layout in places.items():
            tables.write(layout, f"{at}/layout/level={i}")
        if pictures:
            images.write_level_images(h.membership, rows, cols, f"{at}/levels")
        tables.write_stats(h, distributions, f"{at}/stats.json")
    return done

