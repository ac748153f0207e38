"""Options of the pipeline; every wrong value raises instead of falling back to a default."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

# The option names that configuration files use.
SCALERS = ("NONE", "STANDARD", "UNIFORM", "ROBUST")
KNN_INDEXES = ("BruteForce", "Flat", "IVFFlat", "HNSW", "HNSWSQ", "HNSW_IVFPQ")
METRICS = ("L2", "COSINE", "INNER_PRODUCT")
COMPONENT_SIMS = ("NEIGH_OVERLAP", "GEO_CENTROID", "NEIGH_WALKS", "NEIGH_WALKS_SINGLE_OVERLAP", "GEO_WALKS", "EUCLID_CENTROID")
WEIGHTINGS = ("CONSTANT", "LINEAR", "NORMAL", "ONLYLAST", "FIRST_VISIT")
NORMALIZATIONS = ("NONE", "TSNE", "UMAP", "LINEAR")
WALK_HANDLINGS = ("MERGE_RW_ONLY", "MERGE_RW_NEW_WALKS", "MERGE_RW_NEW_WALKS_AND_KNN", "MERGE_DATA_NEW_WALKS")
WALK_REDUCTIONS = ("NONE", "PROPORTIONAL_COMPONENT_REDUCTION", "PROPORTIONAL_HALF", "PROPORTIONAL_DOUBLE", "CONSTANT", "CONSTANT_LOW", "CONSTANT_HIGH")
CONNECTIONS = ("FOUR", "EIGHT")
EMBEDDING_INITS = ("RANDOM", "PCA", "SPECTRAL")
NORM_TYPES = ("ONEDIM", "TWODIM")
EMBEDDINGS = ("TSNE", "UMAP")
#: Names of distances between components that were added to `lamina.operators.hierarchy.METRICS`.
ADDED_SIMS: set[str] = set()


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name}: {value!r} is none of {', '.join(allowed)}")
    return value


@dataclass(frozen=True)
class WalkSettings:
    num_walks: int = 90
    length: int = 15
    min_length: int = 5
    weighting: str = "CONSTANT"
    prune_steps: int = 0
    prune_value: float = 0.0
    handling: str = "MERGE_RW_ONLY"
    reduction: str = "NONE"
    weight_by_row_nnz: bool = False
    norm_type: str = "ONEDIM"
    seed: int = 1

    def __post_init__(self) -> None:
        one_of("weighting", self.weighting, WEIGHTINGS)
        one_of("handling", self.handling, WALK_HANDLINGS)
        one_of("reduction", self.reduction, WALK_REDUCTIONS)
        one_of("norm_type", self.norm_type, NORM_TYPES)
        if min(self.num_walks, self.length, self.min_length) < 1:
            raise ValueError("walks and their lengths are positive")
        if self.min_length > self.length:
            object.__setattr__(self, "min_length", self.length)


@dataclass(frozen=True)
class KnnSettings:
    k: int = 11
    metric: str = "L2"
    index: str = "auto"
    symmetric: bool = False
    connect: bool = False

    def __post_init__(self) -> None:
        one_of("metric", self.metric, METRICS)
        one_of("index", self.index, (*KNN_INDEXES, "auto"))
        if self.k < 1:
            raise ValueError("k is positive")


@dataclass(frozen=True)
class HierarchySettings:
    similarity: str = "NEIGH_OVERLAP"
    connection: str = "FOUR"
    max_dist: float = 0.0
    use_percentile: bool = True
    merge_multiple: bool = False
    min_components: int = 1
    min_reduction: float = 99.99
    max_levels: int = -1
    normalization: str = "TSNE"
    #: Members drawn of either side of a pair of which more products are to be measured; None: all members.
    samples: int | None = None
    seed: int = 1
    walks: WalkSettings = field(default_factory=WalkSettings)

    def __post_init__(self) -> None:
        one_of("similarity", self.similarity, (*COMPONENT_SIMS, *sorted(ADDED_SIMS)))
        one_of("connection", self.connection, CONNECTIONS)
        one_of("normalization", self.normalization, NORMALIZATIONS)
        if self.min_components < 1:
            raise ValueError("at least one component remains")


@dataclass(frozen=True)
class LevelSettings:
    ks: tuple[int, ...] = ()
    exact: bool = False
    pair_similarities: bool = True
    normalization: str = "TSNE"
    level: int | None = None

    def __post_init__(self) -> None:
        one_of("normalization", self.normalization, NORMALIZATIONS)


def to_json(settings: Any) -> str:
    return json.dumps(dataclasses.asdict(settings), indent=2, sort_keys=True)


def from_json(kind: type, text: str) -> Any:
    """Settings of a kind from JSON; unknown keys and values raise."""
    values = json.loads(text)
    unknown = set(values) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if isinstance(values.get("walks"), dict):
        values["walks"] = from_json(WalkSettings, json.dumps(values["walks"]))
    if "ks" in values:
        values["ks"] = tuple(values["ks"])
    return kind(**values)


def run_id(*settings: Any, data: str = "") -> str:
    """A stable name for a run: equal settings over equal data have equal ids."""
    return hashlib.sha256("\n".join([*map(to_json, settings), data]).encode()).hexdigest()[:16]
