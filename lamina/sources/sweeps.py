"""Configurations of parameter sweeps."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from lamina import settings as s

#: A combination of walks x length x k beyond this is skipped.
MOST_STEPS = 200 * 500 * 200
# The keys of a sweep file, and which option names each may hold.
CHOICES = {
    "scaler": s.SCALERS,
    "metric": s.METRICS,
    "similarity": s.COMPONENT_SIMS,
    "normalization": s.NORMALIZATIONS,
    "connection": s.CONNECTIONS,
    "weighting": s.WEIGHTINGS,
    "handling": s.WALK_HANDLINGS,
    "reduction": s.WALK_REDUCTIONS,
    "embedding": s.EMBEDDINGS,
    "init": s.EMBEDDING_INITS,
}
NUMBERS = ("k", "num_walks", "length")


@dataclass(frozen=True)
class Sweep:
    path: str
    values: dict[str, tuple] = field(default_factory=dict)

    def runs(self) -> Iterator[dict]:
        """Each combination once; too large ones, scaled cosine runs, and differences in walks where none are made are left out."""
        seen = set()
        for combination in itertools.product(*self.values.values()):
            run = dict(zip(self.values, combination, strict=True))
            if run.get("num_walks", 1) * run.get("length", 1) * max(run.get("k", 1), 1) > MOST_STEPS:
                continue
            if run.get("metric") == "COSINE" and run.get("scaler", "NONE") != "NONE":
                continue
            if run.get("similarity") not in ("NEIGH_WALKS", "NEIGH_WALKS_SINGLE_OVERLAP", "GEO_WALKS"):
                run = {k: v for k, v in run.items() if k not in ("num_walks", "length", "weighting", "handling", "reduction")}
            name = json.dumps(run, sort_keys=True)
            if name not in seen:
                seen.add(name)
                yield run


def read_sweep(text: str) -> Sweep:
    """A sweep from JSON: `path`, and for each factor a value or a list of values. Unknown keys and names raise."""
    raw = json.loads(text)
    values: dict[str, tuple] = {}
    for key, value in raw.items():
        if key == "path":
            continue
        many = tuple(value) if isinstance(value, list) else (value,)
        if key in CHOICES:
            for v in many:
                s.one_of(key, v, CHOICES[key])
        elif key not in NUMBERS or not all(isinstance(v, int) and v >= 0 for v in many):
            raise ValueError(f"{key}: unknown, or not whole numbers")
        values[key] = many
    return Sweep(raw.get("path", ""), values)
