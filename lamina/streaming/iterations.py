"""Layouts that go on: descent in steps, stopped and resumed from where it stands.

The engine has no event streams. What resembles one is a descent that reports its places while it runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from lamina.operators.embedding import embed


@dataclass
class Descent:
    """A layout of a distribution in progress."""

    distribution: DataFrame
    kind: str = "TSNE"
    seed: int = 1
    layout: DataFrame | None = None
    done: int = 0
    stopped: bool = field(default=False, init=False)

    def stop(self) -> None:
        self.stopped = True

    def advance(self, iterations: int, watch: Callable[[int, np.ndarray], None] | None = None) -> DataFrame:
        """Runs so many iterations more, from the present layout; `watch(iteration, places)` sees each and may call `stop`."""
        self.stopped = False
        ran = 0

        def step(i: int, ids: np.ndarray, places: np.ndarray) -> bool:
            nonlocal ran
            ran = i + 1
            if watch is not None:
                watch(self.done + i, places)
            return self.stopped

        name = "iterations" if self.kind == "TSNE" else "epochs"
        self.layout = embed(self.distribution, self.kind, self.layout, seed=self.seed, on_step=step, **{name: iterations})
        self.done += ran
        return self.layout
