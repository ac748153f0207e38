"""Kernels that turn rows of distances into rows of probabilities.

Input and output are sparse rows: (row_id, col_id, dist) to (row_id, col_id, p). The self entry (row_id = col_id) is dropped first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.scaling import row_unit_sum

#: Rows of a matrix are dealt into so many groups for the array kernels; a group holds whole rows.
GROUPS = 1024
LEAST_SIGMA = 1e-3


def gaussian_row(d: np.ndarray, perplexity: float, rounds: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Probabilities exp(-beta d) of the entropy ln(perplexity), and sigma; uniform and 0 if no beta is found."""
    n = len(d)
    if n == 0:
        return d, 0.0
    goal, beta, low, high = np.log(perplexity), 1.0, 0.0, np.inf
    for _ in range(rounds):
        v = np.exp(-beta * (d - d.min()))  # the shift cancels in the shares
        s = v.sum()
        entropy = np.log(s) + beta * float((d - d.min()) @ v) / s
        if abs(entropy - goal) < tolerance:
            return v / s, float(np.sqrt(1 / (2 * beta)))
        if entropy > goal:
            low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
        else:
            high, beta = beta, (beta + low) / 2
    return np.full(n, 1 / n), 0.0


def gaussian_or_fallback(d: np.ndarray, perplexity: float) -> np.ndarray:
    """As `gaussian_row`; where sigma vanishes, shares of what the unit-sum distances leave of 1, or uniform if all are 0."""
    p, sigma = gaussian_row(d, perplexity)
    if sigma >= LEAST_SIGMA or len(d) == 0:
        return p
    total = d.sum()
    if total <= 0:
        return np.full(len(d), 1 / len(d))
    rest = 1 - d / total
    return rest / rest.sum() if rest.sum() > 0 else np.full(len(d), 1 / len(d))


def exponential_row(d: np.ndarray, rounds: int = 64, tolerance: float = 1e-5, bandwidth: float = 1.0, least: float = 1e-3) -> np.ndarray:
    """Smooth nearest-neighbour weights exp(-max(0, d - rho) / sigma), which sum to log2(neighbours) * bandwidth."""
    if len(d) == 0:
        return d
    positive = d[d > 0]
    rho = positive.min() if len(positive) else 0.0
    goal, low, high, sigma = np.log2(max(len(d), 2)) * bandwidth, 0.0, np.inf, 1.0
    over = np.maximum(d - rho, 0)
    for _ in range(rounds):
        total = np.exp(-over / sigma).sum()
        if abs(total - goal) < tolerance:
            break
        if total > goal:
            high = sigma
            sigma = (low + high) / 2
        else:
            low = sigma
            sigma = sigma * 2 if np.isinf(high) else (low + high) / 2
    return np.exp(-over / max(sigma, least * max(float(d.mean()), 1e-12)))


def by_rows(matrix: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply an array function to each row's distances, in the order of (dist, col_id). Rows are whole in one group."""

    def work(table: pa.Table) -> pa.Table:
        row, col, d = (table.column(c).to_numpy() for c in ("row_id", "col_id", "dist"))
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order].astype(np.float64)
        edges = np.concatenate(([0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]))
        p = np.concatenate([kernel(d[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]) if len(row) else d
        return pa.table({"row_id": row, "col_id": col, "p": p})

    rows = matrix.where("row_id <> col_id").select("row_id", "col_id", F.col("dist").cast("double").alias("dist"))
    group = F.pmod(F.xxhash64("row_id"), F.lit(GROUPS)).alias("_group")
    return rows.groupBy(group).applyInArrow(work, "row_id long, col_id long, p double")


def gaussian(matrix: DataFrame, perplexity: float | None = None) -> DataFrame:
    """By default the perplexity is a third of a row's neighbours."""
    return by_rows(matrix, lambda d: gaussian_or_fallback(d, perplexity or max(len(d) / 3, 1.0)) if len(d) > 1 else np.ones(len(d)))


def exponential(matrix: DataFrame, unit: bool = False) -> DataFrame:
    """`unit`: rows are divided by their sums, for use as the steps of a walk."""
    out = by_rows(matrix, exponential_row)
    return row_unit_sum(out, value="p") if unit else out


def linear(matrix: DataFrame) -> DataFrame:
    """1 / (1 + dist), divided by the row's sum."""
    v = 1 / (1 + F.col("dist"))
    return matrix.where("row_id <> col_id").select("row_id", "col_id", (v / F.sum(v).over(Window.partitionBy("row_id"))).alias("p"))


def normalized(matrix: DataFrame, scheme: str, perplexity: float | None = None) -> DataFrame:
    if scheme == "TSNE":
        return gaussian(matrix, perplexity)
    if scheme == "UMAP":
        return exponential(matrix, unit=True)
    if scheme == "LINEAR":
        return linear(matrix)
    raise ValueError(f"normalization: {scheme!r} turns no distances into probabilities")


def _both(matrix: DataFrame) -> DataFrame:
    a = matrix.select("row_id", "col_id", F.col("p").alias("a"), F.lit(0.0).alias("b"))
    b = matrix.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), F.lit(0.0).alias("a"), F.col("p").alias("b"))
    return a.union(b).groupBy("row_id", "col_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def symmetric_mean(matrix: DataFrame) -> DataFrame:
    """(p_ij + p_ji) / 2 over the entries of either."""
    return _both(matrix).select("row_id", "col_id", ((F.col("a") + F.col("b")) / 2).alias("p"))


def symmetric_union(matrix: DataFrame) -> DataFrame:
    """p_ij + p_ji - p_ij * p_ji over the entries of either."""
    return _both(matrix).select("row_id", "col_id", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("p"))
