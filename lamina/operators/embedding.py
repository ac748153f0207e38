"""Two-dimensional layouts of a level, and what scales and starts them.

Layout tables are (component_id, x, y). Gradient descent and eigenvectors couple all components, so they run on arrays in the driver
for levels of MOST components and MOST_ENTRIES entries at most; larger levels are laid out by PCA or from the levels around them. Beyond EXACT components the repulsion of t-SNE is
interpolated on a grid (by FFT), and the spectral start is found by iteration over the sparse matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.scalar import uniform
from lamina.settings import EMBEDDING_INITS, EMBEDDINGS, one_of

MOST = 1_000_000
MOST_ENTRIES = 40_000_000
EXACT = 4000
#: Cells of the grid along the longer side, at least and at most, and the interpolation nodes of a cell along a side.
GRID = 24, 160
NODES = 3
#: Vectors wider than this have their axes found in a sketch of so many dimensions, with so many looks at the points behind the first.
WIDE, SKETCH, LOOKS = 512, 64, 3
#: Rows of a sketch that are added up as one value.
SKETCH_ROWS = 1024


# starts


def _times_covariance(points: DataFrame, v: np.ndarray) -> np.ndarray:
    """The covariance of the points times v (width, k), of which no more than rows of v ever exist: tasks add up x (x v), and parts of these sums are added up by key."""
    shared = points.sparkSession.sparkContext.broadcast(v)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n, total = shared.value, 0, None
        for b in batches:
            for at in range(0, b.num_rows, SKETCH_ROWS):
                some = b.column("features").slice(at, SKETCH_ROWS)
                x = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1)
                part = np.concatenate((x.T @ (x @ v), x.sum(0)[:, None]), 1)
                n, total = n + len(x), part if total is None else total + part
        if n:
            for i in range(0, len(v), SKETCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([n]), pa.array([total[i : i + SKETCH_ROWS].tobytes()])], ["i", "n", "part"])

    def add(table: pa.Table) -> pa.Table:
        parts = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("part"))
        return pa.table({"i": table.column("i")[:1], "n": pa.array([sum(table.column("n").to_pylist())]), "part": pa.array([parts.tobytes()])})

    schema = "i long, n long, part binary"
    parted = points.select("features").mapInArrow(work, schema)
    # first some tasks' sums together, so that no task adds up all of them
    some = parted.withColumn("_at", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("i", "_at").applyInArrow(add, schema)
    rows = sorted(some.groupBy("i").applyInArrow(add, schema).collect(), key=lambda r: r["i"])
    if not rows:
        raise ValueError("no points")
    sums = np.concatenate([np.frombuffer(r["part"], np.float64).reshape(-1, v.shape[1] + 1) for r in rows]) / rows[0]["n"]
    mean = sums[:, -1]
    return np.concatenate((sums[:, :-1] - np.outer(mean, mean @ v), mean[:, None]), 1)


def wide_axes(points: DataFrame, width: int, dims: int, sketch: int = SKETCH, looks: int = LOOKS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and first principal axes (width, dims) from a random sketch: the range of the covariance's product with `sketch` random vectors, which each further look at the
    points turns towards the first axes, and the axes within it. With a sketch as wide as the points they are exact.
    """
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, max(sketch, dims)))))[0]
    for _ in range(looks):
        q = np.linalg.qr(_times_covariance(points, q)[:, :-1])[0]
    z = _times_covariance(points, q)
    within = q.T @ z[:, :-1]
    return z[:, -1], q @ np.linalg.eigh((within + within.T) / 2)[1][:, ::-1][:, :dims]


def pca(points: DataFrame, dims: int = 2, id_col: str = "point_id", wide: int = WIDE) -> DataFrame:
    """(id, x, y, ...) on the first principal axes, each turned so that its largest loading is positive.

    The moments are added up in the tasks: one matrix of dimension x dimension each reaches the driver's merge. Points of more than `wide` dimensions have their axes found in a sketch.
    """
    names = ["x", "y", *[f"c{i}" for i in range(2, dims)]][:dims]
    width = len((points.select("features").first() or [[]])[0])
    if width > wide:
        mean, axes = wide_axes(points, width, dims)
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        shared = points.sparkSession.sparkContext.broadcast((mean @ axes, axes))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, axes = shared.value
            for whole in batches:
                for i in range(0, whole.num_rows, SKETCH_ROWS):
                    b = whole.slice(i, SKETCH_ROWS)
                    x = b.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) @ axes - at
                    yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in x.T]], [id_col, *names])

        kind = points.schema[id_col].dataType.simpleString()
        return points.select(id_col, "features").mapInArrow(place, f"`{id_col}` {kind}, {', '.join(f'{c} double' for c in names)}")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("features").to_pylist(), np.float64)
                n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        if n:
            size = len(s)
            keys = np.arange(size * (size + 1) + 1)
            values = np.concatenate(([float(n)], s, c.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["i", "v"])

    sums = points.select("features").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    if not len(sums):
        raise ValueError("no points")
    size = int((np.sqrt(4 * len(sums) - 3) - 1) / 2)
    n, mean = sums[0], sums[1 : size + 1] / sums[0]
    cov = sums[size + 1 :].reshape(size, size) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :dims]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    dot = lambda v: F.aggregate(F.zip_with("features", F.array(*[F.lit(float(a)) for a in v]), lambda f, a: f.cast("double") * a), F.lit(float(-mean @ v)), lambda s, z: s + z)
    return points.select(id_col, *[dot(axes[:, i]).alias(n) for i, n in enumerate(names)])


def random_layout(components: DataFrame, seed: int = 123456, scale: float = 1.0) -> DataFrame:
    """Seeded points from -scale to scale."""
    at = lambda s: (2 * uniform(s, F.col("component_id").cast("long")) - 1) * scale
    return components.select("component_id", at(seed).alias("x"), at(seed + 1).alias("y"))


def children_average(layout: DataFrame, parents: DataFrame) -> DataFrame:
    """(component_id, x, y) of a level from its children's layout: the mean place of the children."""
    return layout.join(parents, "component_id").groupBy(F.col("parent_id").alias("component_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def extents(layout: DataFrame) -> DataFrame:
    """(x_min, x_max, y_min, y_max) of the least box that holds all places and the origin."""
    low = lambda c: F.least(F.min(c), F.lit(0.0)).alias(f"{c}_min")
    high = lambda c: F.greatest(F.max(c), F.lit(0.0)).alias(f"{c}_max")
    return layout.agg(low("x"), high("x"), low("y"), high("y"))


def scale_to_deviation(layout: DataFrame, deviation: float = 1e-4) -> DataFrame:
    """Both axes by the factor that gives x the (population) deviation."""
    s = layout.agg(F.stddev_pop("x").alias("_s"))
    factor = F.when(F.col("_s") > 0, deviation / F.col("_s")).otherwise(F.lit(1.0))
    return layout.crossJoin(F.broadcast(s)).select("component_id", (F.col("x") * factor).alias("x"), (F.col("y") * factor).alias("y"))


def scale_to_one(layout: DataFrame) -> DataFrame:
    """Both axes less the mean of x, then by the factor that brings the farthest of either to 1."""
    m = layout.agg(F.avg("x").alias("_m"))
    moved = layout.crossJoin(F.broadcast(m)).select("component_id", (F.col("x") - F.col("_m")).alias("x"), (F.col("y") - F.col("_m")).alias("y"))
    top = moved.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("_t"))
    return moved.crossJoin(F.broadcast(top)).select("component_id", *[F.when(F.col("_t") > 0, F.col(c) / F.col("_t")).otherwise(F.col(c)).alias(c) for c in ("x", "y")])


# layouts in the driver


def _arrays(p: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row places, column places, values) of a distribution of a checked size."""
    n = p.count()
    if n > MOST_ENTRIES:
        raise ValueError(f"{n} entries are too many to lay out at once; start from a higher level")
    t = p.select("row_id", "col_id", "p").orderBy("row_id", "col_id").toArrow()
    row, col, v = (t.column(c).to_numpy() for c in ("row_id", "col_id", "p"))
    ids = np.unique(np.concatenate((row, col)))
    if len(ids) > MOST:
        raise ValueError(f"{len(ids)} components are too many to lay out at once; start from a higher level")
    return ids, np.searchsorted(ids, row), np.searchsorted(ids, col), v


def _start(ids: np.ndarray, layout: DataFrame | None, seed: int, size: float) -> np.ndarray:
    if layout is None:
        return np.random.default_rng(seed).uniform(-size, size, (len(ids), 2))
    rows = {r["component_id"]: (r["x"], r["y"]) for r in layout.select("component_id", "x", "y").collect()}
    if set(rows) != set(ids.tolist()):
        raise ValueError("the first layout and the distribution have different components")
    return np.array([rows[i] for i in ids.tolist()])


def _table(spark: SparkSession, ids: np.ndarray, y: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, y, strict=True)], "component_id long, x double, y double")


def spectral(p: DataFrame, rounds: int = 300, tolerance: float = 1e-6) -> DataFrame:
    """The two eigenvectors of the normalised Laplacian after the trivial one; over EXACT components by iteration on a block of vectors."""
    ids, row, col, v = _arrays(p)
    n = len(ids)
    d = 1 / np.sqrt(np.maximum((np.bincount(row, v, n) + np.bincount(col, v, n)) / 2, 1e-12))
    w = v * d[row] * d[col] / 2
    if n <= EXACT:
        a = np.zeros((n, n))
        np.add.at(a, (row, col), w)
        vec = np.linalg.eigh(np.eye(n) - (a + a.T))[1][:, 1:3]
    else:
        first = (1 / d) / np.linalg.norm(1 / d)
        x = np.random.default_rng(0).standard_normal((n, 6))
        times = lambda y: np.stack([np.bincount(row, w * y[col, j], n) + np.bincount(col, w * y[row, j], n) for j in range(y.shape[1])], axis=1)
        before = np.zeros(2)
        for _ in range(rounds):
            for _ in range(4):
                x = (x + times(x)) / 2  # eigenvalues from 0 to 1, the wanted ones next to 1
            x -= np.outer(first, first @ x)
            x = np.linalg.qr(x)[0]
            values, turn = np.linalg.eigh(x.T @ times(x))
            x = x @ turn[:, ::-1]
            if np.abs(values[::-1][:2] - before).max() < tolerance:
                break
            before = values[::-1][:2]
        vec = x[:, :2]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])]) if n else vec
    return _table(p.sparkSession, ids, vec if vec.shape[1] == 2 else np.zeros((n, 2)))


def _repulsion(y: np.ndarray) -> tuple[np.ndarray, float]:
    """Of each place the sum of q^2 times the difference to every other, and the sum of all q = 1 / (1 + d^2), d being distances."""
    n = len(y)
    z, push = 0.0, np.zeros_like(y)
    for a in range(0, n, 2048):
        q = 1 / (1 + (y[a : a + 2048, None, 0] - y[None, :, 0]) ** 2 + (y[a : a + 2048, None, 1] - y[None, :, 1]) ** 2)
        q[np.arange(len(q)), np.arange(a, a + len(q))] = 0
        z += q.sum()
        q *= q
        push[a : a + 2048] = q.sum(1)[:, None] * y[a : a + 2048] - q @ y
    return push, float(z)


def _interpolated(y: np.ndarray) -> tuple[np.ndarray, float]:
    """As `_repulsion`, with the kernels interpolated between the nodes of a grid, whose mutual sums are a convolution."""
    low = y.min(0)
    side = float((y.max(0) - low).max()) + 1e-9
    cells = int(min(max(GRID[0], math.ceil(side)), GRID[1]))
    step = side / cells
    many = cells * NODES
    at = np.minimum(((y - low) / step).astype(np.int64), cells - 1)
    inner = (np.arange(NODES) + 0.5) / NODES
    rest = (y - low) / step - at
    # Lagrange weights of a place on the nodes of its cell, along each side
    weights = np.ones((2, len(y), NODES))
    for i in range(NODES):
        for j in range(NODES):
            if i != j:
                weights[:, :, i] *= ((rest - inner[j]) / (inner[i] - inner[j])).T
    cell = (at[:, 0, None, None] * NODES + np.arange(NODES)[:, None]) * many + at[:, 1, None, None] * NODES + np.arange(NODES)
    both = weights[0][:, :, None] * weights[1][:, None, :]
    gap = np.concatenate((np.arange(many), np.arange(-many, 0))) * (step / NODES)
    square = gap[:, None] ** 2 + gap[None] ** 2
    kernels = [np.fft.rfft2(1 / (1 + square)), np.fft.rfft2(1 / (1 + square) ** 2)]

    def summed(kernel: np.ndarray, charge: np.ndarray) -> np.ndarray:
        grid = np.zeros((2 * many, 2 * many))
        grid[:many, :many] = np.bincount(cell.ravel(), (both * charge[:, None, None]).ravel(), many * many).reshape(many, many)
        field_ = np.fft.irfft2(np.fft.rfft2(grid) * kernel, grid.shape)[:many, :many].ravel()
        return (field_[cell] * both).sum((1, 2))

    one = np.ones(len(y))
    z = float(summed(kernels[0], one).sum() - len(y))
    q = summed(kernels[1], one)
    return q[:, None] * y - np.stack([summed(kernels[1], y[:, i]) for i in range(2)], axis=1), z


def tsne(p: DataFrame, iterations: int | None = None, layout: DataFrame | None = None, seed: int = 1, on_step=None) -> DataFrame:
    """Stochastic neighbour embedding of a symmetric distribution (row_id, col_id, p), with repulsion that is exact up to EXACT components.

    Attraction is exaggerated in the first quarter. A single component lies at the origin. `on_step(iteration, ids, places)` may return True to stop.
    """
    ids, row, col, v = _arrays(p)
    n = len(ids)
    if n <= 1:
        return _table(p.sparkSession, ids, np.zeros((n, 2)))
    iterations = iterations or (500 if n < 100 else 1000 if n < 100_000 else 2000)
    v = v / v.sum()
    y = _start(ids, layout, seed, 1e-2)
    speed, gain = np.zeros_like(y), np.ones_like(y)
    more = min(20.0, max(4.0, 4 + n / 60_000))
    rate = max(n / more / 4, 50.0)
    for i in range(iterations):
        k = more if i < iterations // 4 else 1.0
        d = y[row] - y[col]
        pull = (v * k / (1 + (d * d).sum(1)))[:, None] * d
        grad = np.stack([np.bincount(row, pull[:, j], n) for j in range(2)], axis=1)
        push, z = (_repulsion if n <= EXACT else _interpolated)(y)
        grad = 4 * (grad - push / max(z, 1e-12))
        gain = np.maximum(np.where(np.sign(grad) != np.sign(speed), gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if i < iterations // 4 else 0.8) * speed - rate * gain * grad
        y = y + speed
        y -= y.mean(0)
        if on_step is not None and on_step(i, ids, y):
            break
    return _table(p.sparkSession, ids, y)


def curve(spread: float = 1.0, min_dist: float = 0.1) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted to a plateau up to min_dist and an exponential beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    goal = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    best = (np.inf, 1.0, 1.0)
    a0, a1, b0, b1 = 0.1, 5.0, 0.3, 2.0
    for _ in range(6):
        for a in np.linspace(a0, a1, 25):
            for b in np.linspace(b0, b1, 25):
                e = float(((1 / (1 + a * x ** (2 * b)) - goal) ** 2).sum())
                best = min(best, (e, float(a), float(b)))
        wa, wb = (a1 - a0) / 8, (b1 - b0) / 8
        a0, a1, b0, b1 = max(0.01, best[1] - wa), best[1] + wa, max(0.05, best[2] - wb), best[2] + wb
    return best[1], best[2]


def umap(p: DataFrame, epochs: int | None = None, layout: DataFrame | None = None, seed: int = 123456, negatives: int = 5, on_step=None) -> DataFrame:
    """Layout of a symmetric fuzzy graph (row_id, col_id, p) by sampled attraction and repulsion; all epochs run."""
    ids, row, col, v = _arrays(p)
    n = len(ids)
    if n <= 1:
        return _table(p.sparkSession, ids, np.zeros((n, 2)))
    epochs = epochs or (250 if n < 100 else 500 if layout is None else 175)
    a, b = curve()
    rng = np.random.default_rng(seed)
    y = _start(ids, layout, seed, 10.0)
    chance = v / v.max()
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        on = np.flatnonzero(rng.random(len(v)) < chance)
        i, j = row[on], col[on]
        d = y[i] - y[j]
        s = (d * d).sum(1)
        pull = np.clip((-2 * a * b * s ** np.maximum(b - 1, 0) / (1 + a * s**b) if b >= 1 else -2 * a * b * np.where(s > 0, s, 1) ** (b - 1) / (1 + a * s**b))[:, None] * d, -4, 4) * (s > 0)[:, None]
        move = np.stack([np.bincount(i, pull[:, c], n) - np.bincount(j, pull[:, c], n) for c in range(2)], axis=1)
        for _ in range(negatives):
            k = rng.integers(0, n, len(i))
            d = y[i] - y[k]
            s = (d * d).sum(1)
            push = np.clip((2 * b / ((0.001 + s) * (1 + a * s**b)))[:, None] * d, -4, 4) * (i != k)[:, None]
            move += np.stack([np.bincount(i, push[:, c], n) for c in range(2)], axis=1)
        y = y + rate * np.clip(move, -4, 4)
        if on_step is not None and on_step(epoch, ids, y):
            break
    return _table(p.sparkSession, ids, y)


def start(kind: str, p: DataFrame, points: DataFrame | None = None, seed: int = 1, deviation: float = 1e-4) -> DataFrame:
    """A first layout of a distribution's components: RANDOM, SPECTRAL, or PCA of their `points` (component_id, features); scaled to a deviation."""
    one_of("init", kind, EMBEDDING_INITS)
    if kind == "SPECTRAL":
        return scale_to_deviation(spectral(p), deviation)
    if kind == "PCA":
        if points is None:
            raise ValueError("PCA needs the components' features")
        return scale_to_deviation(pca(points, id_col="component_id"), deviation)
    return random_layout(p.select(F.col("row_id").alias("component_id")).union(p.select("col_id")).distinct(), seed, deviation)


def embed(p: DataFrame, kind: str = "TSNE", layout: DataFrame | None = None, **options) -> DataFrame:
    return {"TSNE": tsne, "UMAP": umap}[one_of("embedding", kind, EMBEDDINGS)](p, layout=layout, **options)
