"""Hard negatives by branch and bound over ball trees.

The rows of one label make a ball tree in each block of points: nodes hold a centre and a radius, so that an inner product with any of their rows lies
within q.c - |q| r and q.c + |q| r. Blocks of anchors meet every block of points: a first search finds the anchors' best rows of their own label, a second
one, for each of those scores, the best rows of other labels within its window. A node is left out for an anchor if its bounds miss all windows or
lie strictly beneath the worst of the rows held so far; a greedy descent to one leaf fills these before the whole search.

No pair of rows is ever written, only the best few of an anchor and a block. Anchors alike in vector and label are one query in their block. Of points
alike in both only the least few ids can be among the best, so only these are kept, told before the shuffle. Anchors go
to the blocks of points by broadcast, in waves of bounded size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import cut, read, runs

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Negatives score between LEAST and MOST hundredths of their positive.
LEAST, MOST = 80, 100
LEAF = 128
#: Rows of a block of points, at least and at most, and queries of a block of anchors.
POINTS = 2048, 32_768
QUERIES = 1024
#: Bytes of the queries that are broadcast at once.
WAVE_BYTES = 32 << 20
#: Beneath every score; squared norms stay under it, so scores do.
NONE = -(1 << 62)


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Order of the rows, and of each node its span in it, centre, radius and children (-1: a leaf); a node splits at the median along its widest line."""
    order = np.arange(len(x))
    spans, centres, radii, kids = [], [], [], []

    def grow(a: int, b: int) -> int:
        rows = x[order[a:b]].astype(float)
        centre = rows.mean(0)
        far = np.sqrt(((rows - centre) ** 2).sum(1))
        me = len(spans)
        spans.append((a, b)), centres.append(centre), radii.append(far.max()), kids.append((-1, -1))
        if b - a > leaf and far.max() > 0:
            one = rows[far.argmax()]
            other = rows[((rows - one) ** 2).sum(1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows @ (other - one), half)]
            kids[me] = grow(a, a + half), grow(a + half, b)
        return me

    if len(x):
        grow(0, len(x))
    return {"order": order, "spans": np.array(spans), "centres": np.array(centres), "radii": np.array(radii), "kids": np.array(kids)}


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: by floating point where no sum can pass 2**53, else in 64 bits, where sums that wrap come back."""
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else q.astype(np.int64) @ x.T.astype(np.int64)


class Best:
    """The best rows, (score, id, whether the row is the query's own vector), of each query's windows."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        n = low.size
        self.score, self.id, self.own = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    @property
    def least(self) -> np.ndarray:
        """The least score that still counts in each window."""
        return np.maximum(self.low, self.score[:, -1].reshape(self.low.shape))

    def meet(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Queries q against rows: score and own are (q, row)."""
        low, high, width = self.least[q], self.high[q], self.low.shape[1]
        for w in range(width):
            at, row = np.nonzero((score >= low[:, w, None]) & (score <= high[:, w, None]))
            if len(at):
                self._add(q[at] * width + w, score[at, row], ids[row], own[at, row])

    def _add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        old = np.unique(slot)
        held = np.repeat(old, self.k)
        slot = np.concatenate((held, slot))
        score, ids, own = (np.concatenate((mine[old].ravel(), new)) for mine, new in ((self.score, score), (self.id, ids), (self.own, own)))
        order = np.lexsort((ids, -score, slot))
        heads = runs(slot[order])[:-1]
        place = heads[:, None] + np.arange(self.k)
        self.score[old], self.id[old], self.own[old] = score[order][place], ids[order][place], own[order][place]


class Forest:
    """The trees of one block of points, a tree a label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        by = np.lexsort((ids, labels))
        ids, labels, x = ids[by], labels[by], x[by]
        borders = runs(labels)
        self.labels, self.trees = labels[borders[:-1]], []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            tree = ball_tree(x[a:b], leaf)
            order = a + tree.pop("order")
            norms = (x[order].astype(np.int64) ** 2).sum(1)
            self.trees.append({**tree, "ids": ids[order], "x": x[order], "norms": norms})

    def search(self, q: np.ndarray, q_labels: np.ndarray, best: Best, own_label: bool) -> int:
        """Bring `best` up to date with the rows of the queries' own label, or of all others; the number of products taken."""
        norms = (q.astype(np.int64) ** 2).sum(1)
        taken = 0
        for label, tree in zip(self.labels.tolist(), self.trees, strict=True):
            asked = np.flatnonzero((q_labels == label) == own_label)
            if len(asked):
                taken += self._search(tree, q, norms, asked, best)
        return taken

    def _search(self, tree: dict[str, np.ndarray], q: np.ndarray, norms: np.ndarray, asked: np.ndarray, best: Best) -> int:
        length = np.sqrt(norms.astype(float))
        size = np.sqrt((tree["centres"] ** 2).sum(1)) + tree["radii"]
        exact = length[asked].max() * np.sqrt(float(tree["norms"].max())) < 1 << 52
        taken = 0

        def bounds(at: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
            """Wider than the true ones by more than rounding can be."""
            middle, reach = q[at] @ tree["centres"][node], length[at] * (tree["radii"][node] + 1e-9 * size[node]) + 1
            return middle - reach, middle + reach

        def measure(at: np.ndarray, node: int) -> None:
            nonlocal taken
            a, b = tree["spans"][node]
            score = _products(q[at], tree["x"][a:b], exact)
            own = (score == norms[at, None]) & (tree["norms"][None, a:b] == norms[at, None])
            best.meet(at, score, tree["ids"][a:b], own)
            taken += score.size

        # each query goes down to the leaf that may score highest
        first = np.zeros(len(q), np.int64)
        level = {0: asked}
        while level:
            deeper: dict[int, np.ndarray] = {}
            for node, at in level.items():
                left, right = tree["kids"][node]
                if left < 0:
                    first[at] = node
                    measure(at, node)
                    continue
                to_left = bounds(at, left)[1] >= bounds(at, right)[1]
                deeper.update({n: part for n, part in ((left, at[to_left]), (right, at[~to_left])) if len(part)})
            level = deeper
        stack = [(0, asked)]
        while stack:
            node, at = stack.pop()
            low, high = bounds(at, node)
            open_ = ((high[:, None] >= best.least[at]) & (low[:, None] <= best.high[at])).any(1)
            at = at[open_]
            left, right = tree["kids"][node]
            if left < 0:
                at = at[first[at] != node]
                if len(at):
                    measure(at, node)
            elif len(at):
                ends = [(left, at), (right, at)]
                if bounds(at, left)[1].sum() > bounds(at, right)[1].sum():  # what may score higher comes first
                    ends.reverse()
                stack.extend(ends)
        return taken


def quantized(rows: DataFrame, id_col: str, label_col: str, vector_col: str, anchor: Column) -> DataFrame:
    """(id, label, v, size, anchor) of the rows that take part; v: the components as whole numbers."""
    raw = F.transform(vector_col, lambda x: F.lit(float(SCALE)) * x.cast("double"))
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), raw.alias("f"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    # nulls make the sum null, NaN and infinity pass every bound
    norm = F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x)
    whole = F.transform("f", lambda x: F.floor(x).cast("int"))
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (norm < float(1 << 60))).select("id", "label", whole.alias("v"), F.size("f").alias("size"), "anchor")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, -1)


def _in_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """(vector length, rows) of `most` rows at most; the rows come in the order of the length."""
    held: list[pa.RecordBatch] = []
    size, n = -1, 0

    def emptied() -> Iterator[tuple[int, pa.Table]]:
        if n:
            yield size, pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        borders = runs(batch.column("size").to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            length = batch.column("size")[a].as_py()
            while a < b:
                if n and (length != size or n == most):
                    yield from emptied()
                    held, n = [], 0
                size, step = length, min(b - a, most - n)
                held, n, a = [*held, batch.slice(a, step)], n + step, a + step
    yield from emptied()


def _point_blocks(rows: DataFrame, most: int, leaf: int) -> DataFrame:
    """(size, data): forests of up to `most` rows, about as many labels in each as it takes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, t in _in_blocks(batches, most):
            forest = Forest(t["id"].to_numpy(), t["label"].to_numpy(), _matrix(t["v"].combine_chunks(), len(t)), leaf)
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([pickle.dumps(forest)], pa.binary())], ["size", "data"])

    return rows.mapInArrow(work, "size int, data binary")


def _query_blocks(rows: DataFrame, most: int) -> DataFrame:
    """(block, size, bytes, data): distinct vectors and labels of up to `most` anchors, and which anchor asks which."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for size, t in _in_blocks(batches, most):
            x, labels = _matrix(t["v"].combine_chunks(), len(t)), t["label"].to_numpy()
            _, first, of = np.unique(np.column_stack((labels, x)), axis=0, return_index=True, return_inverse=True)
            data = pickle.dumps({"x": x[first], "labels": labels[first], "ids": t["id"].to_numpy(), "of": of.ravel()})
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size], pa.int32()), pa.array([len(data)]), pa.array([data], pa.binary())], ["block", "size", "bytes", "data"])
            block += 1

    return rows.mapInArrow(work, "block long, size int, bytes long, data binary")


def _waves(queries: DataFrame) -> list[DataFrame]:
    """The blocks of anchors in parts of WAVE_BYTES at most (a block alone may be more, but none is over 1,024 vectors); one short row a block is read here."""
    waves, held = [[]], 0
    for r in queries.select("block", "bytes").orderBy("block").collect():
        if held and held + r["bytes"] > WAVE_BYTES:
            waves.append([])
            held = 0
        waves[-1].append(r["block"])
        held += r["bytes"]
    return [queries.where(F.col("block").between(w[0], w[-1])) for w in waves if w]


def _searched(points: DataFrame, queries: DataFrame, k: int, own_label: bool) -> DataFrame:
    """(block, q, w, score, id, own): the k best rows of each query's windows (for its own label one that is open to both sides)."""
    fields = {"block": pa.int64(), "q": pa.int32(), "w": pa.int32(), "score": pa.int64(), "id": pa.int64(), "own": pa.bool_()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                forest, asked = pickle.loads(b.column("points")[i].as_py()), pickle.loads(b.column("data")[i].as_py())
                n = len(asked["labels"])
                low, high = (np.full((n, 1), NONE), np.full((n, 1), -NONE)) if own_label else (asked["low"], asked["high"])
                best = Best(low, high, k)
                forest.search(asked["x"], asked["labels"], best, own_label)
                slot, place = np.nonzero(best.score > NONE)
                width = low.shape[1]
                columns = [np.full(len(slot), b.column("block")[i].as_py()), slot // width, slot % width, best.score[slot, place], best.id[slot, place], best.own[slot, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))

    found = None
    for wave in _waves(queries):
        pairs = points.withColumnRenamed("data", "points").join(F.broadcast(wave.select("block", "size", "data")), "size")
        one = pairs.mapInArrow(work, "block long, q int, w int, score long, id long, own boolean")
        found = one if found is None else found.union(one)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "block long, q int, w int, score long, id long, own boolean")
    order = Window.partitionBy("block", "q", "w").orderBy(F.desc("score"), "id", F.desc("own"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _with(queries: DataFrame, found: DataFrame, name: str) -> DataFrame:
    lists = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("q", "w", "place", "score", "id", "own"))).alias(name))
    return queries.join(lists, "block", "left")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give each query the windows of its best rows' scores, those not taken an empty one."""
    for b in batches:
        for i in range(b.num_rows):
            asked, rows = pickle.loads(b.column("data")[i].as_py()), b.column("best")[i].as_py() or []
            n = len(asked["labels"])
            scores = np.full((n, POSITIVES + 1), NONE)
            for r in rows:
                scores[r["q"], r["place"] - 1] = r["score"]
            low = np.where(scores > NONE, scores // MOST * LEAST - (-LEAST * (scores % MOST) // MOST), -NONE)
            asked |= {"low": low, "high": scores}
            data = pickle.dumps(asked)
            yield pa.RecordBatch.from_arrays([pa.array([b.column("block")[i].as_py()]), pa.array([b.column("size")[i].as_py()], pa.int32()), pa.array([len(data)]), pa.array([data], pa.binary())], ["block", "size", "bytes", "data"])


RESULT = {"anchor_id": pa.int64(), "positive_id": pa.int64(), "rank": pa.int32(), "negative_id": pa.int64(), "positive_score": pa.int64(), "negative_score": pa.int64()}


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            asked = pickle.loads(b.column("data")[i].as_py())
            positives: dict[int, list] = {}
            negatives: dict[tuple[int, int], list] = {}
            for r in b.column("best")[i].as_py() or []:
                positives.setdefault(r["q"], []).append((r["score"], r["id"], r["own"]))
            for r in b.column("others")[i].as_py() or []:
                negatives.setdefault((r["q"], r["w"]), []).append((r["id"], r["score"]))
            out = []
            for anchor, q in zip(asked["ids"].tolist(), asked["of"].tolist(), strict=True):
                others = [(w, score, id_) for w, (score, id_, own) in enumerate(positives.get(q, [])) if not (own and id_ == anchor)]
                for w, score, id_ in others[:POSITIVES]:
                    out += [(anchor, id_, k + 1, n, score, s) for k, (n, s) in enumerate(negatives.get((q, w), []))]
            columns = list(zip(*out, strict=True)) or [()] * len(RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RESULT.values(), strict=True)], list(RESULT))


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", points: int | None = None, queries: int = QUERIES, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which `anchor` holds.

    Components become floor(256 x); scores are integer inner products, higher ones first and ties by id. Rows with a null id, label or vector, a null or non-finite component, or a squared
    norm of 2**60 and more after scaling take no part. Only vectors of one length are compared. Rows alike in id, label and vector count once; other rows that
    share an id are rows of their own, which the other may have as its positive or negative. Anchors without positives, and positives without negatives within their window, return no row. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = cut(quantized(rows, id_col, label_col, vector_col, anchor).dropDuplicates(["id", "label", "v"]), "vectors")
    n = known.count()
    most = points or min(max(n // (4 * parts), POINTS[0]), POINTS[1])
    alike = Window.partitionBy("label", "v").orderBy("id")
    useful = known.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= POSITIVES + 1).drop("_n", "anchor")
    dealt = lambda df, rows_: df.repartitionByRange(max(1, min(-(-n // rows_), 1 << 16)), "size", "label", "id").sortWithinPartitions("size", "label", "id")
    trees = cut(_point_blocks(dealt(useful, 4 * most), most, leaf), "ball-trees")
    asked = cut(_query_blocks(dealt(known.where("anchor").drop("anchor"), 100 * 4 * queries), queries), "anchors")
    best = cut(_searched(trees, asked, POSITIVES + 1, own_label=True), "positives")
    windows = cut(_with(asked, best, "best").mapInArrow(_windows, "block long, size int, bytes long, data binary"), "windows")
    others = _searched(trees, windows, NEGATIVES, own_label=False)
    both = _with(_with(asked, best, "best"), others, "others")
    return both.mapInArrow(_triples, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (ids divisible by 100) among all rows; every seventh row takes the next label first. Rows as for `mine`."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
