"""What the corpus operators share: word rules, scratch tables in the shared folder, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lamina.scratch import TABLES, clear_scratch, cut, shared_dir

__all__ = ["TABLES", "WORD", "bound_batches", "clear_scratch", "cut", "joined", "read", "runs", "shared_dir", "shingles", "slices", "unused"]

#: A word is a run of anything but ASCII white space; `bytes.split()` uses just this set.
WORD = r"[^\x20\x09-\x0D]+"


def shingles(text: bytes, k: int) -> list[bytes]:
    """Runs of k words of a text whose A-Z are lower-cased, joined by one space; the whole sequence if there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [joined]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch, at most: texts are long, and a batch of the default 10,000 lies in memory several times over.
BATCH_ROWS = 1000


def bound_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batch size to BATCH_ROWS if it is larger; it stays so for later queries."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the values of a binary or string column add up to `most_bytes`; a longer value stands alone."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    offsets = _offsets(col)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = max(start + 1, min(end, start + most_rows, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, led by as many underscores as it takes for none to be a column's, whatever its case."""
    taken = {c.lower() for c in columns}
    lead = "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the length at the end."""
    if len(keys) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`label` (the least row that each row reaches) after the links (a, b)."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
