"""Exact substring dedup with difference-cover anchors.

{0, 1, 3, 9} is a difference cover modulo 13: for any two positions some step below 13 takes both to positions whose remainders
lie in it. So two equal runs of 20 words share an aligned anchor, 8 words at such a position, and only 4 of 13 positions
are hashed. Anchors that occur once are done; around the others the runs of 20 words are hashed whole (128 bits), and a run that
starts earlier elsewhere marks its words.

Texts are packed into blocks, a table in the shared folder bucketed by block, and never move again. Blocks send sorted hashes, cut by
range into buckets, each hash once a block, so that a passage that a third of the documents hold is as many entries as there are blocks. A
bucket answers with one bit an entry. Each phase has as many buckets as what it sends asks for; blocks and buckets both grow with the input up to a bound, as
messages are blocks times buckets.

Runs of words are held equal if their 128-bit XXH3 hashes are: the words themselves aren't compared again. Among n runs two different ones
share a hash with a chance of about n*n/2**129 (1e-13 for 1e13 runs).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import TABLES, bound_batches, cut, read, runs, shared_dir, slices

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of a block's text and of a bucket's hashes, at least and at most, and about how many blocks and buckets there are in between.
BLOCK_BYTES = 1 << 20, 8 << 20
BUCKET_BYTES = 8 << 20, 64 << 20
MANY_BLOCKS, MANY_BUCKETS = 8192, 2048
#: Text of the blocks that one task reads, about.
TASK_BYTES = 8 << 20
NO_ID = (1 << 63) - 1
COPIES, ANCHORS, WINDOWS = 0, 1, 2


def pack(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, ids, texts): the rows of each input task in blocks of about `block_bytes`; null ids rank last, null texts are empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in slices(whole, "text", block_bytes):
                one = lambda c, b=b: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([b.column(c)]))
                yield pa.RecordBatch.from_arrays([pa.array([block]), one("doc_id"), one("text")], ["block", "ids", "texts"])
                block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return bound_batches(rows).mapInArrow(work, "block long, ids array<long>, texts array<binary>")


class Words:
    """The words of a text, joined by one space, and where they start and end."""

    def __init__(self, text: bytes) -> None:
        words = text.split()
        self.n = len(words)
        self.joined = b" ".join(words)
        lens = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(lens + 1) - 1
        self.starts = self.ends - lens

    def anchors(self) -> np.ndarray:
        p = np.arange(max(0, self.n - ANCHOR + 1))
        return p[np.isin(p % PERIOD, COVER)] if self.n >= WINDOW else p[:0]

    def hashes(self, at: np.ndarray, words: int, digest) -> bytes:
        joined = self.joined
        return b"".join([digest(joined[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at + words - 1].tolist(), strict=True)])


def _bits(replies: list[dict] | None, phase: int, counts: np.ndarray) -> np.ndarray:
    """The answers to a block's entries of one phase, in the order of its buckets."""
    out = np.zeros(int(counts.sum()), bool)
    ends = np.cumsum(counts)
    for r in replies or []:
        if r["phase"] == phase:
            n = int(counts[r["bucket"]])
            out[ends[r["bucket"]] - n : ends[r["bucket"]]] = np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=n).astype(bool)
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Block:
    """One block's documents, and what it asks in each phase; everything follows from the texts and the answers so far."""

    def __init__(self, ids: list[int | None], texts: list[bytes], replies: list[dict] | None, buckets: dict[int, int]) -> None:
        self.texts, self.replies, self.buckets = texts, replies, buckets
        self.order = np.array([NO_ID if i is None else i for i in ids], np.int64)
        raw = b"".join(map(xxhash.xxh3_128_digest, texts))
        self.copies = self._unique(np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2), np.arange(len(texts)), np.zeros(len(texts), np.int64), COPIES)
        self.words: list[Words | None] = [None] * len(texts)

    def _unique(self, h: np.ndarray, doc: np.ndarray, start: np.ndarray, phase: int) -> dict:
        """Entries (hash, least id) in order of hash; which rows start after an equal one of the block; the entry of each row."""
        row = np.lexsort((start, doc, self.order[doc], h[:, 1], h[:, 0]))
        hh, d = h[row], doc[row]
        head = np.ones(len(row), bool)
        head[1:] = (hh[1:] != hh[:-1]).any(1)
        entry = np.cumsum(head) - 1
        least = self.order[d[head]]
        same_doc = ~head
        same_doc[1:] &= d[1:] == d[:-1]
        late = (self.order[d] > least[entry]) | same_doc
        counts = np.bincount(_bucket(hh[head][:, 0], self.buckets[phase]), minlength=self.buckets[phase])
        return {"hash": hh[head], "least": least, "counts": counts, "row": row, "entry": entry, "late": late}

    def copied(self) -> np.ndarray:
        """Documents whose whole text a smaller id has too."""
        c = self.copies
        out = np.zeros(len(self.texts), bool)
        out[c["row"]] = c["late"] | _bits(self.replies, COPIES, c["counts"])[c["entry"]]
        return out

    def split(self) -> None:
        for i in np.flatnonzero(~self.copied()).tolist():
            self.words[i] = Words(self.texts[i])
        self.at = [w.anchors() if w else np.zeros(0, np.int64) for w in self.words]
        raw = b"".join([w.hashes(at, ANCHOR, xxhash.xxh64_digest) for w, at in zip(self.words, self.at, strict=True) if w])
        all_ = np.frombuffer(raw, ">u8").astype(np.uint64)
        self.anchor, self.of, self.times = np.unique(all_, return_inverse=True, return_counts=True)
        self.anchor_counts = np.bincount(_bucket(self.anchor, self.buckets[ANCHORS]), minlength=self.buckets[ANCHORS])

    def windows(self) -> dict:
        """The runs of words around anchors that occur more than once."""
        again = ((self.times > 1) | _bits(self.replies, ANCHORS, self.anchor_counts))[self.of]
        docs, starts, raw, at = [], [], [], 0
        for i, (w, p) in enumerate(zip(self.words, self.at, strict=True)):
            hot = p[again[at : at + len(p)]]
            at += len(p)
            if len(hot):
                edge = np.zeros(w.n + PERIOD + 1, np.int64)
                np.add.at(edge, np.maximum(hot - PERIOD + 1, 0), 1)
                np.add.at(edge, hot + 1, -1)
                s = np.flatnonzero(np.cumsum(edge)[: w.n - WINDOW + 1] > 0)
                docs.append(np.full(len(s), i))
                starts.append(s)
                raw.append(w.hashes(s, WINDOW, xxhash.xxh3_128_digest))
        self.doc, self.start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, starts))
        return self._unique(np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(-1, 2), self.doc, self.start, WINDOWS)

    def kept(self) -> Iterator[tuple[int, int, bytes]]:
        """(words, words removed, kept words joined) of each document."""
        self.split()
        found = self.windows()
        late = np.zeros(len(self.doc), bool)
        late[found["row"]] = found["late"] | _bits(self.replies, WINDOWS, found["counts"])[found["entry"]]
        cuts = np.searchsorted(self.doc, np.arange(len(self.texts) + 1))
        for i, w in enumerate(self.words):
            if w is None:
                words = self.texts[i].split()
                gone = len(words) >= WINDOW
                yield len(words), len(words) if gone else 0, b"" if gone else b" ".join(words)
                continue
            s = self.start[cuts[i] : cuts[i + 1]][late[cuts[i] : cuts[i + 1]]]
            edge = np.zeros(w.n + 1, np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + WINDOW, -1)
            stay = np.cumsum(edge)[: w.n] == 0
            if not len(s):
                yield w.n, 0, w.joined
                continue
            border = runs(stay)
            parts = [w.joined[w.starts[a] : w.ends[b - 1]] for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True) if stay[a]]
            yield w.n, int((~stay).sum()), b" ".join(parts)


def _blocks(batches: Iterator[pa.RecordBatch], buckets: dict[int, int]) -> Iterator[tuple[int, list, Block]]:
    for b in batches:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            ids = one.column("ids")[0].as_py()
            yield one.column("block")[0].as_py(), ids, Block(ids, one.column("texts")[0].as_py(), one.column("replies")[0].as_py(), buckets)


def _asking(phase: int, buckets: dict[int, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, block in _blocks(batches, buckets):
            if phase == ANCHORS:
                block.split()
                table, counts = block.anchor[:, None], block.anchor_counts
            else:
                if phase == WINDOWS:
                    block.split()
                e = block.copies if phase == COPIES else block.windows()
                table, counts = np.concatenate((e["hash"], e["least"].astype(np.uint64)[:, None]), 1), e["counts"]
            ends = np.cumsum(counts)
            some = np.flatnonzero(counts)
            data = [table[ends[k] - counts[k] : ends[k]].tobytes() for k in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([name] * len(some), pa.int64()), pa.array(data, pa.binary())], ["bucket", "block", "data"])

    return work


def _answering(phase: int):
    width = 1 if phase == ANCHORS else 3

    def work(table: pa.Table) -> pa.Table:
        data = table.column("data").to_pylist()
        cuts = np.cumsum([0, *[len(d) // (8 * width) for d in data]])
        rows = np.frombuffer(b"".join(data), np.uint64).reshape(-1, width)
        order = np.lexsort(rows[:, ::-1].T) if width > 1 else np.argsort(rows[:, 0], kind="stable")
        sorted_ = rows[order]
        out = np.zeros(len(rows), bool)
        if width == 1:
            same = sorted_[1:, 0] == sorted_[:-1, 0]
            out[order[1:][same]] = out[order[:-1][same]] = True
        else:  # ids are signed, so their least is taken apart from the sort
            head = np.ones(len(rows), bool)
            head[1:] = (sorted_[1:, :2] != sorted_[:-1, :2]).any(1)
            ids = sorted_[:, 2].astype(np.int64)
            first = np.minimum.reduceat(ids, np.flatnonzero(head)) if len(ids) else ids
            out[order] = ids > first[np.cumsum(head) - 1]
        masks = [np.packbits(out[a:b]).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        n = len(masks)
        hits = [int(out[a:b].sum()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.table({"hits": pa.array(hits, pa.int64()), "block": table.column("block"), "phase": pa.array([phase] * n, pa.int32()), "bucket": table.column("bucket"), "mask": pa.array(masks, pa.binary())})

    return work


def _between(size: float, many: int, bounds: tuple[int, int]) -> int:
    return int(min(max(size / many, bounds[0]), bounds[1]))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: kept are the words no repeated window covers, joined by one space.

    A window of WINDOW words is repeated if the same words also start earlier: in a row with a smaller id, or earlier in the same row. Null texts have
    no words. Null ids rank last. Rows that share an id are judged apart, neither being earlier than the other. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    name = f"{TABLES}blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.count("*").alias("n")).first()
    size = total["bytes"] or 0
    files = min(max(parts, -(-size // TASK_BYTES)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    packed = pack(docs, id_col, text_col, block_bytes or _between(size, MANY_BLOCKS, BLOCK_BYTES))
    packed.write.bucketBy(files, "block").option("path", f"{shared_dir(spark)}/lamina-scratch/{name}").saveAsTable(name)
    blocks = spark.table(name)
    buckets_for = lambda sent: max(2 * parts, int(sent / _between(sent, MANY_BUCKETS, BUCKET_BYTES)))
    # copies: 24 bytes a text; anchors: 8 bytes each, a word being some 6 bytes
    buckets = {COPIES: buckets_for(24 * total["n"]), ANCHORS: buckets_for(8 * len(COVER) / PERIOD / 6 * size)}
    replies = None

    def with_replies() -> DataFrame:
        if replies is None:
            return blocks.withColumn("replies", F.lit(None).cast("array<struct<phase:int,bucket:int,mask:binary>>"))
        own = replies.groupBy("block").agg(F.collect_list(F.struct("phase", "bucket", "mask")).alias("replies"))
        return blocks.join(own.hint("shuffle_hash"), "block", "left")

    for phase in (COPIES, ANCHORS, WINDOWS):
        if phase == WINDOWS:  # each anchor met again stands for PERIOD windows of 24 bytes at most
            hits = replies.where(F.col("phase") == ANCHORS).agg(F.sum("hits")).first()[0] or 0
            buckets[WINDOWS] = buckets_for(24 * PERIOD * hits)
        asked = with_replies().mapInArrow(_asking(phase, dict(buckets)), "bucket int, block long, data binary")
        answer = cut(asked.groupBy("bucket").applyInArrow(_answering(phase), "hits long, block long, phase int, bucket int, mask binary"), f"replies-{phase}")
        replies = answer if replies is None else replies.union(answer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, block in _blocks(batches, buckets):
            n, gone, kept = zip(*block.kept(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return with_replies().mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and removed words of every document, and the digest of the rest. Rows as for `dedup`."""
    found = dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
