"""Suffix-array dedup of byte strings by deep-shallow sorting.

Every window of WINDOW bytes has one anchor: of the grams of GRAM bytes in it the one with the least hash, the leftmost if there are several; grams that a sample of
the texts holds often come after all others. Equal windows so have their anchors at the same offset. A piece is a run of windows with one
anchor. Two windows of two pieces are equal if the anchors' suffixes agree far enough to the right, and their prefixes, read backwards, to the left.

So suffixes and backward prefixes are sorted at anchors only, of pieces of one anchor hash in one bucket: multikey quicksort (characters of 8 bytes, all groups a
step at a time) to SHALLOW bytes, then a blind trie for each group that is still together. Both give the lengths of common prefixes; at each offset runs of
neighbours that agree far enough are classes, and a window is repeated if another has both its classes.

Texts are packed into blocks of a bucketed table and never move again. Blocks tell buckets the hashes of whole texts, then of anchors with their numbers of
pieces; only pieces of anchors met again are sent, each once a block. Anchors with more pieces than a bucket should hold have their windows hashed (128 bits)
one by one instead, each once a block, so that no passage, however many documents hold it or nearly hold it, is one task's work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import TABLES, bound_batches, cut, read, runs, shared_dir
from lamina.llm.substrings import BLOCK_BYTES, BUCKET_BYTES, MANY_BLOCKS, MANY_BUCKETS, TASK_BYTES, _between, _bucket, pack

WINDOW = 400
GRAM = 32
#: Bytes that multikey quicksort sorts by.
SHALLOW = 32
#: Starts of windows that are looked at together; a position takes so many bits of a sort key.
CHUNK_BITS = 19
#: Bytes of a bucket's pieces, at least: sorting takes some ten times as much memory.
PIECE_BYTES = 2 << 20
#: Pieces of an anchor that one bucket compares, at most.
HOT = 4096
#: Documents that tell which grams are common, how much of each is looked at, and in how many of them a common gram is. Only the choice of anchors hangs on it, no result.
SAMPLE, SAMPLE_BYTES, COMMON = 4000, 4096, 8
COMMON_BITS = 22
COPIES, ANCHORS, PIECES, WINDOWS = range(4)
#: Fixed values of the hash of grams: its base, which is odd, and a multiplier that mixes.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


UP, DOWN = (_powers(b, (1 << CHUNK_BITS) + WINDOW + 1) for b in (BASE, pow(BASE, -1, 1 << 64)))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the gram at each place of at most a chunk and a window of bytes."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * UP[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:n]) * DOWN[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, common: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Hash and place of each piece's anchor, and its first and last start of a window."""
    out = []
    whole, low = np.frombuffer(text, np.uint8), np.uint64((1 << CHUNK_BITS + 1) - 1)
    for a in range(0, len(text) - WINDOW + 1, 1 << CHUNK_BITS):
        part = whole[a : a + (1 << CHUNK_BITS) + WINDOW - 1]
        h = gram_hashes(part)
        key = h >> np.uint64(1)
        if common is not None:
            key |= common[(h >> np.uint64(64 - COMMON_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
        key &= ~low
        key |= np.arange(len(key), dtype=np.uint64)
        least, width = key, 1
        while 2 * width <= WINDOW - GRAM + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = WINDOW - GRAM + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        at = (least & low).astype(np.int64)
        borders = runs(at)
        place = at[borders[:-1]]
        # the least hashes are all small, so they are spread anew
        spread = h[place] * np.uint64(BASE)
        out.append(((spread ^ spread >> np.uint64(32)) * np.uint64(MIX), place + a, borders[:-1] + a, borders[1:] - 1 + a))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# Deep-shallow sorting.


def multikey(chars: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of the rows of `chars` (n, levels) and the spans of rows alike in all levels: three-way splits by a pivot's character, all groups at once."""
    n, levels = chars.shape
    order, together = np.arange(n), []
    starts, sizes, level = np.array([0]), np.array([n]), np.array([0])
    while True:
        done = (sizes <= 1) | (level == levels)
        together += [(a, a + s) for a, s in zip(starts[done].tolist(), sizes[done].tolist(), strict=True) if s > 1]
        starts, sizes, level = starts[~done], sizes[~done], level[~done]
        if not len(starts):
            return order, sorted(together)
        group = np.repeat(np.arange(len(starts)), sizes)
        at = starts[group] + np.arange(len(group)) - (np.cumsum(sizes) - sizes)[group]
        rows = order[at]
        char = chars[rows, level[group]]
        thirds = [chars[order[starts + (sizes - 1) * k // 2], level] for k in range(3)]
        pivot = np.maximum(np.minimum(thirds[0], thirds[1]), np.minimum(np.maximum(thirds[0], thirds[1]), thirds[2]))[group]
        side = 3 * group + 1 + (char > pivot) - (char < pivot)
        new = np.argsort(side, kind="stable")
        order[at] = rows[new]
        borders = runs(side[new])
        head = side[new][borders[:-1]]
        starts, sizes = at[borders[:-1]], np.diff(borders)
        level = level[head // 3] + (head % 3 == 1)


class BlindTrie:
    """Strings in order: nodes know only the depth at which their children part and the character each child has there (-1: the end)."""

    def __init__(self, texts: list[bytes], numbers: list[int], width: int) -> None:
        self.texts, self.numbers, self.bits = texts, numbers, 8 * width
        self.root: list | int | None = None
        self.same: dict[int, list[int]] = {}

    def _char(self, i: int, depth: int) -> int:
        return self.texts[i][depth] if depth < len(self.texts[i]) else -1

    def common(self, i: int, j: int) -> int:
        return min((self.bits - (self.numbers[i] ^ self.numbers[j]).bit_length()) // 8, len(self.texts[i]), len(self.texts[j]))

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = i
            return
        node = self.root
        while not isinstance(node, int):  # blindly: only the characters at the nodes' depths are looked at
            kids = node[1]
            node = kids.get(self._char(i, node[0]))
            if node is None:
                node = next(iter(kids.values()))
        leaf, depth = node, self.common(i, node)
        if depth == len(self.texts[i]) == len(self.texts[leaf]):
            self.same.setdefault(leaf, []).append(i)
            return
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < depth:
            above, node = node, node[1][self._char(i, node[0])]
        if not isinstance(node, int) and node[0] == depth:
            node[1][self._char(i, depth)] = i
            return
        new = [depth, {self._char(leaf, depth): node, self._char(i, depth): i}]
        if above is None:
            self.root = new
        else:
            above[1][self._char(i, above[0])] = new

    def walk(self) -> Iterator[tuple[int, int]]:
        """(string, characters in common with the one before) in order; the first has 0."""
        stack: list[tuple[list | int, int]] = [(self.root, 0)]
        while stack:
            node, common = stack.pop()
            if isinstance(node, int):
                yield node, common
                for i in self.same.get(node, []):
                    yield i, len(self.texts[i])
                continue
            kids = [node[1][c] for c in sorted(node[1])]
            stack.extend((kid, node[0]) for kid in kids[:0:-1])
            stack.append((kids[0], common))


def deep_shallow(keys: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the texts (at most WINDOW bytes) by key and text, and what each has in common with the one before in it (-1: another key)."""
    n = len(texts)
    bytes_ = np.zeros((n, WINDOW), np.uint8)
    for a in range(0, n, 1024):
        bytes_[a : a + 1024] = np.frombuffer(b"".join([t.ljust(WINDOW, b"\0") for t in texts[a : a + 1024]]), np.uint8).reshape(-1, WINDOW)
    chars = np.concatenate((keys[:, None], bytes_[:, :SHALLOW].copy().view(">u8").astype(np.uint64)), 1)
    lens = np.fromiter(map(len, texts), np.int64, n)
    # ends that look like zero bytes come before them
    order, together = multikey(np.concatenate((chars, np.minimum(lens, SHALLOW)[:, None].astype(np.uint64)), 1))
    common = np.full(n, -1)
    before, here = order[:-1], order[1:]
    apart = (bytes_[before, :SHALLOW] != bytes_[here, :SHALLOW]) if n > 1 else np.zeros((0, SHALLOW), bool)
    agree = np.where(apart.any(1), apart.argmax(1), SHALLOW)
    common[1:] = np.where(keys[before] == keys[here], np.minimum(np.minimum(agree, lens[before]), lens[here]), -1)
    for a, b in together:
        rows = order[a:b].tolist()
        trie = BlindTrie([texts[i] for i in rows], [int.from_bytes(bytes_[i].tobytes(), "big") for i in rows], WINDOW)
        for i in range(b - a):
            trie.insert(i)
        for place, (i, shared) in enumerate(trie.walk()):
            order[a + place] = rows[i]
            if place:
                common[a + place] = shared
    return order, common


def repeated(keys: np.ndarray, low: np.ndarray, high: np.ndarray, pieces: list[bytes], times: np.ndarray) -> np.ndarray:
    """(piece, offset of the anchor in the window) of all repeated windows as a table of truth; pieces hold the windows with offsets `low` to `high`."""
    n, wide = len(pieces), WINDOW - GRAM + 1
    steps = np.arange(wide)
    has = (steps >= low[:, None]) & (steps <= high[:, None])
    out = has & (times > 1)[:, None]
    if n < 2:
        return out
    sides = []
    for cut_ in (lambda p, h: p[h:], lambda p, h: p[:h][::-1]):  # one side's texts in memory at a time
        order, common = deep_shallow(keys, list(map(cut_, pieces, high.tolist())))
        most = np.zeros(n, np.int64)
        most[order] = np.maximum(common, np.append(common[1:], -1))
        sides.append((order, common, most))
    (r_order, r_common, r_most), (l_order, l_common, l_most) = sides
    for d in range(wide):
        some = np.flatnonzero(has[:, d] & (r_most >= WINDOW - d) & (l_most >= d))
        if len(some) < 2:
            continue
        right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        right[r_order] = np.cumsum(r_common < WINDOW - d)
        left[l_order] = np.cumsum(l_common < d)
        both = right[some] * (n + 1) + left[some]
        _, of, count = np.unique(both, return_inverse=True, return_counts=True)
        out[some[count[of] > 1], d] = True
    return out


# Blocks and buckets.


def _wrapped(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _unwrapped(data: bytes | pa.Buffer, *kinds: str) -> list[np.ndarray]:
    """Views of the arrays; nothing is copied."""
    lens = np.frombuffer(data, np.int64, len(kinds)).tolist()
    starts = np.cumsum([8 * len(kinds), *lens]).tolist()
    return [np.frombuffer(data, k, n // np.dtype(k).itemsize, a) for a, n, k in zip(starts, lens, kinds, strict=False)]


class Block:
    """One block's documents and what it asks in each phase; all follows from the texts and the answers so far."""

    def __init__(self, texts: list[bytes], replies: list[dict] | None, buckets: dict[int, int], common: np.ndarray | None) -> None:
        self.texts, self.replies, self.buckets, self.common = texts, replies or [], buckets, common
        raw = b"".join(map(xxhash.xxh3_128_digest, texts))
        self.copies = self._entries(np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2), COPIES)
        self.long = np.array([len(t) >= WINDOW for t in texts])

    def _entries(self, h: np.ndarray, phase: int) -> dict:
        """Distinct hashes in order, the entry of each row, how many rows it has, and entries a bucket."""
        unique, first, of, times = np.unique(h, axis=0, return_index=True, return_inverse=True, return_counts=True)
        counts = np.bincount(_bucket(unique if unique.ndim == 1 else unique[:, 0], self.buckets[phase]), minlength=self.buckets[phase])
        return {"hash": unique, "first": first, "of": of.ravel(), "times": times, "counts": counts}

    def _bits(self, phase: int, counts: np.ndarray) -> np.ndarray:
        """Two answers to each entry of a phase."""
        out, ends = np.zeros((2, int(counts.sum())), bool), np.cumsum(counts)
        for r in self.replies:
            if r["phase"] == phase:
                n, end = int(counts[r["bucket"]]), ends[r["bucket"]]
                out[:, end - n : end] = np.unpackbits(np.frombuffer(r["data"], np.uint8), count=2 * n).reshape(2, n)
        return out

    def copied(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose whole text another has too, and those that are compared further: of equal ones only the first."""
        c = self.copies
        again, elsewhere = self._bits(COPIES, c["counts"])
        first = np.zeros(len(self.texts), bool)
        first[c["first"]] = ~elsewhere
        return ((c["times"] > 1) | again)[c["of"]], first & self.long

    def find_anchors(self) -> None:
        found = [(i, anchors(self.texts[i], self.common)) for i in np.flatnonzero(self.copied()[1]).tolist()]
        self.doc = np.repeat(np.array([i for i, _ in found], np.int64), [len(f[0]) for _, f in found])
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        self.hash, self.place, self.first, self.last = (np.concatenate([np.zeros(0, k), *[f[j] for _, f in found]]) for j, k in enumerate(kinds))
        self.anchor = self._entries(self.hash, ANCHORS)

    def piece(self, i: int) -> bytes:
        return self.texts[self.doc[i]][self.first[i] : self.last[i] + WINDOW]

    def different(self) -> np.ndarray:
        """The number of different pieces of each anchor."""
        mark = np.array([xxhash.xxh3_64_intdigest(self.piece(i)) for i in range(len(self.doc))], np.uint64)
        return np.bincount(np.unique(np.stack((self.anchor["of"].astype(np.uint64), mark)), axis=1)[0].astype(np.int64), minlength=len(self.anchor["times"]))

    def met_again(self) -> tuple[np.ndarray, np.ndarray]:
        """Pieces whose anchors are met again, and those of them whose anchors have many pieces."""
        again, hot = self._bits(ANCHORS, self.anchor["counts"])[:, self.anchor["of"]]
        return np.flatnonzero(again & ~hot), np.flatnonzero(hot)

    def sent_pieces(self, some: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The pieces for each bucket, each different one once with the places of all its copies."""
        seen: dict[tuple, int] = {}
        of = np.array([seen.setdefault((int(self.place[i] - self.first[i]), self.piece(i)), len(seen)) for i in some.tolist()], np.int64)
        first = some[np.unique(of, return_index=True)[1]]
        bucket = _bucket(self.hash[first], self.buckets[PIECES])
        by_piece = np.argsort(of, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(first))))
        order = np.argsort(bucket, kind="stable")
        borders = runs(bucket[order])
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            own = order[a:b]
            rows = some[np.concatenate([by_piece[ends[p] : ends[p + 1]] for p in own.tolist()])]
            lead = first[own]
            texts = [self.piece(i) for i in lead.tolist()]
            high, low = self.place[lead] - self.first[lead], self.place[lead] - self.last[lead]
            blob = np.frombuffer(b"".join(texts), np.uint8)
            yield int(bucket[own[0]]), _wrapped(self.hash[lead], low.astype(np.int32), high.astype(np.int32), np.diff(ends)[own].astype(np.int32), self.doc[rows].astype(np.int32), self.place[rows].astype(np.int32), blob)

    def windows(self, some: np.ndarray) -> dict:
        """The windows of pieces with hot anchors; pieces alike are hashed once."""
        known: dict[bytes, bytes] = {}
        raw, docs, starts = [], [], []
        for i in some.tolist():
            piece = self.piece(i)
            if piece not in known:
                known[piece] = b"".join([xxhash.xxh3_128_digest(piece[s : s + WINDOW]) for s in range(len(piece) - WINDOW + 1)])
            raw.append(known[piece])
            starts.append(np.arange(self.first[i], self.last[i] + 1))
            docs.append(np.full(len(starts[-1]), self.doc[i]))
        self.window_doc, self.window_start = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (docs, starts))
        return self._entries(np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(-1, 2), WINDOWS)

    def removed(self) -> list[np.ndarray]:
        """Of each document the spans (start, end) to remove, joined and in order."""
        copied, _ = self.copied()
        spans = [np.array([[0, len(t)]]) if gone and len(t) >= WINDOW else np.zeros((0, 2), np.int64) for t, gone in zip(self.texts, copied, strict=True)]
        found = [np.stack(_unwrapped(r["data"], "i4", "i4", "i4")).astype(np.int64) for r in self.replies if r["phase"] == PIECES]
        if any(r["phase"] == WINDOWS for r in self.replies):
            self.find_anchors()
            w = self.windows(self.met_again()[1])
            hit = ((w["times"] > 1) | self._bits(WINDOWS, w["counts"])[0])[w["of"]]
            found.append(np.stack((self.window_doc[hit], self.window_start[hit], self.window_start[hit])))
        if not found:
            return spans
        doc, a, b = np.concatenate(found, 1)
        order = np.lexsort((a, doc))
        doc, a, b = doc[order], a[order], b[order] + WINDOW
        borders = runs(doc).tolist()
        for x, y in zip(borders[:-1], borders[1:], strict=True):
            if not copied[doc[x]]:
                ends = np.maximum.accumulate(b[x:y])
                new = np.append(True, a[x + 1 : y] > ends[:-1])
                spans[doc[x]] = np.stack((a[x:y][new], ends[np.append(np.flatnonzero(new)[1:] - 1, y - x - 1)]), 1)
        return spans


def _answer_marks(data: list[pa.Buffer], phase: int, hot: int) -> list[bytes]:
    """Copies and windows: is the hash in another block too, and in one before? Anchors: is it met again, with many pieces?"""
    width = 2 if phase == ANCHORS else 3
    cuts = np.cumsum([0, *[len(d) // (8 * width) for d in data]])
    rows = np.frombuffer(b"".join(data), np.uint64).reshape(-1, width)
    keys = rows[:, :1] if phase == ANCHORS else rows[:, :2]
    order = np.lexsort(keys[:, ::-1].T)  # stable, so entries of one hash stay in the order of blocks
    new = np.ones(len(rows), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(1)
    heads = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    sums = np.add.reduceat(rows[order, width - 1].astype(np.int64), heads) if len(rows) else np.zeros(0, np.int64)
    out = np.zeros((2, len(rows)), bool)
    if phase == ANCHORS:  # the low bit of an entry's number tells that it has several pieces
        entries = np.diff(np.append(heads, len(rows)))
        several = np.maximum.reduceat(rows[order, 1].astype(np.int64) & 1, heads) if len(rows) else sums
        out[0, order], out[1, order] = ((entries > 1) | (several > 0))[of], ((sums >> 1) > hot)[of]
    else:
        out[0, order], out[1, order] = (np.diff(np.append(heads, len(rows))) > 1)[of], ~new
    return [np.packbits(out[:, a:b].ravel()).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _answer_pieces(data: list[pa.Buffer]) -> list[bytes]:
    """The starts of repeated windows, as runs, of each block."""
    parts = [_unwrapped(d, "u8", "i4", "i4", "i4", "i4", "i4", "u1") for d in data]
    seen: dict[tuple, int] = {}
    keys, low, high, pieces, total, of = [], [], [], [], [], []
    for key, a, b, times, _, _, blob in parts:
        lens = (b - a + WINDOW).tolist()
        ends, mine = np.cumsum([0, *lens]).tolist(), []
        for i in range(len(key)):
            name = (int(key[i]), int(b[i]), blob[ends[i] : ends[i + 1]].tobytes())
            at = seen.setdefault(name, len(seen))
            if at == len(keys):
                keys.append(name[0]), low.append(int(a[i])), high.append(name[1]), pieces.append(name[2]), total.append(0)
            total[at] += int(times[i])
            mine.append(at)
        of.append(np.array(mine, np.int64))
    found = repeated(np.array(keys, np.uint64), np.array(low), np.array(high), pieces, np.array(total))
    out = []
    for mine, (_, _, _, times, doc, place, _) in zip(of, parts, strict=True):
        edge = np.zeros((len(mine), found.shape[1] + 2), np.int8)
        edge[:, 1:-1] = found[mine]
        piece, begin = np.nonzero(np.diff(edge) > 0)
        end = np.nonzero(np.diff(edge) < 0)[1] - 1
        # runs of offsets of each piece, for each of its places
        n_runs = np.bincount(piece, minlength=len(mine))
        first = np.cumsum(n_runs) - n_runs
        ref = np.repeat(np.arange(len(mine)), times)
        place_of = np.repeat(np.arange(len(ref)), n_runs[ref])
        nth = np.arange(len(place_of)) - np.repeat(np.cumsum(n_runs[ref]) - n_runs[ref], n_runs[ref])
        run = first[ref[place_of]] + nth
        out.append(_wrapped(doc[place_of].astype(np.int32), (place[place_of] - end[run]).astype(np.int32), (place[place_of] - begin[run]).astype(np.int32)))
    return out


REPLY = "block long, phase int, bucket int, data binary, hits long"


def _answering(most: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        phase, data = table.column("phase")[0].as_py(), [x.as_buffer() for x in table.column("data")]
        marks = _answer_pieces(data) if phase == PIECES else _answer_marks(data, phase, most)
        n = len(marks)
        hits = [0] * n
        if phase == ANCHORS:  # pieces met again, and those of hot anchors in the upper half
            for k, (d, m) in enumerate(zip(data, marks, strict=True)):
                count = (np.frombuffer(d, np.uint64).reshape(-1, 2)[:, 1] >> np.uint64(1)).astype(np.int64)
                again, hot = np.unpackbits(np.frombuffer(m, np.uint8), count=2 * len(count)).reshape(2, -1).astype(bool)
                hits[k] = (int(count[hot].sum()) << 32) + int(count[again & ~hot].sum())
        return pa.table({"block": table.column("block"), "phase": pa.array([phase] * n, pa.int32()), "bucket": table.column("bucket"), "data": pa.array(marks, pa.binary()), "hits": pa.array(hits, pa.int64())})

    return work


def common_grams(docs: DataFrame, text_col: str) -> np.ndarray:
    """For hashes by their first bits: is a gram with such a hash in COMMON or more documents of the sample? At most SAMPLE x SAMPLE_BYTES bytes are read here."""
    n = docs.count()
    mark = F.pmod(F.xxhash64(F.lit(5), text_col), F.lit(max(1, n // SAMPLE)))
    some = docs.where(mark == 0).select(F.substring(F.col(text_col).cast("binary"), 1, SAMPLE_BYTES).alias("text")).distinct().orderBy(F.xxhash64("text")).limit(SAMPLE)
    found = [np.unique(gram_hashes(np.frombuffer(r["text"], np.uint8))) for r in some.collect() if r["text"]]
    out = np.zeros(1 << COMMON_BITS, np.uint8)
    if found:
        hashes, times = np.unique(np.concatenate(found), return_counts=True)
        out[(hashes[times >= COMMON] >> np.uint64(64 - COMMON_BITS)).astype(np.int64)] = 1
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each row: the bytes that no repeated window covers, and the spans removed.

    A window of WINDOW bytes is repeated if the same bytes also start anywhere else in the table, in the same text or another; all of its places are removed. Null texts are
    empty, texts of fewer bytes lose nothing. Ids don't matter: null ones and those of several rows are kept as they are, and rows alike lose their whole texts. An empty table gives an empty result;
    other columns are ignored. `kept` is binary, as a removed run may end within a character.
    """
    spark = docs.sparkSession
    name = f"{TABLES}suffixes_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.count("*").alias("n")).first()
    size = total["bytes"] or 0
    files = min(max(parts, -(-size // TASK_BYTES)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    packed = pack(docs, id_col, text_col, block_bytes or _between(size, MANY_BLOCKS, BLOCK_BYTES))
    packed.write.bucketBy(files, "block").option("path", f"{shared_dir(spark)}/lamina-scratch/{name}").saveAsTable(name)
    blocks = spark.table(name)
    buckets_for = lambda sent: max(2 * parts, int(sent / _between(sent, MANY_BUCKETS, BUCKET_BYTES)))
    # copies: 24 bytes a text; anchors: 16 bytes each, one in half a window
    buckets = {COPIES: buckets_for(24 * total["n"]), ANCHORS: buckets_for(16 * size / ((WINDOW - GRAM) / 2)), PIECES: 2 * parts, WINDOWS: 2 * parts}
    common = spark.sparkContext.broadcast(common_grams(docs, text_col))
    replies = None

    def with_replies() -> DataFrame:
        if replies is None:
            return blocks.withColumn("replies", F.lit(None).cast("array<struct<phase:int,bucket:int,data:binary>>"))
        own = replies.groupBy("block").agg(F.collect_list(F.struct("phase", "bucket", "data")).alias("replies"))
        return blocks.join(own.hint("shuffle_hash"), "block", "left")

    def opened(batches: Iterator[pa.RecordBatch], buckets: dict[int, int]) -> Iterator[tuple[int, list, Block]]:
        for b in batches:
            for i in range(b.num_rows):
                yield b.column("block")[i].as_py(), b.column("ids")[i].as_py(), Block(b.column("texts")[i].as_py(), b.column("replies")[i].as_py(), buckets, common.value)

    def asking(phases: tuple[int, ...], buckets: dict[int, int]):
        def parted(table: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
            ends = np.cumsum(counts)
            for k in np.flatnonzero(counts).tolist():
                yield k, table[ends[k] - counts[k] : ends[k]].tobytes()

        def sent(block: Block) -> Iterator[tuple[int, int, bytes]]:
            if COPIES in phases:
                c = block.copies
                yield from ((COPIES, *x) for x in parted(np.column_stack((c["hash"], c["times"].astype(np.uint64))), c["counts"]))
                return
            block.find_anchors()
            if ANCHORS in phases:
                a = block.anchor
                number = 2 * block.different() + (a["times"] > 1)
                yield from ((ANCHORS, *x) for x in parted(np.column_stack((a["hash"], number.astype(np.uint64))), a["counts"]))
                return
            few, many = block.met_again()
            if len(few):
                yield from ((PIECES, *x) for x in block.sent_pieces(few))
            if len(many):
                w = block.windows(many)
                yield from ((WINDOWS, *x) for x in parted(np.column_stack((w["hash"], w["times"].astype(np.uint64))), w["counts"]))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, _, block in opened(batches, buckets):
                rows = list(sent(block))
                phase, bucket, data = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(phase, pa.int32()), pa.array(bucket, pa.int32()), pa.array([at] * len(data), pa.int64()), pa.array(data, pa.binary())], ["phase", "bucket", "block", "data"])

        return work

    for phases in ((COPIES,), (ANCHORS,), (PIECES, WINDOWS)):
        if PIECES in phases:
            hits = replies.where(F.col("phase") == ANCHORS).agg(F.sum(F.col("hits").bitwiseAND(F.lit((1 << 32) - 1))).alias("pieces"), F.sum(F.shiftright("hits", 32)).alias("hot")).first()
            buckets[PIECES] = buckets_for(BUCKET_BYTES[0] / PIECE_BYTES * WINDOW * 3 / 2 * (hits["pieces"] or 0))
            buckets[WINDOWS] = buckets_for(24 * (WINDOW - GRAM) / 2 * (hits["hot"] or 0))
        asked = with_replies().mapInArrow(asking(phases, dict(buckets)), "phase int, bucket int, block long, data binary")
        answer = cut(asked.groupBy("phase", "bucket").applyInArrow(_answering(hot), REPLY), f"suffix-replies-{phases[0]}")
        replies = answer if replies is None else replies.union(answer)
    known = dict(buckets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, block in opened(batches, known):
            spans = block.removed()
            kept = []
            for text, s in zip(block.texts, spans, strict=True):
                edges = [0, *s.ravel().tolist(), len(text)]
                kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if len(s) else text)
            gone = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            as_lists = pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in spans], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in block.texts], pa.int64()), pa.array(gone, pa.int64()), as_lists, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return bound_batches(with_replies()).mapInArrow(work, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and removed bytes of every document, and the digest of the rest. Rows as for `dedup`."""
    found = dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
