"""FLAC media columns: text bytes as 8-bit samples, encoded, decoded and checked in lockstep over many frames.

The encoder picks for each frame a constant, verbatim, fixed or linear predictor and Rice codes of its residual. The decoder
finds the frames by the seek table, verifies the CRC-8 of each header and the CRC-16 of each frame, and decodes one
codeword of every frame at a time: unary quotient, remainder, prediction. Frames are the lanes of flat arrays, so there is no loop over samples of a
single stream. Samples are bytes less 128.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import bound_batches, read, slices

BLOCK = 1024
LONG_BLOCK = 32768
SEEK_POINTS = 900_000
ORDER = 8
PRECISION = 10
RATE = 8000
PAD = 64
#: Frames that are decoded at once, at most: some 16 bytes a sample each.
LANES = 4096
TO_SIGNED = bytes((b - 128) % 256 for b in range(256))
#: What each fixed predictor makes of the samples before, the last first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class Corrupt(ValueError):
    """A stream that breaks the format or one of its checksums."""


@lru_cache(1)
def crc8_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c << 1 ^ 0x07 if c & 0x80 else c << 1) & 0xFF
        out.append(c)
    return out


@lru_cache(1)
def crc16_words() -> np.ndarray:
    """What the CRC-16 (polynomial 0x8005) becomes over two bytes, for the state joined with them."""
    byte = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        byte = np.where(byte & 0x8000, byte << 1 ^ 0x8005, byte << 1) & 0xFFFF
    word = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        word = (word << 8 & 0xFFFF) ^ byte[word >> 8]
    return word.astype(np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = crc8_table()[c ^ b]
    return c


def crc16(frames: list[bytes]) -> np.ndarray:
    """The CRC-16 of every frame; zeros in front change nothing, so frames are set flush right."""
    if not frames:
        return np.zeros(0, np.uint16)
    lens = np.fromiter(map(len, frames), np.int64, len(frames))
    out = np.zeros(len(frames), np.uint16)
    order = np.argsort(lens, kind="stable")
    table = crc16_words()
    for some in np.array_split(order, max(1, int(lens.sum() >> 22))):
        width = int(lens[some].max() + 1) & ~1
        padded = np.zeros((len(some), width), np.uint8)
        padded[np.arange(width) >= width - lens[some][:, None]] = np.frombuffer(b"".join([frames[i] for i in some]), np.uint8)
        words = np.ascontiguousarray(padded.view(">u2").astype(np.uint16).T)
        state = np.zeros(len(some), np.uint16)
        for w in words:
            state = table[state ^ w]
        out[some] = state
    return out


@lru_cache(1 << 14)
def frame_header(number: int, samples: int) -> bytes:
    """Fixed block size, 8 kHz, mono, 8 bits; the number of samples in 16 bits; the number coded like UTF-8; CRC-8."""
    if number < 0x80:
        coded = bytes([number])
    else:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
        coded = bytes([(0xFF << (8 - n) & 0xFF if n < 7 else 0xFE) | number >> 6 * (n - 1)]) + bytes(0x80 | number >> 6 * i & 0x3F for i in range(n - 2, -1, -1))
    head = b"\xff\xf8\x74\x02" + coded + struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


@lru_cache(1 << 14)
def read_header(head: bytes) -> tuple[int, int, int]:
    """(length in bytes, frame number, samples) of the header that `head` starts with."""
    if head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise Corrupt("no frame where the seek table has one")
    size, rate = head[2] >> 4, head[2] & 15
    if head[3] >> 4 or head[3] >> 1 & 7 not in (0, 1):
        raise Corrupt("only mono streams of 8 bits are read")
    lead = head[4]
    more = 0 if lead < 0x80 else next((n for n in range(2, 8) if not lead << n & 0x80), 7) - 1
    number = lead if not more else lead & (0x3F >> more)
    for b in head[5 : 5 + more]:
        number = number << 6 | b & 0x3F
    at = 5 + more
    if size == 6:
        samples, at = head[at] + 1, at + 1
    elif size == 7:
        samples, at = struct.unpack(">H", head[at : at + 2])[0] + 1, at + 2
    else:
        samples = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608}.get(size) or 256 << (size - 8)
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(head[:at]) != head[at]:
        raise Corrupt("the checksum of a frame header is wrong")
    return at + 1, number, samples


# encoder


def _zigzag(e: np.ndarray) -> np.ndarray:
    return e << 1 ^ e >> 63


def _rice(total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameters for sums of `count` folded residuals, and about the bits they take."""
    mean = np.maximum(total / np.maximum(count, 1) * 0.6931, 1.0)
    k = np.minimum(np.floor(np.log2(mean)).astype(np.int64), 14)
    return k, count * (k + 1) + (total >> k)


def _predictor(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of each row (order ORDER, the last sample first) and their shifts."""
    x = s.astype(np.float64)
    n = x.shape[1]
    r = np.stack([np.einsum("fi,fi->f", x[:, : n - lag], x[:, lag:]) for lag in range(ORDER + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - np.einsum("fj,fj->f", a[:, :i], r[:, i:0:-1])) / np.maximum(err, 1e-12)
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err *= 1 - k * k
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    most = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most, most - 1).astype(np.int64), shift


def _bodies(s: np.ndarray) -> list[bytes]:
    """The subframe of each row of samples (int64, all rows of one length), padded to whole bytes."""
    lanes, n = s.shape
    order_of = min(ORDER, n - 1)
    parts = 2 if n >= 256 else 0
    edges = np.arange(0, n, n >> parts)

    def cost(e: np.ndarray, order: int) -> np.ndarray:
        z = _zigzag(e)
        sums = np.add.reduceat(z, edges, axis=1)
        sums[:, 0] -= z[:, :order].sum(1)
        counts = np.full(len(edges), n >> parts) - np.where(edges == 0, order, 0)
        return _rice(sums, counts)[1].sum(1) + 8 * order + 14 + 4 * len(edges)

    # residuals of the fixed predictors and of the linear one, as wide as the samples (the first `order` are not coded)
    residuals, costs = [s], [cost(s, 0)]
    for order in range(1, 3):
        last = residuals[-1]
        e = np.concatenate((last[:, :1], last[:, 1:] - last[:, :-1]), 1)
        residuals.append(e)
        costs.append(cost(e, order))
    coefs, shift = _predictor(s)
    pred = np.zeros_like(s)
    for j in range(order_of):
        pred[:, j + 1 :] += coefs[:, j : j + 1] * s[:, : n - j - 1]
    e = s - (pred >> shift[:, None])
    residuals.append(e)
    costs.append(cost(e, order_of) + 9 + PRECISION * order_of)
    costs.append(np.full(lanes, 8 * n + 8))
    best = np.argmin(np.stack(costs), 0)
    best = np.where((s == s[:, :1]).all(1), 5, best)

    out: list[bytes] = [b""] * lanes
    for i in np.flatnonzero(best == 5):
        out[i] = bytes([0, int(s[i, 0]) & 0xFF])
    for i in np.flatnonzero(best == 4):
        out[i] = b"\x02" + s[i].astype(np.int8).tobytes()
    for kind in range(4):
        rows = np.flatnonzero(best == kind)
        if not len(rows):
            continue
        order = order_of if kind == 3 else kind
        z = _zigzag(residuals[kind][rows])
        z[:, :order] = 0
        counts = np.full(len(edges), n >> parts) - np.where(edges == 0, order, 0)
        k = _rice(np.add.reduceat(z, edges, axis=1), counts)[0]
        wide = np.repeat(k, n >> parts, axis=1)[:, order:]
        z = z[:, order:]
        # fields: (value, its bits, zeros in front)
        head = [(np.full(len(rows), ((31 + order) if kind == 3 else (8 + order)) << 1), 8)]
        head += [(s[rows, j] & 0xFF, 8) for j in range(order)]
        if kind == 3:
            head += [(np.full(len(rows), PRECISION - 1), 4), (shift[rows], 5)]
            head += [(coefs[rows, j] & ((1 << PRECISION) - 1), PRECISION) for j in range(order)]
        head += [(np.full(len(rows), parts), 6)]
        values = [np.stack([v for v, _ in head], 1)]
        bits = [np.tile([b for _, b in head], (len(rows), 1))]
        zeros = [np.zeros_like(bits[0])]
        at = 0
        for p in range(len(edges)):
            end = at + int(counts[p])
            kk, zz = wide[:, at:end], z[:, at:end]
            values += [k[:, p : p + 1], 1 << kk | zz & (1 << kk) - 1]
            bits += [np.full((len(rows), 1), 4), kk + 1]
            zeros += [np.zeros((len(rows), 1), np.int64), zz >> kk]
            at = end
        value, bit, zero = (np.concatenate(x, 1) for x in (values, bits, zeros))
        ends = np.cumsum(bit + zero, axis=1)
        size = ends[:, -1] + 7 >> 3
        start = np.concatenate(([0], np.cumsum(size)))
        ends = (ends + 8 * start[:-1, None]).ravel() - 1
        value, bit = value.ravel(), bit.ravel()
        flat = np.zeros(int(start[-1]) * 8, np.uint8)
        for b in range(int(bit.max())):
            if b:
                more = bit > b
                ends, value, bit = ends[more], value[more], bit[more]
            flat[ends - b] = value >> b & 1
        raw = np.packbits(flat).tobytes()
        for i, a, b in zip(rows.tolist(), start[:-1].tolist(), start[1:].tolist(), strict=True):
            out[i] = raw[a:b]
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (one byte or more each a multiple of 64 bytes long), with a seek point for every frame."""
    blocks = [BLOCK if len(p) <= BLOCK * SEEK_POINTS else LONG_BLOCK for p in payloads]
    frames = [(d, i, min(b, len(p) - i * b)) for d, (p, b) in enumerate(zip(payloads, blocks, strict=True)) for i in range(-(-len(p) // b))]
    bodies: list[bytes] = [b""] * len(frames)
    by_size: dict[int, list[int]] = {}
    for at, (_, _, n) in enumerate(frames):
        by_size.setdefault(n, []).append(at)
    for n, all_ in by_size.items():
        for a in range(0, len(all_), max(1, (1 << 20) // n)):
            some = all_[a : a + max(1, (1 << 20) // n)]
            raw = b"".join([payloads[d][i * blocks[d] : i * blocks[d] + n] for d, i, _ in (frames[x] for x in some)])
            s = np.frombuffer(raw, np.uint8).reshape(len(some), n).astype(np.int64) - 128
            for x, body in zip(some, _bodies(s), strict=True):
                bodies[x] = body
    bodies = [frame_header(i, n) + body for (_, i, n), body in zip(frames, bodies, strict=True)]
    checks = crc16(bodies)
    bodies = [b + struct.pack(">H", c) for b, c in zip(bodies, checks.tolist(), strict=True)]
    out, at = [], 0
    for p, block in zip(payloads, blocks, strict=True):
        many = -(-len(p) // block)
        own = bodies[at : at + many]
        at += many
        sizes = [len(b) for b in own]
        points, offset = [], 0
        for i, size in enumerate(sizes):
            points.append(struct.pack(">QQH", i * block, offset, min(block, len(p) - i * block)))
            offset += size
        info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(p.translate(TO_SIGNED)).digest()
        table = b"".join(points)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


# decoder


def _tables(media: bytes) -> tuple[int, bytes, int, list[tuple[int, int, int]]]:
    """(samples, MD5, where the frames start, seek points) of a stream; a point is (first sample, offset, samples)."""
    if media[:4] != b"fLaC":
        raise Corrupt("not a FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    return total, md5, at, points


def _decode_frames(frames: list[bytes]) -> list[bytes]:
    """The samples (as unsigned bytes) of whole frames, all frames in lockstep."""
    if np.any(crc16(frames)):
        raise Corrupt("the checksum of a frame is wrong")
    out: list[bytes] = [b""] * len(frames)
    lanes = []
    for i, f in enumerate(frames):
        head, _, n = read_header(f[:16])
        kind = f[head] >> 1
        if f[head] & 0x81:
            raise Corrupt("wasted bits are not read")
        if kind == 0:
            out[i] = bytes([(f[head + 1] + 128) % 256]) * n
        elif kind == 1:
            out[i] = f[head + 1 : head + 1 + n].translate(TO_SIGNED)
        elif 8 <= kind <= 12 or kind >= 32:
            lanes.append((n, i, head + 1, kind - 31 if kind >= 32 else kind - 8, kind >= 32))
        else:
            raise Corrupt("a reserved kind of subframe")
    if not lanes:
        return out
    lanes.sort(key=lambda x: -x[0])
    n, which, heads, order, linear = (np.array(x) for x in zip(*lanes, strict=True))
    raw = np.frombuffer(b"".join([frames[i] for i in which]) + bytes(16), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(frames[i]) for i in which])[:-1]))
    limit = (starts + [len(frames[i]) for i in which]) * 8 - 16
    window = np.zeros(len(raw) - 7, np.uint64)  # the eight bytes from each byte on
    for j in range(8):
        window |= raw[j : len(raw) - 7 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    p = (starts + heads) * 8
    u = np.uint64

    def bits(at: np.ndarray, many) -> np.ndarray:
        many = np.asarray(many).astype(np.uint64)
        return (window[at >> 3] << (at & 7).astype(np.uint64) >> u(1) >> (u(63) - many)).astype(np.int64)

    def signed(x: np.ndarray, many) -> np.ndarray:
        return x - ((x >> (many - 1) & 1) << many)

    deep = int(order.max())
    longest = int(n[0])
    past = np.zeros((deep + longest, len(n)), np.int64)  # samples by time, `deep` rows of nothing in front
    for j in range(deep):
        lane = np.flatnonzero(order > j)
        past[deep + j, lane] = signed(bits(p[lane], 8), 8)
        p[lane] += 8
    coefs = np.zeros((deep, len(n)), np.int64)  # row deep - 1 is for the last sample
    shift = np.zeros(len(n), np.int64)
    for o in range(1, 5):
        lane = np.flatnonzero(~linear & (order == o))
        for j, c in enumerate(FIXED[o] if len(lane) else ()):
            coefs[deep - 1 - j, lane] = c
    lane = np.flatnonzero(linear)
    precision = bits(p[lane], 4) + 1
    shift[lane] = signed(bits(p[lane] + 4, 5), 5)
    if np.any(precision == 16) or np.any(shift < 0):
        raise Corrupt("a predictor of a reserved form")
    p[lane] += 9
    for j in range(deep):
        has = order[lane] > j
        own = lane[has]
        coefs[deep - 1 - j, own] = signed(bits(p[own], precision[has]), precision[has])
        p[own] += precision[has]
    method = bits(p, 2)
    if np.any(method > 1):
        raise Corrupt("a reserved residual coding")
    wide = 4 + method
    size = n >> bits(p + 2, 4)  # of a partition
    p += 6
    border = order.copy()
    k, escape = np.zeros(len(n), np.uint64), np.zeros(len(n), bool)
    any_escape = False
    active = np.searchsorted(-n, -np.arange(longest), side="left")  # lanes with more samples than t
    one = u(1)
    for t in range(longest):
        many = int(active[t])
        new = np.flatnonzero(border[:many] == t)
        if len(new):
            param = bits(p[new], wide[new])
            p[new] += wide[new]
            raws = param == (1 << wide[new]) - 1
            escape[new] = raws
            any_escape = bool(escape.any())
            lane = new[raws]
            param[raws] = bits(p[lane], 5)
            p[lane] += 5
            k[new] = param.astype(np.uint64)
            border[new] = (t // size[new] + 1) * size[new]
        lane = slice(0, many) if t >= deep else np.flatnonzero(order[:many] <= t)
        at, kk = p[lane], k[lane]
        v = window[at >> 3] << (at & 7).astype(np.uint64)
        q = 53 - np.frexp((v >> u(11)).astype(np.float64))[1].astype(np.int64)  # zeros in front
        qq = q.astype(np.uint64)
        z = (qq << kk) | (v << (qq + one) >> one >> (u(63) - kk))
        step = q + 1 + kk.astype(np.int64)
        long = (step > 57) | (v < 2048)  # the window ends before the codeword does
        if long.any() or any_escape:
            odd = np.flatnonzero(long | escape[lane])
            z, step = z.copy(), step.copy()
            names = np.arange(many)[lane]
            for i in odd.tolist():
                z[i], step[i] = _one(raw, int(at[i]), int(kk[i]), bool(escape[names[i]]))
        e = (z >> one).astype(np.int64) ^ -(z & one).astype(np.int64)
        p[lane] = at + step
        guess = np.einsum("jf,jf->f", coefs[:, lane], past[t : t + deep, lane]) >> shift[lane] if deep else 0
        past[deep + t, lane] = e + guess
    if np.any(p > limit) or np.any(limit - p > 7):
        raise Corrupt("a residual does not end with its frame")
    columns = np.ascontiguousarray((past[deep:] + 128).astype(np.uint8).T)
    for row, i, samples in zip(columns, which.tolist(), n.tolist(), strict=True):
        out[i] = row[:samples].tobytes()
    return out


def _one(raw: np.ndarray, at: int, k: int, escape: bool) -> tuple[np.uint64, int]:
    """A folded residual and its bits, where it is too long for the window or is stored as it is."""

    def bit(i: int) -> int:
        return int(raw[i >> 3]) >> (7 - (i & 7)) & 1

    if escape:
        x = 0
        for i in range(k):
            x = x << 1 | bit(at + i)
        x -= (x >> (k - 1) & 1) << k if k else 0
        return np.uint64(x << 1 ^ x >> 63 if x >= 0 else (-x << 1) - 1), k
    q = 0
    while not bit(at + q):
        q += 1
    r = 0
    for i in range(k):
        r = r << 1 | bit(at + q + 1 + i)
    return np.uint64(q << k | r), q + 1 + k


def blocks(media: list[bytes], first: int = 0, samples: int | None = None) -> list[list[tuple[int, int, bytes]]]:
    """Of each stream its PCM blocks (first sample, offset in bytes, PCM) that hold any of the samples asked for.

    Only those frames are read and decoded. A whole stream is also checked against its MD5.
    """
    frames, names, heads = [], [], []
    for d, m in enumerate(media):
        total, md5, start, points = _tables(m)
        heads.append((total, md5))
        ends = [p[1] for p in points[1:]] + [len(m) - start]
        for (sample, offset, many), end in zip(points, ends, strict=True):
            if sample + many > first and (samples is None or sample < first + samples):
                frames.append(m[start + offset : start + end])
                names.append((d, sample, offset))
    out: list[list[tuple[int, int, bytes]]] = [[] for _ in media]
    for i in range(0, len(frames), LANES):
        for (d, sample, offset), pcm in zip(names[i : i + LANES], _decode_frames(frames[i : i + LANES]), strict=True):
            out[d].append((sample, offset, pcm))
    if first == 0 and samples is None:
        for (total, md5), own in zip(heads, out, strict=True):
            whole = b"".join([x[2] for x in own])
            if len(whole) != total or hashlib.md5(whole.translate(TO_SIGNED)).digest() != md5:
                raise Corrupt("the samples differ from the stream's MD5")
    return out


# tables


def payload(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of PAD."""
    return text + bytes(-len(text) % PAD if text else PAD)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) for each row; null texts are empty, null ids stay null, repeated rows give equal media, other columns are ignored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                texts = b.column("text").to_pylist()
                media = encode([payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return bound_batches(rows).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def read_blocks(media: DataFrame, first: int = 0, samples: int | None = None) -> DataFrame:
    """(doc_id, sample_offset, byte_offset, n_samples, pcm), a row for each block of `media` (doc_id, media) that holds samples asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media", 2 << 20):
                found = blocks(b.column("media").to_pylist(), first, samples)
                rows = [(i, *x) for i, own in zip(b.column("doc_id").to_pylist(), found, strict=True) for x in own]
                ids, sample, offset, pcm = zip(*rows, strict=True) if rows else ((), (), (), ())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, sample, offset, tuple(map(len, pcm)), pcm), kinds, strict=True)], ["doc_id", "sample_offset", "byte_offset", "n_samples", "pcm"])

    return media.where("media is not null").select("doc_id", "media").mapInArrow(work, "doc_id long, sample_offset long, byte_offset long, n_samples int, pcm binary")


def feature(pcm: bytes, frames: int) -> str:
    """Whole-number features of the samples: blocks, sum, energy, peak and sign changes."""
    s = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    return f"blocks={frames};sum={s.sum()};energy={(s * s).sum()};peak={np.abs(s).max()};crossings={np.count_nonzero((s[1:] < 0) != (s[:-1] < 0))}"


def read_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of `media` (doc_id, n_bytes, media), all from the stored bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media", 2 << 20):
                stored = b.column("media").to_pylist()
                rows = []
                for m, own in zip(stored, blocks(stored), strict=True):
                    pcm = b"".join([x[2] for x in own])
                    rows.append((len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(pcm, len(own))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes through FLAC and back. Rows as for `write_media`."""
    return read_features(write_media(read(spark, sf_dir, "documents")))
