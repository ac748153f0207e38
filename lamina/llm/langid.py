"""Language identification with hyperdimensional profiles.

Every letter has its own random vector of +1 and -1, drawn from a hash of its code point. A trigram is bound from the vectors of its letters,
permuted by their place (rolled by 2, 1 and 0) and multiplied; a text bundles (adds) its trigrams; a language's prototype bundles its
labelled texts. A text gets the language whose prototype has the largest cosine with it.

Bundles are sums of whole numbers, so they don't depend on how texts are put together in batches: the trigrams of a batch are looked up once, and
its texts are bundled by one matrix product.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import bound_batches, read, slices

DIMENSIONS = 2048
CHUNK = 1 << 20
UNKNOWN = "und"
#: Languages that can be told apart, at most: a prototype is one row of DIMENSIONS numbers in the driver and in each worker.
MOST_LANGUAGES = 2000
#: Trigrams whose vectors a worker holds (2 KB each), and trigrams of a task's counts before they are bundled.
HELD = 8192
COUNTED = 1 << 18
#: Trigrams that are multiplied at once, at most, and cells of the table of a batch's counts; sums up to EXACT are exact in single precision.
WIDTH = 1024
CELLS = 1 << 20
EXACT = 1 << 24
BITS = 21


@lru_cache(1)
def letters() -> np.ndarray:
    """Of every code point the (first) code point of its lower case, 0 for anything but a letter."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = ord(chr(c).lower()[0])
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of the whole text and how often each occurs; runs of other characters than letters are one space, one stands at each end."""
    names, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    carry = np.zeros(1, np.int64)  # a space in front
    last = max(0, (len(text) - 1) // CHUNK)
    for i in range(last + 1):
        seen = letters()[np.frombuffer(text[i * CHUNK : (i + 1) * CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate((carry, seen, [0] if i == last else []))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))].astype(np.int64)
        if len(s) >= 3:
            name, n = np.unique((s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:], return_counts=True)
            names.append(name[name != 0])
            counts.append(n[name != 0])
        carry = s[-2:]
    return summed(np.concatenate(names), np.concatenate(counts)) if len(names) > 2 else (names[-1], counts[-1])


def summed(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal names once, with the sum of their counts."""
    out, at = np.unique(names, return_inverse=True)
    total = np.zeros(len(out), np.int64)
    np.add.at(total, at, counts)
    return out, total


class Vectors:
    """The bound vectors of trigrams, as rows of int8."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.names, self.rows = np.zeros(0, np.int64), np.zeros((0, dimensions), np.int8)

    def letter(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of letters: the bits of mixed hashes of seed, code point and place."""
        x = (codes.astype(np.uint64)[:, None] << np.uint64(32)) + np.arange(1, -(-self.dimensions // 64) + 1, dtype=np.uint64) + (np.uint64(self.seed) << np.uint64(56))
        x *= np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return (np.unpackbits(x.view(np.uint8), axis=1)[:, : self.dimensions].astype(np.int8) << 1) - 1

    def bound(self, names: np.ndarray) -> np.ndarray:
        mask = (1 << BITS) - 1
        parts = np.stack((names >> 2 * BITS, (names >> BITS) & mask, names & mask))
        codes, at = np.unique(parts, return_inverse=True)
        own = self.letter(codes)
        at = at.reshape(parts.shape)
        return np.roll(own, 2, axis=1)[at[0]] * np.roll(own, 1, axis=1)[at[1]] * own[at[2]]

    def of(self, names: np.ndarray) -> np.ndarray:
        """The rows of sorted distinct trigrams, HELD at most; they are held until there are too many."""
        at = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        new = names[self.names[at] != names] if len(self.names) else names
        if len(new):
            if len(self.names) + len(new) > HELD:
                self.names, self.rows = np.zeros(0, np.int64), np.zeros((0, self.dimensions), np.int8)
                new = names
            rows = np.concatenate((self.rows, self.bound(new)))
            names_ = np.concatenate((self.names, new))
            order = np.argsort(names_)
            self.names, self.rows = names_[order], rows[order]
            at = np.searchsorted(self.names, names)
        return self.rows[at]

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sum of each text's trigrams, a row each: whole numbers."""
        out = np.zeros((len(texts), self.dimensions))
        sizes = np.array([len(n) for n, _ in texts])
        if not sizes.sum():
            return out
        name = np.concatenate([n for n, _ in texts])
        count = np.concatenate([c for _, c in texts])
        row = np.repeat(np.arange(len(texts)), sizes)
        every, at = np.unique(name, return_inverse=True)
        many = int(np.bincount(row, count).max())
        width = max(1, min(HELD, WIDTH, CELLS // len(texts)))
        for start in range(0, len(every), width):
            vectors = self.of(every[start : start + width])
            own = (at >= start) & (at < start + width)
            table = np.zeros((len(texts), len(vectors)), np.float32 if many < EXACT else np.float64)
            table[row[own], at[own] - start] = count[own]
            out += table @ vectors.astype(table.dtype)
        return out


def _some(texts: list[tuple[np.ndarray, np.ndarray]], most: int = 128) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Texts that are bundled together: the more trigrams they have, the fewer."""
    held, n = [], 0
    for t in texts:
        if held and (len(held) >= most or n + len(t[0]) > 1 << 17):
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t[0])
    if held:
        yield held


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages, by code point, and their unit prototypes, from all rows where `train` holds and text and label are there.

    A task adds up the trigrams of its texts by language and bundles these; the bundles of a language are added up by dimension before they reach the driver, DIMENSIONS numbers a
    language. More than MOST_LANGUAGES languages raise. A language without any letters has the zero prototype, which no text is like.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vectors(dimensions, seed)  # a task's own: a worker holds nothing of it afterwards
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def bundled(lang: str) -> pa.RecordBatch:
            name, count = zip(*sums.pop(lang), strict=True)
            total = own.bundles([summed(np.concatenate(name), np.concatenate(count))])[0].astype(np.int64)
            sizes.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions)), pa.array(total)], ["lang", "dim", "n"])

        for whole in batches:
            for b in slices(whole, "text"):
                for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                    found = trigrams(text)
                    sums.setdefault(lang, []).append(found)
                    sizes[lang] = sizes.get(lang, 0) + len(found[0])
                    if sizes[lang] > COUNTED:
                        name, count = zip(*sums[lang], strict=True)
                        sums[lang] = [summed(np.concatenate(name), np.concatenate(count))]
                        sizes[lang] = len(sums[lang][0][0])
                        if sizes[lang] > COUNTED // 2:
                            yield bundled(lang)
        for lang in list(sums):
            yield bundled(lang)

    rows = docs.where(train).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    found = bound_batches(rows).mapInArrow(work, "lang string, dim long, n long").groupBy("lang", "dim").agg(F.sum("n").alias("n"))
    sums = found.limit(MOST_LANGUAGES * dimensions + 1).toArrow()
    if sums.num_rows > MOST_LANGUAGES * dimensions:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs, at = np.unique(np.array(sums.column("lang").to_pylist(), object), return_inverse=True) if sums.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    protos = np.zeros((len(langs), dimensions))
    protos[at, sums.column("dim").to_numpy()] = sums.column("n").to_numpy()
    norms = np.linalg.norm(protos, axis=1, keepdims=True)
    return langs.tolist(), protos / np.where(norms == 0, 1, norms)


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = 7, keep: tuple[str, ...] = (), counts: bool = False) -> DataFrame:
    """(kept columns, lang_pred, score) for each row: the best language and its cosine, cut to 0 to 1; with `counts` also n_trigrams.

    Null text, text without letters, or nothing learned: `und` with score 0. Ties go to the language first by code point.
    """
    own = text_col if text_col in keep else "__text"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Vectors(dimensions, seed)
        for whole in batches:
            for b in slices(whole, own):
                names, scores, sizes = [], [], []
                for some in _some([trigrams(text or "") for text in b.column(own).to_pylist()]):
                    bundle = space.bundles(some)
                    norm = np.sqrt((bundle * bundle).sum(axis=1))
                    cos = np.stack([(bundle * p).sum(axis=1) for p in protos], axis=1) / np.maximum(norm, 1e-9)[:, None] if langs else np.zeros((len(some), 1))
                    best = cos.argmax(axis=1)
                    known = np.array([len(n) > 0 and len(langs) > 0 for n, _ in some])
                    names += [langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                    scores += np.where(known, np.clip(cos[np.arange(len(some)), best], 0, 1), 0.0).tolist()
                    sizes += [int(c.sum()) for _, c in some]
                more = [pa.array(sizes, pa.int64())] if counts else []
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64()), *more], [*keep, "lang_pred", "score", *["n_trigrams"] * counts])

    rows = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).alias("__text")]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return bound_batches(rows).mapInArrow(work, f"{kinds}{', ' if kinds else ''}lang_pred string, score double{', n_trigrams long' * counts}")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2. A null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, learned from the rows outside the fold that have an id, a text and a label."""
    langs, protos = learn(docs, ~held_out() & F.col("doc_id").isNotNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return predict(rows, langs, protos, keep=("doc_id", "held_out"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. Rows as for `predict`, learned as in `identify`."""
    return identify(read(spark, sf_dir, "documents"))
