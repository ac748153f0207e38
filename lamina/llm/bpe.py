"""BPE encoding and decoding by tree concatenation.

A text longer than HALVE is halved, wherever that falls, until no piece is longer; the pieces are encoded, those of a text together, and joined
up the tree. Around each join a window that begins and ends at a space is encoded anew: it agrees with a side if that side's encoding ends (or
starts) just as the window's own text does alone, and if the words next to the window's edge come out in the window as they do there. Until both sides agree the
window grows; then it takes the place of what they have for its text. Nothing crosses a space: no piece of the pattern, special string or
composed letter does. So the result is exact, whatever lies on the join.

A piece's text is normalised and split as its tokenizer file says; the parts' ids are remembered. A part without any split
that is longer than LEAF is itself cut into leaves, which are encoded together, in parallel, and joined up a tree: there a window grows until each token at
its edge and its outer neighbour encode, joined, to just these two. A row of tokens in which all neighbours
agree in this way is the one encoding of its text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm.common import bound_batches, read, slices

LEAF = 512
#: Characters of a text that isn't halved, at most, and those of a window on either side of a join at first.
HALVE = 4096
WINDOW = 32
#: Pieces that a worker remembers before it forgets those not seen of late, and the longest of them.
REMEMBERED = 100_000
LONGEST = 64
#: Characters whose classes, case and normal form all Unicode versions share: Latin, Cyrillic, and common punctuation.
PLAIN = re.compile("[\t-\r -~\xa0-įı-ɏЀ-џ‐-‧‰-⁞€]*")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else letters from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encodes and decodes like the tokenizer in the file, whose pre-tokenizer is a regular expression and bytes as letters."""

    def __init__(self, path: str, leaf: int = LEAF, halve: int = HALVE) -> None:
        with open(path) as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.leaf, self.halve = leaf, halve
        self.joins = 0  # of halves, in the last text
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        bare = {k: None for k in ("normalizer", "pre_tokenizer", "post_processor", "decoder", "truncation", "padding")} | {"added_tokens": []}
        self.bare = json.dumps(spec | bare)
        split, to_bytes = spec["pre_tokenizer"]["pretokenizers"]
        if (spec["normalizer"]["type"], split["type"], split["behavior"], split["invert"], to_bytes["type"]) != ("Sequence", "Split", "Removed", True, "ByteLevel"):
            raise ValueError(f"{path}: not a tokenizer of words as bytes")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(c.isspace() for t in self.special for c in t):
            raise ValueError(f"{path}: special strings with spaces")
        self.specials = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.names = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.letters = byte_letters()
        size = max(self.names) + 1
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.tokens = [self.names.get(i, "") for i in range(size)]
        self.digits = [str(i) for i in range(size)]
        self.last_of_word = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in self.tokens])
        self.known: dict[str, bytes] = {}  # the ids of words, packed
        self.older: dict[str, bytes] = {}

    # one unsplit part; the tokenizers for it are built when the first one comes

    @cached_property
    def last(self) -> Tokenizer:
        return Tokenizer.from_str(self.bare)

    @cached_property
    def inner(self) -> Tokenizer:
        spec = json.loads(self.bare)
        spec["model"]["end_of_word_suffix"] = None
        return Tokenizer.from_str(json.dumps(spec))

    def ids(self, part: str, at_end: bool) -> list[int]:
        return (self.last if at_end else self.inner).encode(part, add_special_tokens=False).ids

    def text(self, ids: list[int]) -> str:
        """The byte letters that tokens of one part stand for."""
        names = [self.names[i] for i in ids]
        if self.suffix and names and names[-1].endswith(self.suffix):
            names[-1] = names[-1][: -len(self.suffix)]
        return "".join(names)

    def agree(self, a: int, b: int, at_end: bool) -> bool:
        return self.ids(self.text([a]) + self.text([b]), at_end) == [a, b]

    def join(self, left: list[int], right: list[int], at_end: bool) -> list[int]:
        """The encoding of two neighbours' text from their encodings; `at_end`: the right one ends the word."""
        if not left or not right or self.agree(left[-1], right[0], at_end and len(right) == 1):
            return left + right
        w = 1
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            to_end = at_end and b == len(right)
            mid = self.ids(self.text(left[a:]) + self.text(right[:b]), to_end)
            start = a == 0 or self.agree(left[a - 1], mid[0], to_end and len(mid) == 1)
            if start and (b == len(right) or self.agree(mid[-1], right[b], at_end and b + 1 == len(right))):
                return left[:a] + mid + right[b:]
            w *= 2

    def long(self, part: str) -> list[int]:
        """An unsplit part of any length, by tree concatenation."""
        cuts = [part[i : i + self.leaf] for i in range(0, len(part), self.leaf)]
        rows = [e.ids for e in self.inner.encode_batch(cuts[:-1], add_special_tokens=False)] + [self.ids(cuts[-1], True)]
        while len(rows) > 1:
            pairs = range(0, len(rows) - 1, 2)
            rows = [self.join(rows[i], rows[i + 1], i + 2 == len(rows)) for i in pairs] + rows[len(pairs) * 2 :]
        return rows[0]

    # words and texts

    def part(self, part: str) -> list[int]:
        """A part as the pre-tokenizer makes it, in byte letters."""
        return self.long(part) if len(part) > self.leaf else self.ids(part, True)

    def word(self, word: str) -> list[int]:
        out = []
        for piece in self.split.findall(word):
            out += self.part("".join([self.letters[x] for x in piece.encode()]))
        return out

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of pieces not remembered, encoded in one call, a space apart: each ends with a token that ends words."""
        short = [p for p in pieces if len(p) <= LONGEST]
        out = {p: np.array(self.word(p), self.kind).tobytes() for p in pieces if len(p) > LONGEST}
        ids = np.array(self.whole.encode(" ".join(short), add_special_tokens=False).ids, self.kind)
        ends = (np.flatnonzero(self.last_of_word[ids]) + 1).tolist()
        if len(ends) != len(short):
            return out | {p: np.array(self.word(p), self.kind).tobytes() for p in short}
        packed, size = ids.tobytes(), self.kind.itemsize
        out.update({p: packed[a * size : b * size] for p, a, b in zip(short, [0, *ends], ends, strict=False)})
        return out

    def plain(self, text: str) -> list[int]:
        pieces = self.split.findall(text.lower())
        try:
            packed = b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            packed = b"".join(map(self.found(pieces).__getitem__, pieces))
        return np.frombuffer(packed, self.kind).tolist()

    def found(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The packed ids of pieces, new ones encoded in one call and remembered."""
        own = {p: self.known.get(p) or self.older.get(p) for p in dict.fromkeys(pieces)}
        own.update(self.learn([p for p, ids in own.items() if ids is None]))
        if len(self.known) > REMEMBERED:  # the pieces of late stay for another turn
            self.known, self.older = {}, self.known
        self.known.update({p: ids for p, ids in own.items() if len(p) <= LONGEST})
        return own


    def segment(self, text: str) -> list[int]:
        """The ids of a text that isn't halved."""
        out, at = [], 0
        for m in [*self.specials.finditer(text), None]:
            segment = text[at : m.start() if m else len(text)]
            if PLAIN.fullmatch(segment):
                out += self.plain(segment)
            elif segment:
                normal = self.whole.normalizer.normalize_str(segment)
                for part, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal):
                    out += self.part(part)
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def cuts(self, text: str) -> list[int]:
        """Where a text is halved; a half without a space is left with its other half."""
        out, todo = [], [(0, len(text))]
        while todo:
            a, b = todo.pop()
            at = (a + b) // 2
            if b - a > self.halve and text.find(" ", a, at) >= 0 and text.find(" ", at, b) >= 0:
                out.append(at)
                todo += [(a, at), (at, b)]
        return sorted(out)

    def meet(self, text: str, start: int, at: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its parts before and from `at`."""
        self.joins += 1
        w = WINDOW
        while True:
            a = text.find(" ", at - w, at) if at - w > start else start
            b = text.rfind(" ", at, at + w) if at + w < end else end
            # the words on the join lie between p and q
            p, q = text.rfind(" ", max(a, start), at), text.find(" ", at, b if b >= 0 else at)
            if a >= 0 and b >= 0 and (a < p or a == start) and (q >= 0 or b == end):
                p, q = max(p, a), q if q >= 0 else b
                before, after = self.segment(text[a:p]), self.segment(text[q:b])
                own, new, theirs = self.segment(text[p:at]), self.segment(text[p:q]), self.segment(text[at:q])
                window = self.segment(text[a:b])
                i, j = len(left) - len(before) - len(own), len(theirs) + len(after)
                if i >= 0 and left[i:] == before + own and right[:j] == theirs + after and window == before + new + after:
                    return left[:i] + window + right[j:]
            if a == start and b == end:
                return self.segment(text[start:end])
            w *= 2

    def encode(self, text: str) -> list[int]:
        self.joins = 0
        if len(text) <= self.halve:
            return self.segment(text)
        ends = [0, *self.cuts(text), len(text)]
        row = [(a, b, self.segment(text[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
        while len(row) > 1:
            pairs = [(row[i], row[i + 1]) for i in range(0, len(row) - 1, 2)]
            row = [(x[0], y[1], self.meet(text, x[0], x[1], y[1], x[2], y[2])) for x, y in pairs] + row[2 * len(pairs) :]
        return row[0][2]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, with a space between: the file names no decoder that would join them otherwise."""
        return " ".join(map(self.tokens.__getitem__, ids)) if self.whole.decoder is None else self.whole.decode(ids, skip_special_tokens=False)


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row; `path` is a tokenizer file that each executor can open.

    Null and empty texts, and white space alone, have no tokens. Null ids stay null; repeated rows encode alike; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return bound_batches(rows).mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """(kept columns, ids, decoded) for each row of token ids; null ids decode to the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for b in batches:
            for start in range(0, b.num_rows, 256):
                some = b.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([decode(x or []) for x in some.column("ids").to_pylist()], pa.string())], [*some.schema.names, "decoded"])

    rows = encoded.select(*keep, F.col(ids_col).alias("ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{kinds}, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_joins, ids_sha256, decoded_sha256) of each row's ids, and of the text they decode to; `with_ids`: and the ids. Rows as for `encode`.

    n_joins is the number of joins in the tree of a text's halves: 0 for texts of HALVE characters at most, and for those without spaces.

    The ids of a text are decoded where they were encoded, so that one worker's vocabulary serves both.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for whole in batches:
            for b in slices(whole, "text"):
                counts, joins, ids_sha, text_sha, all_ids = [], [], [], [], []
                for text in b.column("text").to_pylist():
                    ids = own.encode(text)
                    counts.append(len(ids))
                    joins.append(own.joins)
                    ids_sha.append(sha(" ".join(map(own.digits.__getitem__, ids))))
                    text_sha.append(sha(own.decode(ids)))
                    all_ids.append(np.array(ids, np.int32))
                columns = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "n_joins": pa.array(joins, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate(all_ids)))
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return bound_batches(rows).mapInArrow(work, "doc_id long, n_tokens long, n_joins long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids, and the digest of what they decode to. Rows as for `encode`."""
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
