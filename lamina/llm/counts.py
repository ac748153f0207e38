"""Token counts with a piece vocabulary: a whole-token shortcut, merging only the rest.

Three facts about the vocabulary are proved offline, once, from its pieces alone, and sent to the workers as a table. No piece holds a space mark after another character, so a
text falls apart before each run of space marks. Some characters stand in no piece but their own, so a text falls apart
around them. And a piece's string that alone encodes to that one piece is a whole token. A text's parts are then
counted: whole tokens as one, any other part by merging it once and remembering the count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import bound_batches, read, slices

SPACE = "▁"
#: Counts that a worker remembers before it starts anew.
REMEMBERED = 400_000
LONGEST = 64


@dataclass(frozen=True)
class Proofs:
    """What was proved of a vocabulary; as large as that is, whatever is counted."""

    splits: bool  # texts fall apart before space marks
    alone: str  # characters that are in no piece but their own
    first: tuple[str, ...]  # strings that are one token where they start a word
    inner: tuple[str, ...]  # and where they follow a lone character


@lru_cache(4)
def prove(path: str) -> Proofs:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(len(model))]
    pieces = [p for i, p in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    apart = not any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:], strict=False))
    # spaces become space marks, one each, and one more stands in front; nothing is collapsed or cut off
    marked = all(model.encode(x) == model.encode(x.replace(" ", SPACE)) and model.decode(model.encode(x)) == x for n in range(1, 18) for x in (" " * n + "a", "a" + " " * n + "b", "a" + " " * n))
    joined = {c for p in pieces if len(p) > 1 for c in p}
    alone = "".join(c for c in "\n\t\r\x0b\x0c0123456789" if c not in joined)
    behind = len(model.encode(alone[:1])) if alone else 0
    holds = re.compile(f"[{re.escape(alone)}]") if alone else re.compile("(?!)")
    first = tuple(p[1:] for i, p in enumerate(names) if p.startswith(SPACE) and model.encode(p[1:]) == [i] and not holds.search(p))
    inner = tuple(p for i, p in enumerate(names) if alone and not p.startswith(SPACE) and model.encode(alone[0] + p)[behind:] == [i])
    return Proofs(apart and marked, alone, first, inner)


class Counter:
    """Counts the pieces of texts as the model's own encoder gives them, without begin and end."""

    def __init__(self, path: str, proofs: Proofs) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.splits = proofs.splits
        self.alone = re.compile(f"([{re.escape(proofs.alone)}])") if proofs.alone else None
        self.mark = proofs.alone[:1]  # parts behind a lone character are encoded behind this one
        self.behind = len(self.model.encode(self.mark)) if self.mark else 0
        self.whole = dict.fromkeys(proofs.first, 1), dict.fromkeys(proofs.inner, 1)
        self.first, self.inner = dict(self.whole[0]), dict(self.whole[1])

    def merged(self, part: str) -> int:
        """The count of a part that starts a word: `part` follows one space mark."""
        if not part:
            return 1  # the space mark alone
        pieces = [part] if self.alone is None else self.alone.split(part)
        if len(pieces) == 1:
            return len(self.model.encode(part))
        total = self.of(self.first, pieces[0], self.merged)
        for s in pieces[1:]:
            if s:
                total += self.of(self.inner, s, lambda s: len(self.model.encode(self.mark + s)) - self.behind)
        return total

    def of(self, known: dict[str, int], part: str, merge) -> int:
        n = known.get(part)
        if n is None:
            n = merge(part)
            if len(part) <= LONGEST:
                if len(known) > REMEMBERED:
                    known.clear()
                    known.update(self.whole[known is self.inner])
                known[part] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text))
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            parts = [p[1:] for p in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        else:
            parts = text.split(" ")
        known = self.first
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            return sum(self.of(known, p, self.merged) for p in parts)


COUNTERS: dict[str, Counter] = {}


def counter(path: str, proofs: Proofs | None = None) -> Counter:
    """A worker's counter, made once."""
    if path not in COUNTERS:
        COUNTERS[path] = Counter(path, proofs or prove(path))
    return COUNTERS[path]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; `model` is a path that driver and executors can open.

    Null and empty texts have no bytes and no tokens. Null ids stay null; repeated rows are counted alike; other columns are ignored.
    """

    proofs = docs.sparkSession.sparkContext.broadcast(prove(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model, proofs.value).count
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array([count(t) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return bound_batches(rows).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document. Rows as for `count_tokens`."""
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
