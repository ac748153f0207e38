"""Secret scans in DataFrame expressions only: three patterns, and sliding-window entropy over candidate strings.

The texts between matches (split) and the matches (extract) alternate, so running sums of their lengths give each match's place. A candidate
is a long run of one character class. A window slides over it; its counts, one byte a character, change by the character that enters and the one
that leaves, and with them the sum of c*log2(c) from which the entropy follows, in whole numbers that no rounding error adds up in. A run that any
window lifts to its class's threshold is a secret unless the allow-list knows its form.

All takes time in proportion to the text, so one of many megabytes is no different: values are bound once, running values go by blocks, and no
pattern backtracks or recurses.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import read

KINDS = ("assign", "access", "hex", "entropy64", "entropyhex")

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 24
#: Class of characters: candidate pattern, entropy in bits that some window must reach.
CLASSES = {"entropy64": (r"[A-Za-z0-9+/_=-]{24,}", 3.9), "entropyhex": (r"[0-9A-Fa-f]{24,}", 3.0)}
#: Forms that are no secrets: no digit; a UUID; words or numbers joined by dashes, underscores or slashes.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[0-9]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(?:[A-Za-z]+|[0-9]+)(?:[-_/=+](?:[A-Za-z]+|[0-9]+))+$",
)
#: What the last form must not hold, as that pattern itself recurses for each joint: other characters, runs of letters and digits mixed, joints side by side or at an end.
UNJOINED = r"[^A-Za-z0-9_/=+-]|[A-Za-z][0-9]|[0-9][A-Za-z]|[-_/=+][-_/=+]|^[-_/=+]|[-_/=+]$"
JOINT = r"[-_/=+]"

#: start, the kind's place in KINDS, end: in code points, end exclusive. In this order they sort as wanted.
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
#: Running values are found in blocks of so many, so that growing an array costs little.
BLOCK = 128
#: Characters of the pieces that a text is cut from.
PIECE = 4096
#: c*log2(c) as whole numbers of so many parts, and what a window may lack of the threshold, in bits.
PARTS = 1 << 40
SLACK = 1e-9


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array of longs (bound) what `op`, from 0 on, makes of all values before each, and, as the last, of all."""
    zero = F.lit(0).cast("bigint")
    empty = lambda at: F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        return F.struct(op(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def of(blocks: Column) -> Column:
        starts = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), empty(zero), add, lambda s: s["out"])
        return F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, empty(at), add, lambda s: s["out"]))

    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))
    whole = F.aggregate(values, zero, op)
    return F.concat(F.flatten(bind(cuts, of)), F.array(whole))


def places(text: Column, hits: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the matches `hits` (bound) of a pattern, leftmost and non-overlapping; `keep` tells of each which stay."""
    number = F.lit(KINDS.index(kind)).cast("int")
    lengths = F.transform(hits, lambda h: F.length(h).cast("bigint"))
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lengths, lambda gap, n: F.length(gap) + n)

    def spans(ends: Column) -> Column:
        # ends[i] is the end of the match before, ends[i + 1] of this one
        one = lambda h, i: F.struct((F.get(ends, i + 1) - F.length(h)).alias("start"), number.alias("kind"), F.get(ends, i + 1).alias("end"))
        return F.transform(hits, one)

    found = bind(bind(steps, lambda s: running(s, lambda a, b: a + b)), spans)
    if keep is not None:
        found = F.transform(F.filter(F.arrays_zip(found.alias("span"), F.transform(hits, keep).alias("keep")), lambda x: x["keep"]), lambda x: x["span"])
    return found.cast(SPANS)


def matches(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of all matches of a pattern in a text; the text is read once where there are none."""
    some = lambda hits: F.when(F.size(hits) > 0, places(text, hits, pattern, kind, keep)).otherwise(F.array().cast(SPANS))
    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def top_entropy(text: Column, window: int = WINDOW, enough: float | None = None) -> Column:
    """The largest Shannon entropy (bits) of any `window` characters in a row of an ASCII string; 0 for shorter ones.

    With `enough`, a window that reaches it ends the search.
    """
    parts = F.array(*[F.lit(round(c * math.log2(c) * PARTS) if c else 0).cast("bigint") for c in range(window + 1)])
    part = lambda c: F.element_at(parts, c + 1)
    # the counts are letters from "0" on, at the places of the characters' codes
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1))) - 48
    put = lambda counts, code, n: F.overlay(counts, F.char(n + 48), code + 1, F.lit(1))
    state = lambda counts, total, best: F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))
    none = F.lit(window * (window + 1) * PARTS).cast("bigint")
    bits = lambda least: F.lit(math.log2(window)) - least / F.lit(float(window * PARTS))
    done = F.lit(-1.0) if enough is None else F.lit((math.log2(window) - enough + SLACK) * window * PARTS)

    def best_of(codes: Column) -> Column:
        def leave(s: Column, i: Column) -> Column:
            old = F.element_at(codes, i - window)
            change = lambda n: state(put(s["counts"], old, n - 1), s["total"] + part(n - 1) - part(n), s["best"])
            return F.when(i <= window, s).otherwise(bind(count(s["counts"], old), change))

        def enter(s: Column, i: Column) -> Column:
            new = F.element_at(codes, i)
            then = lambda n: bind(s["total"] + part(n + 1) - part(n), lambda t: state(put(s["counts"], new, n + 1), t, F.when(i >= window, F.least(s["best"], t)).otherwise(s["best"])))
            return bind(count(s["counts"], new), then)

        step = lambda s, i: F.when(s["best"] <= done, s).otherwise(bind(leave(s, i), lambda left: enter(left, i)))
        start = state(F.repeat(F.lit("0"), 128), F.lit(0).cast("bigint"), none)
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda s: F.when(s["best"] < none, bits(s["best"])).otherwise(F.lit(0.0)))

    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return F.when(F.length(text) >= window, bind(codes, best_of)).otherwise(F.lit(0.0))


def allowed(text: Column) -> Column:
    out = text.rlike(JOINT) & ~text.rlike(UNJOINED)
    for pattern in ALLOWED[:-1]:
        out = out | text.rlike(pattern)
    return out


def base_spans(text: Column) -> Column:
    long_enough = lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6
    return F.concat(matches(text, ASSIGN, "assign", long_enough), matches(text, ACCESS, "access"), matches(text, HEX, "hex"))


def entropy_spans(text: Column) -> Column:
    high = lambda least: lambda h: F.when(allowed(h), F.lit(False)).otherwise(top_entropy(h, enough=least) >= least - SLACK)
    return F.concat(*[matches(text, pattern, kind, high(least)) for kind, (pattern, least) in CLASSES.items()])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with base (spans of the three patterns) and spans (those and the entropy's), sorted by start, then kind.

    Null text: no spans. Each row is judged alone, so repeated rows get equal spans. Texts of many megabytes take time in proportion to their length.
    An empty table gives an empty result. Other columns pass through; columns named base or spans are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.withColumn("base", F.array_sort(base_spans(text)))
    return first.withColumn("spans", F.array_sort(F.concat("base", entropy_spans(text))))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, mask: str) -> Column:
    """The text with each found span, or chain of overlapping ones, replaced by `mask`."""

    def cut(spans: Column) -> Column:
        def between(pieces: Column, start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.substring(some, (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))

        def whole(ends: Column) -> Column:
            # ends[i] is where the chains before span i end, the last where all end
            def joined(pieces: Column) -> Column:
                one = lambda s, i: F.when(s["start"] >= F.get(ends, i), F.concat(between(pieces, F.get(ends, i), s["start"]), F.lit(mask))).otherwise(F.lit(""))
                last = F.element_at(ends, -1)
                return F.concat(F.array_join(F.transform(spans, one), ""), between(pieces, last, F.length(text).cast("bigint")))

            return bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), joined)

        return F.when(F.size(spans) > 0, bind(bind(F.transform(spans, lambda s: s["end"]), lambda e: running(e, lambda a, b: F.greatest(a, b))), whole)).otherwise(text)

    return bind(F.array_sort(F.concat(base_spans(text), entropy_spans(text))), cut)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with each found span, or chain of overlapping ones, replaced by `mask`; null texts stay null. Other columns stay as they are."""
    text = F.col(text_col)
    return docs.withColumn(text_col, F.when(text.isNotNull(), masked(text, mask)))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: the counts of base spans, their digest, and all spans. Rows as for `scan`."""
    found = scan(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
