"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact size, hash cell). Of each source the whole repeats come first; what remains of its
budget is met by some documents once more. Small budgets, and the last words of large ones (of which every size first gives its proportional share), are a bounded
knapsack over the counts of each size: dynamic programming over the reachable sums. Only histograms reach the knapsack, one row a distinct size. Which documents of a size are taken is
decided by a seeded hash: cells in order, and within the cell where the count ends, by rank. Where it ends among rows alike, which have one hash, these are numbered,
and told apart by a hash of the number in the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import WORD, cut, read, unused

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Words that the dynamic program covers, at most.
TABLE = 1 << 18
#: Rows of a plan, one a distinct size of a source, that are broadcast.
MOST_BROADCAST = 200_000


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, most: int = TABLE) -> np.ndarray:
    """How many documents of each size (positive, distinct) to take, at most `counts`, so that the sizes sum up close to `budget`.

    The sum never exceeds the budget. Budgets of `most` words at most are met as closely as any choice could. Of larger ones all but the last words go in proportion
    to the counts, and the last ones, half of `most` or what rounding left, as closely as the documents not yet taken allow; only where that is more than `most` words
    are the largest sizes that fit taken first.
    """
    take = np.zeros(len(sizes), np.int64)
    total = sum(int(s) * int(c) for s, c in zip(sizes.tolist(), counts.tolist(), strict=True))
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    if budget > most:
        take = np.array([int(c) * (budget - most // 2) // total for c in counts.tolist()], np.int64)
    rest = budget - sum(int(s) * int(t) for s, t in zip(sizes.tolist(), take.tolist(), strict=True))
    limit = most
    order = np.argsort(-sizes)
    moved = True
    while rest > limit and moved:  # one of each size in turn
        moved = False
        for i in order:
            if rest <= limit:
                break
            if take[i] < counts[i] and sizes[i] <= rest:
                take[i] += 1
                rest -= int(sizes[i])
                moved = True
    # bounded knapsack: by[s] is the item that first reached the sum s, in binary multiples of each size's count
    rest_table = min(rest, limit)
    reach = np.zeros(rest_table + 1, bool)
    reach[0] = True
    by, used = np.full(rest_table + 1, -1, np.int32), np.zeros(rest_table + 1, np.int32)
    items: list[tuple[int, int]] = []
    for i in order[::-1]:
        left, many = int(min(counts[i] - take[i], rest_table // max(int(sizes[i]), 1))), 1
        while left > 0:
            n = min(many, left)
            step = n * int(sizes[i])
            if step <= rest_table:
                new = np.zeros_like(reach)
                new[step:] = reach[:-step]
                new &= ~reach
                by[new], used[new] = len(items), n
                items.append((int(i), n))
                reach |= new
            left, many = left - n, many * 2
        if reach[rest_table]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(sizes[i])
    return take


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, stopped at MOST_REPEATS times the size.

    A source is capped if the level, at which the sources not capped before it (in order of cap to weight) would share what
    is left, lifts it above its cap; the last level holds for the rest. This is where resharing the excess by weight ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    named = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), place + 1)).withColumn("cap", F.lit(float(MOST_REPEATS)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(past), F.lit(0.0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = named.withColumn("level", left / weights).withColumn("at", F.row_number().over(order)).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    last = levels.withColumn("final", F.min(F.when(~F.col("capped"), F.struct("at", "level"))).over(whole))
    # sources behind the first that is not capped are not either
    last = last.withColumn("capped", F.col("final").isNull() | (F.col("at") < F.col("final.at")))
    return last.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final.level") * F.col("weight")).alias("target"))


def _knapsack(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int(pdf["source_size"].iloc[0]), round(float(pdf["target"].iloc[0]))
    repeats = min(MOST_REPEATS, target // total) if total else 0
    more = fit(sizes, counts, target - repeats * total) if repeats < MOST_REPEATS else np.zeros(len(sizes), np.int64)
    return pd.DataFrame({"source": pdf["source"], "size": sizes, "repeats": repeats, "more": more})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row, 0 to MOST_REPEATS).

    Sizes are numbers of words; a null or empty text has 0 and is taken 0 times. A null source is a source of its own, last
    in the order. Of the rows of one source and size, those with the least seeded hash of id and text get the additional copy, so
    reruns agree; of rows alike in both as many get it as the count asks for, whichever of them. An empty table gives an empty result. Other columns pass
    through, whatever their names; those named like the four new ones are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = {"mix_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "mix_hash": F.xxhash64(F.lit(seed), F.col(id_col), text)}
    cell = F.shiftright(F.col("hash"), 54).cast("int")  # the order of cells is that of the hashes
    rows = cut(docs.select(F.col(source_col).alias("source"), added["mix_size"].alias("size"), added["mix_hash"].alias("hash")).withColumn("cell", cell), "rows")
    cells = cut(rows.groupBy("source", "size", "cell").agg(F.count("*").alias("n")), "cells")
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = cut(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    known = sizes.where("size > 0").join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    kind = rows.schema["source"].dataType.simpleString()
    plan = cut(known.groupBy("source").applyInPandas(_knapsack, f"source {kind}, size long, repeats long, more long"), "plan")

    same = lambda *names: [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    renamed = lambda df: df.toDF(*[f"_{c}" for c in df.columns])

    def ends(keyed: DataFrame, wanted: DataFrame, cells: DataFrame, key: str) -> DataFrame:
        """(source, size, last, taken, of): the key at which each count (source, size, more) ends, in order of keys, and how many rows with it are taken of how many."""
        before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("cell")) - F.col("n")
        at = cells.withColumn("before", before).join(renamed(wanted), same("source", "size")).where("before < _more and before + n >= _more")
        at = at.select("source", "size", "cell", (F.col("_more") - F.col("before")).alias("rank"))
        # rows alike are added up before they are ranked
        alike = keyed.groupBy("source", "size", "cell", key).agg(F.count("*").alias("n")).join(renamed(at), same("source", "size", "cell"))
        upto = F.sum("n").over(Window.partitionBy("source", "size", "cell").orderBy(key))
        found = alike.withColumn("taken", F.col("_rank") - upto + F.col("n")).where("taken between 1 and n")
        return found.select("source", "size", F.col(key).alias("last"), "taken", F.col("n").alias("of"))

    last = cut(ends(rows, plan.where("more > 0").select("source", "size", "more"), cells, "hash"), "last")
    apart = last.where("taken < of")
    own, at, copy = unused(docs.columns, "own", "at", "copy")
    parted = bool(apart.head(1))
    if parted:  # rows alike are numbered, and of each kind those with the least hash of the number are taken
        docs = cut(docs.withColumn(copy, F.xxhash64(F.monotonically_increasing_id())), "copies")
        named = docs.select(F.col(source_col).alias("source"), added["mix_size"].alias("size"), added["mix_hash"].alias("hash"), F.col(copy).alias("copy"))
        alike = named.join(F.broadcast(renamed(apart)) if apart.count() <= MOST_BROADCAST else renamed(apart), [*same("source", "size"), F.col("hash") == F.col("_last")])
        alike = cut(alike.select("source", "size", "copy", F.shiftright("copy", 54).cast("int").alias("cell")), "alike")
        copies = ends(alike, apart.select("source", "size", F.col("taken").alias("more")), alike.groupBy("source", "size", "cell").agg(F.count("*").alias("n")), "copy")
        ended = last.join(renamed(copies.select("source", "size", F.col("last").alias("copy"))), same("source", "size"), "left").select("source", "size", "last", "_copy")
    else:
        ended = last.select("source", "size", "last", F.lit(None).cast("long").alias("_copy"))
    rule = plan.join(renamed(ended), same("source", "size"), "left").select("source", "size", "repeats", F.col("_last").alias("last"), F.col("__copy").alias("copy"))
    rule = cut(rule, "rule")

    # one row a distinct size of a source: broadcast while that is a few MB, shuffled beyond
    new = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    kept = [c for c in docs.columns if c.lower() not in new and c != copy]
    row, key, size_, repeats, last_, copy_ = unused([*docs.columns, own, at], "row", "source", "size", "repeats", "last", "last_copy")
    small = lambda df, most: F.broadcast(df) if df.count() <= most else df
    number = F.col(copy) if parted else F.lit(None).cast("long")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(row), F.col(source_col).alias(own), added["mix_size"].alias("mix_size"), added["mix_hash"].alias(at), number.alias(copy))
    out = named.join(small(goal.toDF(key, "mix_source_size", "mix_target"), 50_000), F.col(own).eqNullSafe(F.col(key)), "left").drop(key)
    out = out.join(small(rule.toDF(key, size_, repeats, last_, copy_), MOST_BROADCAST), F.col(own).eqNullSafe(F.col(key)) & (F.col("mix_size") == F.col(size_)), "left")
    once = (F.col(at) < F.col(last_)) | ((F.col(at) == F.col(last_)) & (F.col(copy_).isNull() | (F.col(copy) <= F.col(copy_))))
    copies = F.coalesce(F.col(repeats), F.lit(0).cast("long")) + F.coalesce(once.cast("long"), F.lit(0).cast("long"))
    return out.select(*[F.col(f"{row}.`{c}`").alias(c) for c in kept], "mix_size", "mix_source_size", "mix_target", copies.alias("mix_copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes. Rows as for `mix`."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    size = F.col("mix_size")
    return mix(docs).select("doc_id", size.alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (size * F.col("mix_copies")).alias("taken"))
