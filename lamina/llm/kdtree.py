"""Sharding by a k-d tree: nodes split at weighted medians of the widest metadata dimension until each leaf is one shard.

Everything is DataFrame expressions. Dimensions are whole numbers. A median is found digit by digit: the bytes of a node's rows are summed by the
leading digits of the dimension, and of the rows in the digit where the median falls by the next ones, until few rows are left there or one value is;
equal values are told apart by a hash of the row in the same way, and rows alike by a hash of a number of their own; which of these go where makes no difference. So neither outliers nor ids beyond 2**53 blur it, and no table that is summed up has
more than nodes x BINS groups. The few rows around the median are dealt to the two sides, large ones first, so that the left one
comes as near to its bytes as they allow. Only the bounds of splits, one row a node, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import cut, read

#: Bits of a digit.
DIGIT = 12
BINS = 1 << DIGIT
#: Rows around a median that are dealt to either side, about.
NEAR = 64
OVERHEAD = 16
#: Hashes of labels and of rows have so many bits; nulls lie before all.
LABEL = 40
TIE = 60
NULL_ID = -(1 << 63)
#: Not the size: rows alike in it leave a median no change to be dealt in.
DIMS = ("d_source", "d_lang", "d_id")


def _hash(bits: int, *of: Column | str) -> Column:
    return F.xxhash64(*of).bitwiseAND(F.lit((1 << bits) - 1))


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, d_source, d_lang, d_id, tie, copy): bytes, hashed source and language, id, a hash of the row, and one of its own number.

    Numbers hang on how the rows lie, so the table is to be written before it is used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    label = lambda c: F.when(F.col(c).isNull(), F.lit(-1).cast("long")).otherwise(_hash(LABEL, F.col(c).cast("string")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        label("source").alias("d_source"),
        label("lang").alias("d_lang"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID).cast("long")).alias("d_id"),
    )
    return rows.withColumn("tie", _hash(TIE, "doc_id", "text_crc32", "size")).withColumn("copy", _hash(TIE, F.monotonically_increasing_id()))


def _table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few rows of whole numbers as constants of the plan."""
    names, kinds = columns.replace(",", "").split()[::2], columns.replace(",", "").split()[1::2]
    number = lambda x, kind: f"CAST('{int(x)}' AS {kind})"
    if not rows:
        return spark.range(0).select(*[F.lit(0).cast(t).alias(n) for n, t in zip(names, kinds, strict=True)])
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({", ".join(map(number, r, kinds))})' for r in rows)} AS t({', '.join(names)})")


#: What is known of a node's median: its dimension (from 1), the value `at` and the tie `tied` once (`found` of them) they are, the keys `low` to `high` among which the median lies
#: (values, the ties of the rows with the value found, or the copy numbers of those with the tie found, too), and the bytes wanted of the rows there.
STATE = "node int, dim int, found int, at long, tied long, low long, high long, rest long"
FIELDS = tuple(STATE.replace(",", "").split()[::2])


def _placing(dims: tuple[str, ...]) -> tuple[Column, Column]:
    """Where a row joined with STATE lies: -1 before its node's `low`, 1 behind `high`, else 0; and its key."""
    value = F.element_at(F.array(*dims), F.col("dim"))
    key = F.when(F.col("found") == 2, F.col("copy")).when(F.col("found") == 1, F.col("tie")).otherwise(value)
    side = lambda x, low, high: F.when(x < low, F.lit(-1)).when(x > high, F.lit(1)).otherwise(F.lit(0))
    of_value = F.when(F.col("found") >= 1, side(value, F.col("at"), F.col("at"))).otherwise(F.lit(0))
    of_tie = F.when(F.col("found") == 2, side(F.col("tie"), F.col("tied"), F.col("tied"))).otherwise(F.lit(0))
    return F.when(of_value != 0, of_value).when(of_tie != 0, of_tie).otherwise(side(key, F.col("low"), F.col("high"))), key


def _refined(inside: DataFrame, active: list[dict]) -> dict[int, dict]:
    """Narrower bounds of the medians; inside: (node, key, size) of the rows within the bounds so far."""
    table = _table(inside.sparkSession, [(s["node"], max(0, (s["high"] - s["low"]).bit_length() - DIGIT), s["rest"]) for s in active], "node int, shift int, rest long")
    ends = (F.min("key").alias("low"), F.max("key").alias("high"))
    sums = inside.join(F.broadcast(table), "node").withColumn("digit", F.expr("shiftright(key, shift)")).groupBy("node", "digit", "rest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ends)
    w, whole = Window.partitionBy("node").orderBy("digit"), Window.partitionBy("node")
    run = sums.withColumn("upto", F.sum("bytes").over(w)).withColumn("seen", F.sum("n").over(w))
    cross = (F.col("upto") - F.col("bytes") <= F.col("rest")) & (F.col("upto") > F.col("rest"))
    run = run.withColumn("first", F.max(F.when(cross, F.col("seen") - F.col("n"))).over(whole)).withColumn("last", F.max(F.when(cross, F.col("seen"))).over(whole))
    # the digit of the median, and while that holds few rows those around it
    more = F.when(F.col("last") - F.col("first") <= NEAR, NEAR // 2).otherwise(0)
    near = (F.col("seen") - F.col("n") >= F.col("first") - more) & (F.col("seen") <= F.col("last") + more)
    rows = run.where(near).groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.col("upto") - F.col("bytes")).alias("before"), F.first(F.col("last") - F.col("first")).alias("n"))
    return {r["node"]: r.asDict() for r in rows.collect()}


def medians(placed: DataFrame, plan: list[tuple[int, int, int, int, int, int]], dims: tuple[str, ...]) -> list[tuple]:
    """STATE of each node of `plan` (node, dim, lowest value, highest, rows, bytes wanted on the left), narrowed down to few rows or to rows alike."""
    states = [{"node": node, "dim": dim, "found": 0, "at": 0, "tied": 0, "low": low, "high": high, "rest": want, "n": n} for node, dim, low, high, n, want in plan]
    while True:
        for s in states:
            if s["found"] < 2 and s["low"] == s["high"] and s["n"] > NEAR:  # one value: on to the ties; one tie: on to the copies
                s.update({("at", "tied")[s["found"]]: s["low"], "found": s["found"] + 1, "low": 0, "high": (1 << TIE) - 1})
        active = [s for s in states if s["n"] > NEAR and s["low"] < s["high"]]
        if not active:
            return [tuple(s[c] for c in FIELDS) for s in states]
        known = _table(placed.sparkSession, [tuple(s[c] for c in FIELDS) for s in active], STATE)
        at, key = _placing(dims)
        joined = placed.join(F.broadcast(known.drop("rest")), "node")
        found = _refined(joined.where(at == 0).select("node", key.alias("key"), "size"), active)
        for s in active:
            f = found[s["node"]]
            s.update(low=f["low"], high=f["high"], rest=s["rest"] - f["before"], n=f["n"])


def _dealt(around: DataFrame) -> DataFrame:
    """(node, left): the copy numbers of the rows around a median, (node, tie, copy, size, rest), that go to the left: large ones first, as they fit."""
    rows = around.groupBy("node", "rest").agg(F.sort_array(F.collect_list(F.struct("size", "tie", "copy")), asc=False).alias("rows"))
    state = lambda rest, left: F.struct(rest.alias("rest"), left.alias("left"))
    take = lambda s, x: F.when(x["size"] <= s["rest"], state(s["rest"] - x["size"], F.concat(s["left"], F.array(x["copy"])))).otherwise(s)
    return rows.select("node", F.aggregate("rows", state(F.col("rest"), F.array().cast("array<bigint>")), take, lambda s: s["left"]).alias("left"))


def assign(rows: DataFrame, shards: int, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """`rows` (size, tie, copy and the dimensions) with a column `shard` from 0 to shards - 1 of near equal bytes.

    A node is named by its first shard. The tables joined here have one row a node: `shards` rows at most, so they are broadcast. Each level ends in a table.
    """
    ends = lambda: [*[F.min(d).alias(f"a_{d}") for d in dims], *[F.max(d).alias(f"z_{d}") for d in dims]]
    leaves, placed, scale = {0: shards}, rows.withColumn("node", F.lit(0)), {}
    while any(k > 1 for k in leaves.values()):
        boxes = placed.groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *ends()).collect()
        if not scale:
            scale = {d: (float(boxes[0][f"z_{d}"] - boxes[0][f"a_{d}"]) if boxes else 0) or 1.0 for d in dims}
        plan = []
        for box in boxes:
            n = box["node"]
            if leaves[n] > 1:
                d = max(dims, key=lambda d: (box[f"z_{d}"] - box[f"a_{d}"]) / scale[d])
                plan.append((n, dims.index(d) + 1, box[f"a_{d}"], box[f"z_{d}"], box["rows"], box["bytes"] * (leaves[n] // 2) // leaves[n]))
        found = medians(placed, plan, dims)
        halves = [(node, leaves[node] // 2) for node, *_ in found]
        split = _table(rows.sparkSession, found, STATE).join(_table(rows.sparkSession, halves, "node int, half int"), "node")
        sided = placed.join(F.broadcast(split), "node", "left").withColumn("_at", _placing(dims)[0])
        left = _dealt(sided.where("_at = 0 and half is not null").select("node", "tie", "copy", "size", "rest"))
        right = (F.col("_at") == 1) | ((F.col("_at") == 0) & ~F.coalesce(F.array_contains("left", F.col("copy")), F.lit(False)))
        moved = sided.join(F.broadcast(left), "node", "left").withColumn("node", F.col("node") + F.when(F.col("half").isNotNull() & right, F.col("half")).otherwise(0))
        placed = cut(moved.select(*rows.columns, "node"), "placed")
        for n, k in list(leaves.items()):
            if k > 1:
                leaves[n], leaves[n + k // 2] = k // 2, k - k // 2
    return placed.withColumnRenamed("node", "shard")


def number(rows: DataFrame, group: str, name: str) -> DataFrame:
    """`rows` with a gapless number from 0 in each group, in the order of id, CRC-32 and size.

    Rows are dealt by range of these and of their copy numbers, so that neither a group nor rows alike are one task's; each range is numbered as it is sorted, and starts in a
    group where the ranges before it end. The table of these starts has a row for each range and one more for each group.
    """
    order = [group, "doc_id", "text_crc32", "size", "copy"]
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = dealt.withColumn("_range", F.shiftright("_id", 33))  # the partition's number is led by 33 bits of the row's
    starts = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")
    starts = starts.select(group, "_range", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(starts), [group, "_range"]).withColumn(name, (F.col("_id") + F.col("_shift")).cast("long")).drop("_id", "_range", "_shift")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row; the law is `bytes`.

    Null texts count as empty; null ids, sources and languages lie before all others; repeated rows each get a slot, and are dealt to shards one by
    one, so that their bytes part like others'. Rows of an empty table: none. Extra columns are ignored. A split leaves its left side short by less than the smallest of the rows
    around the median that it didn't get.
    """
    rows = cut(metadata(docs), "metadata")
    placed = assign(rows, shards).select("doc_id", "size", "text_crc32", "copy", "shard")
    out = number(placed, "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes. Rows as for `shard`."""
    return shard(read(spark, sf_dir, "documents"))
