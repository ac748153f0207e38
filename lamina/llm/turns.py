"""Conversation structure repair by a rank-compressed dynamic program.

The roles of a repaired conversation read (s?(ua)+)?. An edit of a row is a macro: a run of up to two inserted turns, then Keep, Rerole or Delete; its code is the
edits' initials (K, IK, IIK, ...). The codes are prefix-free, so audits of equally many macros compare like their sequences of codes, and the audit of a state
at a layer is known by its rank among the layer's audits: a step compares (cost, rank of the parent, code) and keeps a parent pointer. Audits are written
only afterwards, along the pointers.

A stretch of rows is summed up as the cheapest cost and the rank of the least audit from every state to every state (4 x 4), and stretches compose like
their rows do. So conversations are cut into lanes that numpy steps through side by side, and one of any length lies in many blocks: rows are dealt by
range of (conversation, turn), packed into blocks of a table bucketed by block, and do not move again. Only the first and the last conversation of a
block may go on elsewhere; of these the blocks send digests of their rows, then summaries, and last their parts of the repaired text, which one digest a
conversation runs over in order.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import TABLES, bound_batches, cut, read, shared_dir, slices

INSERT, REROLE, DELETE, UNENDED = 5, 1, 2, 5
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Faults of rows; a gone row stands only for its conversation's id.
SOUND, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
#: Kinds of role: by initial, or any other.
INITIALS, OTHER = ("s", "u", "a"), 3
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
#: Rows of a lane, text of a block and of a task that deals blocks, about.
LANE = 64
BLOCK_BYTES = 1 << 20
TASK_BYTES = 32 << 20
FAR = 1 << 40

CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")


def _step(state: int, initial: str) -> int | None:
    """The state after a turn, None where the grammar has no such turn."""
    return {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}[initial].get(state)


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = ASSISTANT if state == USER else USER
    return state


def _macros() -> tuple[np.ndarray, np.ndarray]:
    """Cost and code of the best macro for each (role kind, fault) from state to state; a gone row is passed by without one."""
    cost, code = np.full((4, 5, 4, 4), FAR), np.zeros((4, 5, 4, 4), np.int64)
    for kind in range(4):
        for fault in range(5):
            for x in range(4):
                if fault == GONE:
                    cost[kind, fault, x, x] = 0
                    continue
                for c, name in enumerate(CODES):
                    y, price = _inserted(x, len(name) - 1), INSERT * (len(name) - 1)
                    ends: list[tuple[int | None, int]] = [(y, price + DELETE)]
                    if name[-1] != "D":
                        if fault in (BLANK, DUPLICATE):
                            continue
                        price += UNENDED if fault == TRUNCATED else 0
                        keep = name[-1] == "K"
                        kinds = (INITIALS[kind : kind + 1] if kind < OTHER else ()) if keep else ("u", "a")
                        ends = [(_step(y, i), price + (0 if keep else REROLE)) for i in kinds]
                    for end, p in ends:
                        if end is not None and p < cost[kind, fault, x, end]:  # codes ascend, so the first of equal costs is the least
                            cost[kind, fault, x, end], code[kind, fault, x, end] = p, c
    return cost, code


COST, CODE = _macros()


def ranks(cost: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many of the last two axes' 16 entries that can be reached have a smaller key."""
    flat = np.where(cost < FAR, key, 1 << 30).reshape(*key.shape[:-2], 16)
    return (flat[..., None, :] < flat[..., :, None]).sum(-1).reshape(key.shape)


def composed(cost: np.ndarray, rank: np.ndarray, more: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two stretches as one: (..., from, to) costs and ranks, and the state between them on the best way."""
    total = np.minimum(cost[..., :, :, None] + more[..., None, :, :], FAR)
    key = rank[..., :, :, None] * 16 + then[..., None, :, :]
    best = total.min(-2)
    key = np.where(total == best[..., None, :], key, 1 << 30)
    between = key.argmin(-2)
    return best, ranks(best, key.min(-2)), between


NOTHING = (np.where(np.eye(4, dtype=bool), 0, FAR), np.zeros((4, 4), np.int64))


#: Turns to insert behind the last row, by the state reached.
BEHIND = np.array([0, 2, 1, 0])


def finished(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, state reached) of the cheapest whole audits from START, the least of the cheapest, of stretches (n, 4, 4)."""
    price = cost[:, START] + INSERT * BEHIND
    least = price.min(1)
    key = np.where(price == least[:, None], rank[:, START] * 3 + BEHIND, 1 << 30)
    return least, key.argmin(1)


class Lanes:
    """Stretches of rows, stepped through side by side; `kind` and `fault` of all rows, and where each stretch starts and ends."""

    def __init__(self, kind: np.ndarray, fault: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n, longest = len(starts), int((ends - starts).max(initial=0))
        self.starts, self.lens = starts, ends - starts
        self.cost, self.rank = np.tile(NOTHING[0], (n, 1, 1)), np.zeros((n, 4, 4), np.int64)
        self.parent, self.kind, self.fault = [], kind, fault
        for t in range(longest):
            live = np.flatnonzero(self.lens > t)
            row = starts[live] + t
            self.cost[live], self.rank[live], between = composed(self.cost[live], self.rank[live], COST[kind[row], fault[row]], CODE[kind[row], fault[row]])
            whole = np.zeros((n, 4, 4), np.int8)
            whole[live] = between
            self.parent.append(whole)

    def back(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State before each row and behind it on each stretch's best way from state `first` to state `last`; -1 for rows of no stretch."""
        before, behind = (np.full(len(self.kind), -1) for _ in range(2))
        at, lane = last.copy(), np.arange(len(last))
        for t in range(len(self.parent) - 1, -1, -1):
            live = lane[self.lens > t]
            row, x = self.starts[live] + t, self.parent[t][live, first[live], at[live]]
            before[row], behind[row], at[live] = x, at[live], x
        return before, behind


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that the CRC-32 of `conv_id:turn` (null: one space) asks for; `gone` marks dropped ones."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), some("role").alias("role"), some("text").alias("text"))
    harm = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(F.col("harm") <= 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    found = named.withColumn("harm", harm).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"), "harm")
    return found.withColumn("_copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "harm")


def _fault(text: Column) -> Column:
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(SOUND)


LISTS = {"conv": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.binary(), "fault": pa.int32()}


def _packed(rows: DataFrame) -> DataFrame:
    """The bucketed table of blocks: rows in the order of (conv_id, turn, role, MD5 of the text), numbered so that blocks are in that order too."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    text = F.when(F.col("gone"), "").otherwise(F.coalesce(F.col("text"), F.lit("")))
    fault = F.when(F.col("gone"), GONE).otherwise(_fault(text))
    keyed = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text.cast("binary").alias("text"), fault.cast("int").alias("fault"), F.md5(text.cast("binary")).alias("tie"), F.monotonically_increasing_id().alias("salt"))
    order = ["conv_id", "turn", "role", "tie", "salt"]  # the salt tells rows alike apart, so that however many there are ranges can part them

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in slices(whole, "text", BLOCK_BYTES):
                one = lambda c, b=b: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([b.column(c)]))
                yield pa.RecordBatch.from_arrays([pa.array([block]), *[one(c) for c in ("conv_id", "turn", "role", "text", "fault")]], ["block", *LISTS])
                block += 1

    sorted_ = bound_batches(keyed.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
    name = f"{TABLES}turns_{uuid.uuid4().hex}"
    blocks = sorted_.mapInArrow(work, "block long, conv array<long>, turn array<long>, role array<string>, text array<binary>, fault array<int>")
    files = min(parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    blocks.write.bucketBy(files, "block").option("path", f"{shared_dir(spark)}/lamina-scratch/{name}").saveAsTable(name)
    return spark.table(name)


class Block:
    """One block's rows, their conversations, and what they come to once it is known which were seen before."""

    def __init__(self, row: dict) -> None:
        self.name, self.conv, self.turn, self.role, self.text = row["block"], row["conv"], row["turn"], row["role"], row["text"]
        self.fault = np.array(row["fault"], np.int64)
        n = len(self.conv)
        heads = [i for i in range(n) if i == 0 or self.conv[i] != self.conv[i - 1]]
        self.starts, self.ends = np.array(heads), np.array([*heads[1:], n])
        self.open = sorted({0, len(heads) - 1})
        self.kind = np.array([{"s": 0, "u": 1, "a": 2}.get(r[:1], OTHER) for r in self.role], np.int64)

    def digest(self, i: int) -> bytes:
        role = self.role[i].encode()
        return xxhash.xxh3_128_digest(len(role).to_bytes(8, "big") + role + self.text[i])

    def entries(self) -> Iterator[tuple[int | None, bytes]]:
        """Digests of the rows of conversations that other blocks may hold rows of, each once."""
        for c in self.open:
            for d in {self.digest(i) for i in range(self.starts[c], self.ends[c]) if self.fault[i] != GONE}:
                yield self.conv[self.starts[c]], d

    def judge(self, before: set[tuple[int | None, bytes]], only_open: bool = False) -> None:
        """Mark rows seen earlier, here or (`before`) in other blocks; then step through all lanes (`only_open`: of the conversations that may go on elsewhere)."""
        spans = list(zip(self.starts.tolist(), self.ends.tolist(), strict=True))
        self.own = self.open if only_open else list(range(len(spans)))
        for c in self.own:
            a, b = spans[c]
            if b - a > 1 or c in self.open:
                seen: set[bytes] = set()
                for i in range(a, b):
                    if self.fault[i] != GONE:
                        d = self.digest(i)
                        if self.fault[i] != BLANK and (d in seen or (self.conv[a], d) in before):
                            self.fault[i] = DUPLICATE
                        seen.add(d)
        pieces = [(s, min(s + LANE, spans[c][1])) for c in self.own for s in range(*spans[c], LANE)]
        self.lanes = Lanes(self.kind, self.fault, *(np.array(x) for x in zip(*pieces, strict=True)))
        self.first_lane = np.append(np.searchsorted(self.lanes.starts, self.starts[self.own]), len(pieces))
        self.joints = {}
        self.cost, self.rank = self.lanes.cost[self.first_lane[:-1]], self.lanes.rank[self.first_lane[:-1]]
        for k in np.flatnonzero(np.diff(self.first_lane) > 1).tolist():
            for lane in range(self.first_lane[k] + 1, self.first_lane[k + 1]):
                self.cost[k], self.rank[k], self.joints[lane] = composed(self.cost[k], self.rank[k], self.lanes.cost[lane], self.lanes.rank[lane])
        self.stats = self._stats()

    def _stats(self) -> dict[str, np.ndarray]:
        """Of each conversation: rows with each fault, illegal neighbours, kinds of the first and last role (-1: no rows), and its turns' ends and number."""
        n = len(self.starts)
        of = np.repeat(np.arange(n), self.ends - self.starts)
        live = np.flatnonzero(self.fault != GONE)
        conv, kind, fault = of[live], self.kind[live], self.fault[live]
        same = conv[1:] == conv[:-1]
        out = {name: np.bincount(conv[fault == f], minlength=n) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        out["illegal"] = np.bincount(conv[1:][same & ~LEGAL[kind[:-1], kind[1:]]], minlength=n)
        for name, step in (("first", -1), ("last", 1)):  # the value written last stays
            out[name] = np.full(n, -1)
            out[name][conv[::step]] = kind[::step]
        dated = [i for i in live.tolist() if self.turn[i] is not None]
        turn, conv = np.array([self.turn[i] for i in dated], np.int64), of[dated]
        new = np.ones(len(turn), bool)
        new[1:] = (turn[1:] != turn[:-1]) | (conv[1:] != conv[:-1])
        out["turns"] = np.bincount(conv[new], minlength=n)
        for name, step in (("low", -1), ("high", 1)):
            out[name] = np.zeros(n, np.int64)
            out[name][conv[::step]] = turn[::step]
        return out

    def summary(self, k: int) -> dict:
        """What other blocks need to know of the k-th conversation judged."""
        c = self.own[k]
        one = {name: int(x[c]) for name, x in self.stats.items()}
        return {"conv_id": self.conv[self.starts[c]], "block": self.name, "costs": self.cost[k].ravel().tolist(), "ranks": self.rank[k].ravel().tolist(), **one}

    def plans(self) -> list[dict]:
        """PLAN of each conversation as if none went on elsewhere."""
        price, state = finished(self.cost, self.rank)
        s = self.stats
        gaps = np.where(s["turns"] > 0, s["high"] - s["low"] + 1 - s["turns"], 0)
        columns = {"finish": state, "behind": BEHIND[state], "gaps": gaps, **{k: s[k] for k in COUNTS}, "cost": price}
        rows = zip(*[x.tolist() for x in columns.values()], strict=True)
        return [{"conv_id": self.conv[a], "blocks": 1, "begin": START, "final": True, **dict(zip(columns, r, strict=True))} for a, r in zip(self.starts.tolist(), rows, strict=True)]

    def edits(self, ways: dict[int, tuple[int, int]]) -> None:
        """Find the states around each row, given the first and last state of the block's conversations."""
        first, last = np.zeros(len(self.lanes.starts), np.int64), np.zeros(len(self.lanes.starts), np.int64)
        for c, (x, y) in ways.items():
            a, b = self.first_lane[c], self.first_lane[c + 1]
            for lane in range(b - 1, a, -1):
                last[lane] = y
                first[lane] = y = int(self.joints[lane][x, y])
            first[a], last[a] = x, y
        self.before, self.behind = self.lanes.back(first, last)

    def written(self, c: int) -> tuple[str, list[tuple[str, bytes]]]:
        """Audit and turns of a conversation's rows."""
        audit, turns = [], []
        for i in range(self.starts[c], self.ends[c]):
            x, y, fault = int(self.before[i]), int(self.behind[i]), int(self.fault[i])
            if fault == GONE:
                continue
            code = CODES[CODE[self.kind[i], fault, x, y]]
            audit.append(code)
            for k in range(1, len(code)):
                turns.append((NAMES[_inserted(x, k)], b""))
            if code[-1] != "D":
                turns.append((self.role[i] if code[-1] == "K" else NAMES[y], self.text[i]))
        return "".join(audit), turns


def _tail(state: int, n: int) -> list[tuple[str, bytes]]:
    return [(NAMES[_inserted(state, k)], b"") for k in range(1, n + 1)]


def _lines(turns: list[tuple[str, bytes]]) -> bytes:
    return b"\n".join(r.encode() + b":" + t for r, t in turns)


SUMMARY = "conv_id long, block long, costs array<long>, ranks array<int>, blank long, duplicate long, truncated long, illegal long, first long, last long, low long, high long, turns long"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
PLAN = f"conv_id long, block long, blocks int, begin int, finish int, behind int, final boolean, {REPORT}"


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def plan_of(parts: list[dict]) -> list[dict]:
    """How a conversation's blocks, in order, are to be repaired: each one's first and last state, and the report of the whole."""
    cost, rank = NOTHING
    joints, report = [], dict.fromkeys((*COUNTS, "turns"), 0)
    last, low, high = -1, None, None
    for p in parts:
        cost, rank, between = composed(cost, rank, np.array(p["costs"]).reshape(4, 4), np.array(p["ranks"]).reshape(4, 4))
        joints.append(between)
        for k in report:
            report[k] += p[k]
        if p["first"] >= 0:
            report["illegal"] += int(last >= 0 and not LEGAL[last, p["first"]])
            last = p["last"]
        if p["turns"]:
            report["turns"] -= int(high == p["low"])
            low, high = p["low"] if low is None else low, p["high"]
    price, end = finished(cost[None], rank[None])
    turns, state = report.pop("turns"), int(end[0])
    common = {"blocks": len(parts), "gaps": high - low + 1 - turns if turns else 0, **report, "cost": int(price[0])}
    out: list[dict] = []
    for p, between in zip(parts[::-1], joints[::-1], strict=True):
        begin = int(between[START, state])
        out.append({"conv_id": p["conv_id"], "block": p["block"], "begin": begin, "finish": state, "behind": 0 if out else int(BEHIND[state]), "final": not out, **common})
        state = begin
    return out[::-1]


def _schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for b in batches:
        for i in range(b.num_rows):
            row = {name: b.column(name)[i].as_py() for name in b.schema.names}
            yield row, Block(row)


def _seen(row: dict) -> set[tuple[int | None, bytes]]:
    return {(s["conv_id"], bytes(s["digest"])) for s in row["seen"] or []}


class Repair:
    """The steps that reports and repaired turns share; `rows`: (conv_id, turn, role, text, gone)."""

    def __init__(self, rows: DataFrame) -> None:
        self.spark = rows.sparkSession
        self.blocks = _packed(rows)
        digests = self.blocks.mapInArrow(self._digests, "conv_id long, digest binary, block long")
        sent = cut(digests, "turn-digests")
        first = sent.groupBy("conv_id", "digest").agg(F.min("block").alias("least"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("conv_id", "c").withColumnRenamed("digest", "d")
        again = sent.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where("block > least")
        seen = again.groupBy("block").agg(F.collect_list(F.struct("conv_id", "digest")).alias("seen"))
        self.known = self.blocks.join(cut(seen, "turn-seen").hint("shuffle_hash"), "block", "left")
        schema = _schema(self.spark, SUMMARY)

        def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, block in _blocks(batches):
                block.judge(_seen(row), only_open=True)
                yield from _arrow([block.summary(k) for k in range(len(block.own))], schema).to_batches()

        planned = _schema(self.spark, PLAN)

        def plan(parts: pa.Table) -> pa.Table:
            return _arrow(plan_of(sorted(parts.to_pylist(), key=lambda p: p["block"])), planned)

        whole = self.known.mapInArrow(summaries, SUMMARY).groupBy("conv_id").applyInArrow(plan, PLAN)
        names = [f.name for f in planned]
        plans = cut(whole, "turn-plans").groupBy("block").agg(F.collect_list(F.struct(*names)).alias("plans"))
        self.planned = self.known.join(plans.hint("shuffle_hash"), "block", "left")

    @staticmethod
    def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            found = list(block.entries())
            conv, digest = [c for c, _ in found], [d for _, d in found]
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(digest, pa.binary()), pa.array([block.name] * len(conv), pa.int64())], ["conv_id", "digest", "block"])

    @staticmethod
    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[tuple[int, dict]]]]:
        """Each block with its edits known, and (conversation of the block, its plan)."""
        for row, block in _blocks(batches):
            block.judge(_seen(row))
            known = {p["conv_id"]: p for p in row["plans"] or []}
            out = [(c, known[p["conv_id"]] if c in block.open else p) for c, p in enumerate(block.plans())]
            block.edits({c: (p["begin"], p["finish"]) for c, p in out})
            yield block, out


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of `rows` (conv_id, turn, role, text, gone).

    Turns go up, nulls first; rows of one turn by role, then by MD5 of the text. A null id is a conversation of its own; null texts are empty and null roles have no
    initial. Repeated rows are duplicates of each other. Conversations of which all rows are gone have zeros, an empty audit and the digest of the empty
    string. An empty table gives an empty result; other columns are ignored.
    """
    steps = Repair(rows)
    done = f"conv_id long, block long, whole boolean, {REPORT}, audit string, sha string, part binary"
    schema = _schema(rows.sparkSession, done)
    names = [f.split()[0] for f in REPORT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, convs in Repair.repaired(batches):
            out = []
            for c, p in convs:
                audit, turns = block.written(c)
                if p["final"]:
                    audit, turns = audit + "I" * p["behind"], turns + _tail(p["finish"], p["behind"])
                lines, whole = _lines(turns), p["blocks"] == 1
                part = None if whole else (b"\n" if turns else b"") + lines
                out.append({"conv_id": p["conv_id"], "block": block.name, "whole": whole, **{k: p[k] for k in names}, "audit": audit, "sha": hashlib.sha256(lines).hexdigest() if whole else None, "part": part})
            yield from _arrow(out, schema).to_batches()

    found = cut(steps.planned.mapInArrow(work, done), "turn-reports")
    final = f"conv_id long, {REPORT}, audit string, repaired_sha256 string"
    last_schema = _schema(rows.sparkSession, final)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One digest runs over a conversation's parts, each led by a new line; none of them stays in memory."""
        held: dict | None = None

        def closed() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield from _arrow([{**held["row"], "audit": "".join(held["audit"]), "repaired_sha256": held["sha"].hexdigest()}], last_schema).to_batches()

        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(name)[i].as_py() for name in b.schema.names}
                if held is None or held["row"]["conv_id"] != row["conv_id"]:
                    yield from closed()
                    held = {"row": {k: row[k] for k in ("conv_id", *names)}, "audit": [], "sha": hashlib.sha256(), "begun": False}
                held["audit"].append(row["audit"])
                if row["part"]:
                    held["sha"].update(row["part"] if held["begun"] else row["part"][1:])
                    held["begun"] = True
        yield from closed()

    whole = found.where("whole").select("conv_id", *names, "audit", F.col("sha").alias("repaired_sha256"))
    parts = found.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", *names, "audit", "part").mapInArrow(stream, final)
    return whole.union(parts)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, block, place, role, text) of each turn of the repaired conversations, in the order of (block, place). Rows as for `report`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, convs in Repair.repaired(batches):
            for c, p in convs:
                turns = block.written(c)[1] + (_tail(p["finish"], p["behind"]) if p["final"] else [])
                n = len(turns)
                columns = [pa.array([p["conv_id"]] * n, pa.int64()), pa.array([block.name] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "place", "role", "text"])

    return Repair(rows).planned.mapInArrow(work, "conv_id long, block long, place long, role string, text string")


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and then repaired. Rows as for `report`."""
    return report(damaged(read(spark, sf_dir, "conversations")))
