"""Conversation repair against a plain search over audits as strings."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import Row

from lamina.llm import turns

WS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """(conv_id, turn, role, text) of the rows that stay, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        role, text = one(role), one(text)
        harm = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        kept = out[conv]
        if harm == 0:
            continue
        text = "" if harm == 1 else text.translate({ord(c): None for c in ".!?"}) if harm == 2 else text
        kept.extend([(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1))
    return out


def plain_report(conv, rows):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[2])))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    dated = [t for t, *_ in rows if t is not None]
    initial = [r[1][:1] for r in rows]
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    # by state (the last initial, "" at the start): the least (cost, audit) and its turns
    best = {"": (0, "", [])}
    grown = lambda best: _inserted(_inserted(best, step), step)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, out) in grown(best).items():
            for edit, name, price in (("D", None, 2), ("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                if edit == "D":
                    to = state
                elif fault in ("blank", "duplicate") or (state, name[:1]) not in step:
                    continue
                else:
                    to = step[state, name[:1]]
                    price += 5 if fault == "truncated" else 0
                found = (cost + price, audit + edit, out + ([] if edit == "D" else [f"{name}:{text}"]))
                if to not in new or found[:2] < new[to][:2]:
                    new[to] = found
        best = new
    cost, audit, out = min((best := grown(best))[s] for s in ("", "a") if s in best)
    return Row(
        conv_id=conv, gaps=max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0, blank=faults.count("blank"), duplicate=faults.count("duplicate"),
        truncated=faults.count("truncated"), illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:], strict=False)),
        cost=cost, audit=audit, repaired_sha256=hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def _inserted(best, step):
    new = dict(best)
    for state, (cost, audit, out) in best.items():
        for name in ("user", "assistant"):
            to = step.get((state, name[0]))
            if to is not None:
                found = (cost + 5, audit + "I", out + [f"{name}:"])
                if to not in new or found[:2] < new[to][:2]:
                    new[to] = found
    return new


TURNS = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", gone int, `block` string").repartition(3)


def check(spark, rows):
    want = sorted(map(str, (plain_report(c, r) for c, r in plain_damage(rows).items())))
    found = turns.report(turns.damaged(table(spark, rows)))
    assert found.columns == [*turns.SUMMARY.split()[:1], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(str, found.collect())) == want
    return want


def conversations(rng, n, longest):
    say = ["Yes.", "No", "What?", "Fine!  ", "  ", "", "So\n", "a.b", None, "long " * 300 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "usr", "tool", "", None, "Agent"]
    return [(c, t if rng.random() < 0.9 else rng.choice([None, t + 3, 1]), rng.choice(roles), rng.choice(say)) for c in range(n) for t in range(rng.randint(1, longest))]


def test_reports_of_awkward_conversations(spark):
    rows = conversations(random.Random(4), 120, 9) + [(None, 1, "user", "x."), (None, None, None, None), (7, 1, "user", "x."), (7, 1, "user", "x.")]
    want = check(spark, rows)
    assert len(want) == 121
    assert turns.report(turns.damaged(table(spark, rows).limit(0))).count() == 0


@pytest.mark.parametrize(("lane", "block"), [(5, 200), (64, 3000)])
def test_a_conversation_that_holds_a_third_of_all_rows(spark, monkeypatch, lane, block):
    monkeypatch.setattr(turns, "LANE", lane)
    monkeypatch.setattr(turns, "BLOCK_BYTES", block)
    rng = random.Random(lane)
    rows = conversations(rng, 60, 6)
    rows += [(1000, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"words {t}."])) for t in range(300)]
    rows += [(1001, 5, "user", "the same.")] * 150
    check(spark, rows)


def test_repaired_turns_follow_the_grammar(spark):
    rows = conversations(random.Random(9), 40, 12)
    damaged = turns.damaged(table(spark, rows))
    found = defaultdict(list)
    for r in sorted(turns.repaired_turns(damaged).collect(), key=lambda r: (r["conv_id"], r["block"], r["place"])):
        found[r["conv_id"]].append((r["role"], r["text"]))
    for r in turns.report(damaged).collect():
        said = found[r["conv_id"]]
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest() == r["repaired_sha256"]
        line = "".join(a[0] for a, _ in said).removeprefix("s")
        assert line == "ua" * (len(line) // 2) and len(said) == sum(c in "KIR" for c in r["audit"])


def test_macro_codes_are_prefix_free_and_in_order():
    assert all(not b.startswith(a) for a in turns.CODES for b in turns.CODES if a != b)
    assert turns.CODES == sorted(turns.CODES)
