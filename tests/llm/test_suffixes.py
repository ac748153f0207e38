"""Suffix-array dedup against a table of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from lamina.llm import suffixes


def plain(texts):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    texts = [(t or "").encode() for t in texts]
    w = suffixes.WINDOW
    count = Counter(t[s : s + w] for t in texts for s in range(len(t) - w + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - w + 1):
            if count[t[s : s + w]] > 1:
                gone[s + 1 : s + w + 1] = True
        kept = bytes(c for c, g in zip(t, gone[1:], strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) > 0).sum()), kept))
    return out


def check(spark, texts, **how):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, block int, `data` string").repartition(5)
    rows = {r["doc_id"]: r for r in suffixes.dedup(table, **how).collect()}
    want = plain(texts)
    assert len(rows) == len(texts)
    for i, (n, gone, spans, kept) in enumerate(want):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == (n, gone, spans, kept), i
    return want


def passages(rng, n, letters="abcdefgh \n\0é"):
    """Texts cut from a few passages, with changed bytes, short overlaps and repeats of their own."""
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    base = [word(rng.randint(300, 2500)) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(base)
            a = rng.randint(0, len(t) // 2)
            t = list(t[a : a + rng.choice([390, 399, 400, 401, 500, 3000])])
            for _ in range(rng.choice([0, 0, 1, 3])):
                t[rng.randrange(len(t))] = rng.choice(letters)
            parts += ["".join(t), word(rng.randint(0, 60))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("block", "hot"), [(1 << 20, 4096), (6000, 3), (6000, 0)])
def test_texts_with_shared_passages(spark, block, hot):
    want = check(spark, passages(random.Random(block + hot), 60), block_bytes=block, hot=hot)
    assert len({g > 0 for _, g, _, _ in want}) == 2


def test_awkward_texts(spark, texts, docs, nothing):
    more = [*texts, "x" * 399, "y" * 400, "z" * 401, "ab" * 700, "ab" * 700 + "c", "\0" * 900, "é" * 300, "e" + "é" * 300, *["copies of one text " * 40] * 40]
    check(spark, more, block_bytes=4000)
    found = suffixes.dedup(docs)
    assert found.count() == docs.count()
    assert suffixes.dedup(nothing).count() == 0


def test_a_third_of_all_texts_are_near_copies(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("etaoin shrdlu") for _ in range(1500))
    near = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = "#"
        near.append("".join(t))
    check(spark, near + passages(rng, 100), block_bytes=20_000, hot=8)


def test_equal_windows_share_their_anchor(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BITS", 10)
    rng = np.random.default_rng(2)
    same = rng.integers(97, 101, 3000, dtype=np.uint8).tobytes()
    for common in (None, rng.integers(0, 2, 1 << suffixes.COMMON_BITS, dtype=np.uint8)):
        sides = []
        for lead in (b"", b"q" * 777):
            text = lead + same
            h, p, a, b = suffixes.anchors(text, common)
            assert (np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b, strict=True)]) == np.arange(len(text) - suffixes.WINDOW + 1)).all()
            sides.append({int(s - len(lead)): (int(k), int(q - s)) for k, q, x, y in zip(h, p, a, b, strict=True) for s in range(x, y + 1) if s >= len(lead)})
        assert sides[0] == sides[1]


def test_deep_shallow_order_and_common_prefixes():
    rng = random.Random(3)
    stems = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))).encode() for _ in range(12)]
    texts = [(s[: rng.randint(0, 300)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60)))) for s in rng.choices(stems, k=700)]
    keys = np.array([rng.randrange(3) for _ in texts], np.uint64)
    order, common = suffixes.deep_shallow(keys, texts)
    want = sorted(range(len(texts)), key=lambda i: (keys[i], texts[i]))
    assert [(int(keys[i]), texts[i]) for i in order] == [(int(keys[i]), texts[i]) for i in want]
    for n in range(1, len(order)):
        x, y = texts[order[n - 1]], texts[order[n]]
        shared = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        assert common[n] == (shared if keys[order[n - 1]] == keys[order[n]] else -1)
