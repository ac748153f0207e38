"""Operators that compare or deal rows, against plain restatements, on awkward rows."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import bpe, common, counts, flac, forest, kdtree, mixing, simhash, substrings

# SimHash


def hashed(docs):
    rows = [(r["doc_id"], brute.simhash(r["text"])) for r in docs.collect()]
    keys = sorted({f for _, f in rows})
    root = dict(zip(keys, brute.linked(keys, lambda a, b: (a ^ b).bit_count() <= 4), strict=True))
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return sorted((str(i), f"{f:016x}", str(least.get(root[f]))) for i, f in rows)


def got(found):
    return sorted((str(r["doc_id"]), r["fp"].hex(), str(r["component_id"])) for r in found.select("doc_id", "fp", "component_id").collect())


def test_simhash_of_every_row(docs, nothing):
    assert got(simhash.near_duplicates(docs)) == hashed(docs)
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_of_near_copies_with_small_trees(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(150):
        words = list(base) if i % 3 else [f"v{rng.randrange(900)}" for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(9)}"
        rows.append((i * 7 - 20, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = hashed(docs)
    assert len({c for *_, c in expected}) < 150
    assert got(simhash.near_duplicates(docs)) == expected
    assert got(simhash.near_duplicates(docs, most=8)) == expected


@pytest.mark.parametrize("radius", [0, 2, 4, 11])
def test_bk_trees_find_all_pairs_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 63, (60, 5)).astype(np.uint64)).sum(1, dtype=np.uint64) for s in seeds]))
    rng.shuffle(fps)
    group = np.sort(rng.integers(0, 4, len(fps)))
    asked = rng.integers(-1, 4, len(fps))
    near = lambda a, b: (int(a) ^ int(b)).bit_count() <= radius
    trees = simhash.Trees(fps[:, None], group)
    found = sorted(p for a, b in trees.search(fps[:, None], asked, radius) for p in zip(a.tolist(), b.tolist(), strict=True))
    assert found == [(i, j) for i in range(len(fps)) for j in range(len(fps)) if asked[i] == group[j] and near(fps[i], fps[j])]
    inside = [(int(f), int(g)) for f, g in zip(fps, group, strict=True)]
    assert trees.roots(group, radius).tolist() == brute.linked(inside, lambda a, b: a[1] == b[1] and near(a[0], b[0]))


def test_crowded_groups_are_joined_as_all_pairs_would(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = lambda n, most: np.array([sum(1 << int(b) for b in rng.choice(40, rng.integers(0, most + 1), replace=False)) for _ in range(n)], np.uint64)
    fps = np.unique(np.concatenate([centre[0] ^ flips(900, 6), centre[1] ^ flips(300, 9), centre[2] ^ flips(40, 20)]))
    table = spark.createDataFrame([(int(f).to_bytes(8, "big"),) for f in fps], "fp binary").repartition(4)
    want = brute.linked([int(f) for f in fps], lambda a, b: (a ^ b).bit_count() <= 4)
    place = {int(f).to_bytes(8, "big"): i for i, f in enumerate(fps)}
    for broadcast, queries in ((1 << 18, 1 << 16), (0, 100)):
        monkeypatch.setattr(simhash, "BROADCAST", broadcast)
        monkeypatch.setattr(simhash, "QUERIES", queries)
        monkeypatch.setattr(simhash, "PIVOTS", 8)
        found = simhash.links(table, 4, simhash.pigeonhole(64, 4, 10), most=60).collect()
        ends = np.array([(place[bytes(r["a"])], place[bytes(r["b"])]) for r in found]).T
        assert common.joined(np.arange(len(fps)), *ends).tolist() == want
    assert len(set(want)) > 3


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**10])
def test_pigeonhole_keys_lose_no_pair(n):
    keys, rng = simhash.pigeonhole(64, 4, n), random.Random(1)
    for _ in range(300):
        flipped = set(rng.sample(range(64), 4))
        assert any(not flipped & set(k.tolist()) for k in keys)


@pytest.mark.parametrize("n", [10**4, 10**6, 10**8])
def test_drawn_keys_lose_few_pairs_of_the_similarity_wanted(n):
    agree = simhash.agreement(0.8)
    keys, rng = simhash.sampled_keys(256, agree, 64, n), np.random.default_rng(n)
    differs = rng.random((4000, 256)) > agree
    met = np.zeros(4000, bool)
    for k in keys:
        met |= ~differs[:, k].any(1)
    assert (met & (differs.sum(1) <= 64)).sum() >= 4000 - 20  # 8 are expected to be lost


def test_fingerprints_of_similar_sets_agree_as_expected():
    rng = np.random.default_rng(4)
    for n in (9, 90, 900):  # a similarity of 8 / 10
        apart = []
        for _ in range(200):
            x = rng.integers(0, 1 << 63, n + n // 9, dtype=np.uint64)
            a, b = (np.frombuffer(simhash.wide(s, 256), np.uint8) for s in (x[:n], x[n // 9 :]))
            apart.append(np.bitwise_count(a ^ b).sum())
        assert np.mean(apart) <= 256 * (1 - simhash.agreement(0.8)) + 2 and np.max(apart) <= 64


# mixing


def reached(sizes, counts, budget):
    sums = {0}
    for s, n in zip(sizes, counts, strict=True):
        sums = {a + s * k for a in sums for k in range(n + 1) if a + s * k <= budget}
    return max(sums)


def test_fit_takes_the_best_sum_there_is():
    rng = random.Random(1)
    for i in range(300):
        sizes = sorted(rng.sample(range(1, 40) if i % 2 else [7, 14, 21, 35, 49, 100, 300], rng.randint(1, 6)))
        counts_ = [rng.randint(1, 4) for _ in sizes]
        total = sum(s * n for s, n in zip(sizes, counts_, strict=True))
        budget = rng.randint(0, total + 3)
        take = mixing.fit(np.array(sizes), np.array(counts_), budget)
        assert all(0 <= t <= n for t, n in zip(take, counts_, strict=True))
        assert int((take * np.array(sizes)).sum()) == reached(sizes, counts_, budget)
    assert mixing.fit(np.array([3, 5]), np.array([0, 0]), 7).sum() == 0


def test_fit_of_large_budgets_misses_little():
    rng = random.Random(2)
    for _ in range(40):
        sizes = np.array(sorted(rng.sample(range(20, 4000), 60)))
        counts_ = np.array([rng.randint(1, 400) for _ in sizes])
        budget = int((sizes * counts_).sum() * rng.uniform(0.05, 0.95))
        take = mixing.fit(sizes, counts_, budget, most=20_000)
        assert (take <= counts_).all() and 0 <= budget - int((take * sizes).sum()) <= 1


def test_mix_keeps_columns_whatever_their_names(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3}", *range(i, i + 7)) for i in range(40)]
    names = ["doc_id", "text", "source", "_size", "mix_source", "_source", "row", "_row", "MIX_HASH", "mix_copies"]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'source') else 'long'}" for n in names))
    found = mixing.mix(docs)
    assert found.columns == [*names[:-1], "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    assert sorted(tuple(r)[:9] for r in found.collect()) == sorted(r[:9] for r in rows)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over


def test_mix_of_every_row(docs, nothing):
    found = mixing.mix(docs)
    rows = found.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(found.columns)
    sizes = {}
    for r in rows:
        assert r["mix_size"] == len((r["text"] or "").encode().split()) and 0 <= r["mix_copies"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["mix_size"]
    target = plain_targets(sizes)
    for r in rows:
        assert r["mix_source_size"] == sizes[r["source"]] and r["mix_target"] == pytest.approx(target[r["source"]])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert mixing.mix(nothing).count() == 0


def test_targets_of_sources_alike(spark):
    rng = random.Random(41)
    for _ in range(12):
        sizes = {f"s{i}": rng.choice([0, 10, 10, 10, 200, 5000]) for i in range(rng.randint(1, 9))} | ({None: 10} if rng.random() < 0.5 else {})
        found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert {r["source"]: r["target"] for r in found} == pytest.approx(want)


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(800)] + [(9000 + i, "one two three", "e") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target"), F.first("mix_source_size").alias("size")).collect()
    assert plain_targets({r["source"]: r["size"] for r in found}) == pytest.approx({r["source"]: r["target"] for r in found})
    for r in found:
        assert abs(r["taken"] - r["target"]) <= 1 and r["target"] <= 3 * r["size"]


# embeddings


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    x[50:80] = x[:30] + 0.05 * rng.standard_normal((30, 8))
    x[80:84] = x[80]
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    rows += [(1, None), (2, []), (4, [0.0] * 8), (5, [1.0, None] + [0.0] * 6), (7, [float("nan")] * 8), (8, [float("inf")] * 8), (10, [1.0, 2.0]), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, embedding array<double>, id string, leaf string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    all_ = np.concatenate((unit, unit[:1], unit[:1]))
    ids = [i * 3 for i in range(300)] + [None, 0]
    near = all_ @ all_.T >= 0.95
    root = brute.linked(list(range(302)), lambda a, b: bool(near[a, b]))
    least = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), int(n) - 1, str(least[r]), i is not None and i == least[r]) for i, n, r in zip(ids, near.sum(1), root, strict=True))
    want = sorted(want + [(str(i), 0, str(i), True) for i in (1, 2, 4, 5, 7, 8, 10)])
    for options in ({}, {"leaf": 64, "trees": 12}):
        got_ = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in forest.near_duplicates(df, **options).collect())
        if not options:
            assert got_ == want
        else:  # trees may miss a link, but find none that is not there
            assert all(g[1] <= w[1] for g, w in zip(got_, want, strict=True)) and sum(g[1] for g in got_) >= 0.9 * sum(w[1] for w in want)
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_a_group_of_a_third_of_all_vectors_keeps_its_links(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 64))
    x[:2000] = x[0] + 0.14 * rng.standard_normal((2000, 64))  # at about 0.98 of each other
    x[2000:2100] = x[0] + 0.28 * rng.standard_normal((100, 64))  # around them, some beyond the threshold
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in forest.near_duplicates(df, leaf=64).collect()}
    links = near.sum(1) - 1
    assert all(found[i]["n_links"] <= links[i] for i in range(6000))
    assert all(found[i]["n_links"] == links[i] for i in range(2000))
    assert sum(r["n_links"] for r in found.values()) >= 0.999 * links.sum()
    root = brute.linked(list(range(2100)), lambda a, b: bool(near[a, b]))
    assert all(found[i]["component_id"] == root[i] for i in range(2000))


def test_vectors_link_with_those_of_their_own_length(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.01 * i]) for i in range(5)] + [(200, [5.0, 0.0]), (300, [2.0]), (301, [3.0]), (302, [-1.0])]
    found = {r["vec_id"]: r for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [found[i]["n_links"] for i in (100, 104, 200)] == [5, 5, 5] and found[200]["component_id"] == 100
    assert [(found[i]["n_links"], found[i]["component_id"]) for i in (300, 301, 302)] == [(1, 300), (1, 300), (0, 302)]


def test_leaves_are_cut_into_blocks_where_the_sample_is_small(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 16))
    x[700:1400] = x[:700] + 0.1 * rng.standard_normal((700, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for sample in (forest.SAMPLE, 16 * 4 * 100):  # the latter allows 3 levels and leaves of some 200
        found = {r["vec_id"]: r["n_links"] for r in forest.near_duplicates(df, leaf=16, sample=sample).collect()}
        assert all(found[i] <= links[i] for i in range(1500)) and sum(found.values()) >= 0.9 * links.sum()


def test_each_node_has_a_direction_of_its_own():
    d = forest.directions(np.arange(1, 9), 100, 5)
    assert d.shape == (8, 100) and set(np.unique(d)) == {-1.0, 1.0} and np.abs(np.corrcoef(d) - np.eye(8)).max() < 0.5


# shards


def test_shards_of_every_row(docs, nothing):
    rows = kdtree.shard(docs, 5).collect()
    assert len(rows) == docs.count()
    assert sorted(r["size"] for r in rows) == sorted(len((r["text"] or "").encode()) + 16 for r in docs.collect())
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert kdtree.shard(nothing, 5).count() == 0


def test_shards_have_near_equal_bytes_though_rows_are_alike(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300), "en", "one") for i in range(2000)] + [(5000 + i, "the same text", None, "one") for i in range(1000)]
    found = kdtree.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 12)
    sizes = [r["b"] for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    mean = sum(sizes) / 12
    assert len(sizes) == 12 and max(abs(b - mean) for b in sizes) < 0.1 * mean


def plain_medians(rows, plan):
    """What lies before each node's bounds, and within, from the rows in order of (value, tie, copy)."""
    for node, dim, found, at, tied, low, high, rest in plan:
        own = [r for r in rows if r["node"] == node]
        key = lambda r, dim=dim, found=found: (r[("d_source", "d_id")[dim - 1]], r["tie"], r["copy"])[: found + 1]
        bounds = [((at, tied)[:found] + (x,)) for x in (low, high)]
        yield node, sum(r["size"] for r in own if key(r) < bounds[0]), [r for r in own if bounds[0] <= key(r) <= bounds[1]], rest


def test_medians_are_found_whatever_the_spread(spark):
    rng = random.Random(5)
    ids = [*range(3000), 10**15, (1 << 62) + 1, (1 << 62) + 2, -(1 << 63), (1 << 63) - 1]
    rows = [{"node": i % 3, "size": rng.randint(16, 900), "tie": rng.randrange(1 << 60), "copy": rng.randrange(1 << 60), "d_source": rng.choice([-1, 7, 7, 7, 1 << 39]), "d_id": x} for i, x in enumerate(ids)]
    rows += [{"node": 1, "size": 40, "tie": 12345, "copy": rng.randrange(1 << 60), "d_source": 7, "d_id": 5} for _ in range(800)]  # rows alike
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "node int, size long, tie long, copy long, d_source long, d_id long")
    total = [sum(r["size"] for r in rows if r["node"] == n) for n in range(3)]
    for dim, name in ((1, "d_source"), (2, "d_id")):
        for share in (0.02, 0.5, 0.9):
            own = [[r[name] for r in rows if r["node"] == n] for n in range(3)]
            plan = [(n, dim, min(own[n]), max(own[n]), len(own[n]), int(total[n] * share)) for n in range(3)]
            for node, before, inside, rest in plain_medians(rows, kdtree.medians(df, plan, ("d_source", "d_id"))):
                assert before + rest == plan[node][5] and 0 <= rest < sum(r["size"] for r in inside)
                assert len(inside) <= 2 * kdtree.NEAR


def test_a_split_parts_ids_but_for_a_few_around_the_median(spark):
    rng = random.Random(6)
    ids = [*range(4000), 10**15, (1 << 53) + 1, (1 << 53) + 2]
    df = spark.createDataFrame([(i, rng.randint(16, 400), rng.randrange(1 << 60), rng.randrange(1 << 60)) for i in ids], "d_id long, size long, tie long, copy long")
    rows = kdtree.assign(df, 4, ("d_id",)).collect()
    shards = [sorted(r["d_id"] for r in rows if r["shard"] == s) for s in range(4)]
    for left, right in zip(shards, shards[1:], strict=False):
        apart = [x for x in left if x > right[0]] + [x for x in right if x < left[-1]]
        assert len(apart) <= 2 * 2 * kdtree.NEAR
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 100


def test_shards_stay_equal_beside_a_source_of_a_third_and_odd_ids(spark):
    rng = random.Random(7)
    texts = [(i if i % 50 else None, "y" * rng.randint(0, 500), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 20}") for i in range(3000)] + [((1 << 62) + i, "end", "en", "s1") for i in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    rows = kdtree.shard(df, 7).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(7)]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 7
    assert sorted((str(r["doc_id"]), r["text_crc32"]) for r in rows) == sorted((str(t[0]), zlib.crc32(t[1].encode())) for t in texts)


@pytest.mark.parametrize("copies", [100, 1500])
def test_shards_stay_equal_though_many_rows_are_copies_of_one(spark, copies):
    rng = random.Random(copies)
    rows = [(i, "x" * rng.randint(0, 120), "en", f"s{i % 5}") for i in range(3000)] + [(77, "z" * 60, "de", "s1")] * copies
    found = kdtree.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)).collect()
    sizes, slots = [0] * 40, [[] for _ in range(40)]
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(sizes) - min(sizes) <= 136 and len(found) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_mix_takes_as_many_of_rows_alike_as_it_needs(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "a") for i in range(800)] + [(5, " ".join(["v"] * 40), "b")] * 1000 + [(6, " ".join(["u"] * 7), None)] * 900 + [(7, "u u", None)] * 3
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, copy string, `last` int").repartition(6)
    mixed = mixing.mix(docs)
    assert mixed.columns[:5] == docs.columns
    found = mixed.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in found) == len(rows)
    for r in found:
        assert abs(r["taken"] - r["target"]) <= {"a": 1, "b": 40, None: 2}[r["source"]], r
    alike = lambda df: sorted(map(str, df.select("doc_id", "text", "mix_copies").collect()))
    assert alike(mixed) == alike(mixing.mix(docs.repartition(3)))


def test_nothing_in_nothing_out(nothing):
    import public_tokenizers

    assert flac.read_features(flac.write_media(nothing)).count() == 0
    assert substrings.dedup(nothing).count() == 0
    assert bpe.round_trip(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert counts.count_tokens(nothing, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
