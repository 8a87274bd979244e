import hashlib
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from gritstone.llm import components as cc
from gritstone.llm import mixing, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(n=240, seed=3):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Eps", "zeta", "éta", "theta"]
    rows = []
    for i in range(n):
        t = " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(r.choice([0, 1, 2, 3, 5, 40, 90])))
        rows.append((i, t, "en", r.choice(["b", "a", "c", "hot", "hot", "hot", None]), len(t)))
    long = " ".join(r.choice(words) for _ in range(20000))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, long, "en", "hot", len(long)), (n + 3, " \n\t", "x", "b", 3)]
    rows += [(n + 4 + j, rows[7][1], "en", "hot", 0) for j in range(30)]
    rows += [rows[5], rows[5], (None, "null id", "en", "a", 7)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_mix_meets_targets(spark):
    rows = odd_rows()
    got = mixing.plan_mix(frame(spark, rows), rows_per_bucket=16).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    budget, level = 1.5 * sum(sizes.values()), 0.0
    lo, hi = 0.0, 1e9
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2 * sizes[s], level * weight[s]) for s in sizes) < budget else (lo, level)
    taken, target = {}, {}
    for g in got:
        assert 0 <= g["taken"] <= 2 * g["size"]
        assert g["source_size"] == sizes[g["source"]]
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
        target[g["source"]] = g["target"]
        assert (g["position"] is None) == (g["taken"] == 0)
        if g["position"] is not None:
            assert 0 <= g["position"] <= 1
    for s in sizes:
        assert target[s] == pytest.approx(min(2 * sizes[s], level * weight[s]), rel=1e-6)
        assert abs(taken[s] - target[s]) < 1


def test_schedule_inverse(spark):
    knots = ((0.0, 1.0), (0.25, 4.0), (0.6, 0.5), (1.0, 0.5))
    us = [i / 50 for i in range(51)]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.demand_time(F.col("u"), knots)).collect()]

    def share(t):
        area = 0.0
        for (a, x), (b, y) in zip(knots, knots[1:]):
            e = min(max(t, a), b)
            area += (e - a) * (x + x + (y - x) * (e - a) / (b - a)) / 2
        return area / mixing.integral(knots)

    assert [share(t) for t in got] == pytest.approx(us, abs=1e-9)
    assert got == sorted(got)


def test_mix_documents(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    docs = frame(spark, rows).withColumn("size", F.lit("clash"))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert mixing.plan_mix(frame(spark, [])).count() == 0
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    assert 0 < out.count() <= 2 * len(rows) + 10


def test_mixing_plans_rows_that_share_an_id(spark):
    """Each row has its own passes, texts without words come once, and equal rows get one plan each."""
    rows = [(1, " ".join(["w"] * (5 + i)), "en", "a" if i % 2 else "b", 1) for i in range(20)] + [(None, "", "en", "a", 0), (3, None, "en", None, 0)] + [(4, "x y z", "en", "a", 3)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan, out = mixing.plan_mix(docs).collect(), mixing.mix_documents(docs).collect()
    want = sorted(((str(r["doc_id"]), r["size"]) for r in plan for _ in range(int(r["taken"] / r["size"] + 0.5) if r["size"] else 1)))
    assert sorted((str(r["doc_id"]), len((r["text"] or "").split())) for r in out) == want
    assert [r["text"] for r in out[:2]] in (["", None], [None, ""])


def brute_capacity(sizes, k):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, at = (lo + hi) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        lo, hi = (lo, mid) if used <= k else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("seed,shards,cells", [(1, 16, 1 << 15), (2, 5, 8), (3, 3, 4), (4, 16, 16), (5, 1, 8)])
def test_smallest_capacity(spark, monkeypatch, seed, shards, cells):
    monkeypatch.setattr(sharding, "ROUND", cells)
    r = random.Random(seed)
    sizes = [r.choice([1, 2, 3, 50, 400, 5000]) for _ in range(r.choice([3, 40, 600]))]
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append((at,))
    capacity, cuts = sharding.smallest_capacity(spark.createDataFrame(ends, "_end long"), at, max(sizes), shards)
    assert capacity == brute_capacity(sizes, shards)
    assert cuts[-1] == at and len(cuts) == shards
    known = {0} | {e[0] for e in ends}
    assert set(cuts) <= known
    assert all(0 <= b - a <= capacity for a, b in zip([0, *cuts], cuts))


def test_shards(spark):
    rows = odd_rows()
    got = sharding.shard_documents(frame(spark, rows).withColumn("slot", F.lit(1)), 4, rows_per_bucket=16).collect()
    assert len(got) == len(rows)
    assert sorted((g["doc_id"] or -1, g["size"], g["text_crc32"]) for g in got) == sorted((r[0] or -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, at = {}, {}
    for g in got:
        slots.setdefault(g["shard"], []).append(g["slot"])
        assert at.setdefault((g["size"], g["text_crc32"]), g["shard"]) == g["shard"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= {0, 1, 2, 3}
    groups = {}
    for r in rows:
        groups[r[1] or ""] = groups.get(r[1] or "", 0) + len((r[1] or "").encode()) + 1
    big = max(1000, len(rows) // 500)
    bits = 0
    while len(rows) >> bits > 16:
        bits += 1
    order = sorted(groups, key=lambda t: (hashlib.md5(t.encode()).digest()[0] >> (8 - bits), hashlib.md5(t.encode()).digest()))
    assert sum(1 for r in rows if r[1] == rows[7][1]) < big
    loads = {}
    for g in got:
        loads[g["shard"]] = loads.get(g["shard"], 0) + g["size"]
    assert max(loads.values()) <= brute_capacity([groups[t] for t in order], 4)
    assert sharding.shard_documents(frame(spark, []), 4).count() == 0


def test_shards_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"text {i}", "en", "s", 1) for i in range(3600)]
    got = sharding.shard_documents(frame(spark, rows), 4, rows_per_bucket=64).collect()
    assert len({g["shard"] for g in got if g["doc_id"] % 3}) == 1
    slots = {}
    for g in got:
        slots.setdefault(g["shard"], []).append(g["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_brute(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(frame(spark, rows).withColumn("fp", F.lit(1))).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in rows:
        prints.setdefault(brute_print(r[1]), []).append(r[0])
    root = brute_components(list(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for p, ids in prints.items():
        for i in ids:
            if i is not None:
                least[root[p]] = min(least.get(root[p], i), i)
    want = sorted((i if i is not None else -1, p, least.get(root[p], -1)) for p, ids in prints.items() for i in ids)
    assert sorted((g["doc_id"] if g["doc_id"] is not None else -1, g["fp"] % 2**64, g["component_id"] if g["component_id"] is not None else -1) for g in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [1000, 20, 3])
def test_links_brute(spark, cell):
    r = random.Random(9)
    centre = [r.getrandbits(64) for _ in range(12)]
    fps = set(centre)
    for c in centre[:4]:
        for _ in range(30):
            x = c
            for _ in range(r.choice([1, 1, 2, 3, 4, 6])):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    want = brute_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    signed = {f: f - 2**64 if f >> 63 else f for f in fps}
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed.values()], "fp long"), cell).collect()
    unsigned = {v: k for k, v in signed.items()}
    assert all((unsigned[e["a"]] ^ unsigned[e["b"]]).bit_count() <= 2 for e in edges)
    linked = {(unsigned[e["a"]], unsigned[e["b"]]) for e in edges}
    got = brute_components(sorted(fps), lambda a, b: (a, b) in linked or (b, a) in linked)
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (5, 5), (200, 200), (300, 7)]
    got = {r["node"]: r["root"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 300: 0, 100: 100, 101: 100, 102: 100}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in found.items() if i is not None and i == c})
    assert ids.count(None) == 1


def test_keep_one_with_repeated_ids(spark):
    rows = [(1, "alpha beta gamma delta", "en", "a", 1), (1, "one two three four five", "en", "a", 1), (1, "one two three four five", "en", "a", 1), (2, "alpha beta gamma delta", "en", "a", 1)]
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "alpha beta gamma delta"), (1, "one two three four five")]
