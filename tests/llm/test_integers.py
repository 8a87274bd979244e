"""Operators on vectors of whole numbers: codes, nearest neighbours and hard negatives, against brute force and SQL."""

import hashlib

import numpy as np
import pytest

from gritstone.llm import integers, negatives, neighbours, quantize, registry

from ..oracle import differences, views

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, score string, v int"


def made(n=400, dims=32, seed=5):
    """Clusters, a third of all rows near one vector, exact copies, and rows that take no part; columns with clashing names."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.4, size=(n, dims)).astype(np.float32)
    x[: n // 3] = x[0] + rng.normal(0, 0.01, (n // 3, dims))
    x[n // 3 : n // 3 + 40] = x[n // 3]
    x[-5:] = 0
    rows = [(7 * i % n, [float(c) for c in v], None if i % 11 == 3 else (1 if i % 3 else i % 7), "s", 1) for i, v in enumerate(x)]
    nothing = [(1000, None, 1), (1020, [], 1), (1040, [float("nan")] * dims, 1), (1060, [1.0, None] * (dims // 2), 1), (1080, [float("-inf")] + [1.0] * (dims - 1), 1), (1100, [3e38] * dims, 2), (1200, [1.0, 2.0], 1), (1300, [2.0, 2.0], 1)]
    again = [(rows[5][0], rows[5][1], 1, "s", 1), (rows[9][0], [0.5] * dims, 2, "s", 1), (None, rows[3][1], 1, "s", 1)]
    return rows + [(*r, "s", 1) for r in nothing] + again


def whole(rows, factor, label=False):
    """What takes part, one row for each id, as the docstrings say."""
    out = {}
    for i, v, k, *_ in rows:
        if i is None or not v or None in v or not np.isfinite(np.array(v, np.float32)).all() or (label and k is None):
            continue
        ints = tuple(int(c) for c in np.clip(np.floor(np.array(v, np.float32).astype(np.float64) * factor), -integers.LARGEST, integers.LARGEST))
        key = (k, ints) if label else ints
        out[i] = min(out.get(i, key), key)
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("k", [{}, {"cell": 40, "block": 64, "group": 8}])
def test_neighbours(spark, k):
    rows = made()
    kept = whole(rows, 64)
    want = []
    for q, a in kept.items():
        if q % 20 == 0:
            best = sorted(((-product(a, b), i) for i, b in kept.items() if i != q and len(a) == len(b)))[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = neighbours.top_scores(spark.createDataFrame(rows, SCHEMA), **k).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_few_rows_are_sent(spark):
    """Far cells are not sent to a group: with two tight clusters, queries of one never see the other."""
    rng = np.random.default_rng(1)
    a, b = np.zeros(16), np.zeros(16)
    a[0] = b[1] = 8
    x = np.concatenate((a + rng.normal(0, 0.01, (300, 16)), b + rng.normal(0, 0.01, (300, 16))))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert neighbours.top_scores(df, cell=300).filter("(query_id < 300) <> (vec_id < 300)").count() == 0
    seen = []
    real = neighbours.solve
    try:
        neighbours.solve = lambda top: seen.append(top) or (lambda left, right: _count(left, right))
        blocks = neighbours._same_length(integers.one_per_id(integers.integer_vectors(df, 64)), 20, 20, 300, 4096, 15).collect()
    finally:
        neighbours.solve = real
    assert seen and sum(r["vec_id"] for r in blocks) == 600  # each row went to one group


def _count(left, right):
    import pyarrow as pa

    return pa.table({n: pa.array([right.num_rows], pa.int64()) for n in ("query_id", "vec_id", "score")})


@pytest.mark.parametrize("k", [{}, {"block": 50, "group": 3}])
def test_negatives(spark, k):
    rows = made()
    kept = whole(rows, 256, label=True)
    want = []
    for q, (own, a) in kept.items():
        if q % 20 == 0:
            met = sorted((-product(a, b), i, label) for i, (label, b) in kept.items() if i != q and len(a) == len(b))
            for s, p, _ in [m for m in met if m[2] == own][:5]:
                inside = [(i, n) for n, i, label in met if label != own and 30 * -s <= 100 * -n <= 90 * -s][:10]
                want += [(q, p, at + 1, i, -s, -n) for at, (i, n) in enumerate(inside)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=20, **k).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(want)


def test_rotation_keeps_products_and_discards_early(spark):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 200, (300, 32)) * 0.7 ** np.arange(32))
    df = spark.createDataFrame([(v.astype(int).tolist(),) for v in x], "v array<long>")
    axes = negatives.principal_axes(df, 32)
    assert np.allclose(axes.T @ axes, np.eye(32), atol=1e-12)
    left = []

    def still(low, high, open_):
        open_ = open_ & (high >= negatives.kth_largest(np.where(open_, low, -np.inf), 5)[:, None])
        left.append(open_.sum())
        return open_

    i, j, score = negatives.survivors(x[:50], x, axes, still)
    true = (x[:50] @ x.T).astype(np.int64)
    assert (score == true[i, j]).all() and left[0] < 0.2 * true.size and left[-1] < 0.02 * true.size
    for r in range(50):
        assert sorted(score[i == r])[-5:] == sorted(true[r])[-5:]


def lloyd(rows, parts=16, entries=64, rounds=2):
    """By plain loops over whole numbers."""
    kept = []
    for i, v, label, *_ in rows:
        if v and None not in v and np.isfinite(np.array(v, np.float32)).all():
            kept.append((i, [int(c) for c in np.clip(np.floor(np.array(v, np.float32).astype(np.float64) * 256), -integers.LARGEST, integers.LARGEST)], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = next(len(r[1]) for r in kept if len(r[1]) % parts == 0)
    kept = [r for r in kept if len(r[1]) == width]
    cut = [[r[1][p * width // parts : (p + 1) * width // parts] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        codes = [[min((far(c[p], e), n) for n, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        for p in range(parts) if step < rounds else ():
            for n in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes) if code[p][1] == n]
                if mine:
                    books[p][n] = [sum(x) // len(mine) for x in zip(*mine)]
    text = ",".join(str(x) for p in books for e in p for x in e)
    return sorted((str(r[0]), bytes(c[1] for c in code).hex(), sum(c[0] for c in code), str(r[2])) for r, code in zip(kept, codes)), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("rounds, entries", [(2, 64), (5, 16), (0, 64)])
def test_codes(spark, rounds, entries):
    rows = made(300)
    found, books = quantize.compressed(spark.createDataFrame(rows, SCHEMA), entries=entries, rounds=rounds)
    want, digest = lloyd(rows, entries=entries, rounds=rounds)
    assert sorted((str(r["vec_id"]), bytes(r["code"]).hex(), r["error"], str(r["label"])) for r in found.collect()) == want
    assert quantize.codebook_digest(books) == digest


def test_bounds_leave_distances_out(spark):
    found, _ = quantize.compressed(spark.createDataFrame(made(2000), SCHEMA))
    assert found.agg({"pairs": "sum"}).first()[0] < 0.5 * 2000 * 16 * 64


def test_few_and_none(spark):
    rows = spark.createDataFrame(made(20)[:3], SCHEMA)
    assert quantize.compressed(rows)[1].shape[1] == 3
    for df in (rows.limit(0), rows.withColumn("embedding", rows["embedding"].cast("array<float>")).filter("embedding IS NULL")):
        assert quantize.compressed(df)[0].count() == neighbours.top_scores(df).count() == negatives.hard_negatives(df).count() == 0


@pytest.mark.parametrize("name", ["op11_quantize", "op12_neighbours", "op13_negatives"])
def test_against_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF), views(SF), registry.ORACLES[name]) == ""
