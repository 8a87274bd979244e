import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import vectors


def made(n=500, dims=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    for i in range(0, n, 4):
        x[i] = x[rng.integers(0, 12)] + rng.normal(0, 0.12, dims)
    x[-40:] = x[3]
    return [[float(v) for v in row] for row in x]


def brute(rows):
    ids = [i for i, _ in rows]
    good = []
    for k, (_, v) in enumerate(rows):
        if v is not None and None not in v and len(v) and np.isfinite(np.array(v, np.float32)).all() and np.any(v):
            good.append(k)
    links = {k: set() for k in range(len(rows))}
    for d in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == d]
        x = np.array([rows[k][1] for k in own], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= 0.9)):
            if a != b:
                links[own[a]].add(own[b])
    root = list(range(len(rows)))
    for k in range(len(rows)):
        stack, seen = [k], {k}
        while stack:
            for o in links[stack.pop()]:
                if o not in seen:
                    seen.add(o)
                    stack.append(o)
        root[k] = min((ids[o] for o in seen if ids[o] is not None), default=None)
    return sorted((str(ids[k]), len(links[k]), str(root[k]), ids[k] is not None and ids[k] == root[k]) for k in range(len(rows)))


def odd():
    rows = [(i, v) for i, v in enumerate(made())]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (None, rows[3][1]), (5, rows[5][1])]
    return rows


def answers(df, **k):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in vectors.vector_classes(df, **k).collect())


@pytest.mark.parametrize("k", [{}, {"region": 30}, {"part": 100}, {"region": 40, "part": 50}])
def test_against_brute_force(spark, k):
    """One region; many, split twice; crowded ones dealt to parts."""
    df = spark.createDataFrame(odd(), "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    assert answers(df, recall=0.999, **k) == brute(odd())


def test_default_recall(spark):
    df = spark.createDataFrame(odd(), "vec_id long, embedding array<float>")
    got, want = {r[0]: r for r in answers(df, region=60)}, brute(odd())
    assert sum(got[w[0]][1] for w in want if w[0] not in ("5", "None")) >= 0.95 * sum(w[1] for w in want if w[0] not in ("5", "None"))
    assert all(got[w[0]][1] <= w[1] for w in want)


def test_plain_products_when_the_audit_fails(spark, monkeypatch):
    """Searches that find nothing fail the audit at every overlap; the exact way follows and is whole."""
    asked = []
    whole = vectors.found_links

    def blind(distinct, n, cosine, overlap, margin, region, part, exact):
        asked.append((overlap, exact))
        found = whole(distinct, n, cosine, overlap, margin, region, 100, exact)
        return found if exact else found.filter("false")

    monkeypatch.setattr(vectors, "found_links", blind)
    df = spark.createDataFrame(odd(), "vec_id long, embedding array<float>")
    assert answers(df) == brute(odd())
    assert (24, True) in asked and (3, False) in asked


def test_double_components_are_compared_as_doubles(spark):
    """Two vectors that are equal as floats, and huge ones whose squares overflow."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-12]), (3, [1e300, 0.0]), (4, [0.0, 1e-300])]
    got = {r["vec_id"]: r for r in vectors.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i]["n_links"] for i in (1, 2, 3, 4)] == [2, 2, 2, 0] and got[3]["component_id"] == 1


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.vector_classes(none).count() == 0
    assert vectors.vector_classes(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0].asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True, "recall": None}


def test_recall_is_measured_without_links(spark):
    """No vector links with another: small tables are compared whole."""
    rows = [(i, [1.0 if k == i else 0.0 for k in range(40)]) for i in range(40)]
    got = vectors.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert all(r["recall"] == 1.0 and r["n_links"] == 0 and r["kept"] for r in got) and len(got) == 40


def test_the_audit_asks_every_query(spark):
    """Its share is the true one, over all ids divisible by 50, in blocks of any size."""
    rows = [(25 * i, v) for i, v in enumerate(made())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    keyed = vectors.keyed(df)
    same = keyed.groupBy("id", "id2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.collect_set((F.col("vec_id") % 50).cast("int")).alias("rests"), F.first("embedding").alias("embedding")).cache()
    want = {r[0]: r[1] for r in brute(rows)}
    named = keyed.select("id", "vec_id").collect()
    per = {}
    for r in named:
        per.setdefault(r["id"], []).append(str(r["vec_id"]))
    copies = {k: len(v) for k, v in per.items()}
    links = {k: want[v[0]] - (copies[k] - 1) for k, v in per.items()}
    asked = [k for k, v in per.items() if any(int(i) % 50 == 0 for i in v)]
    half = [(k, links[k] // 2) for k in per]
    found = spark.createDataFrame(half, "id long, links long")
    share = sum(links[k] // 2 for k in asked) / sum(links[k] for k in asked)
    assert vectors.audit(same, same.count(), found, 0.9) == pytest.approx(share)
    before = vectors.ASKED, vectors.HELD
    vectors.ASKED, vectors.HELD = 16, 50
    try:
        assert vectors.audit(same, same.count(), found, 0.9) == pytest.approx(share)
    finally:
        vectors.ASKED, vectors.HELD = before


def test_query_on_a_table_with_links(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(made())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vectors.op8_vectors(spark, str(tmp_path)).collect()
    want = brute(rows)
    assert sum(r["n_links"] for r in got) >= 0.95 * sum(w[1] for w in want) > 0 and all(r["recall"] >= 0.95 for r in got)


def test_graph_search_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    x[::3] = x[:500] + rng.normal(0, 0.05, (500, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = vectors.flat_graph(x)
    assert len(graph["flat"]) < 60 * len(x) and len(graph["medoids"]) > 2
    q, v = vectors.range_search(graph, x, x, 0.9)
    true = int((x @ x.T >= 0.9).sum())
    assert len(set(zip(q.tolist(), v.tolist()))) == len(q) >= 0.98 * true and (np.einsum("ij,ij->i", x[q], x[v]) >= 0.9 - 1e-4).all()


def test_a_region_over_its_size_is_split(spark):
    """Every vector has one home, no region keeps over twice the homes aimed at, and visits overlap."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(made())], "vec_id long, embedding array<float>")
    distinct = vectors.keyed(df).dropDuplicates(["id"]).select("id", "embedding")
    rows = vectors.regions(distinct, distinct.count(), 3, 0.08, region=60).collect()
    homes = [r["region"] for r in rows if r["home"]]
    assert len(homes) == distinct.count() and len(set(homes)) > 4 and max(homes.count(k) for k in set(homes)) <= 120 and len(rows) > 2 * len(homes)
