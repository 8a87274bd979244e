import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, groups=25, per=8, hot=0):
    r = random.Random(seed)
    words = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "m", "x", "ll")]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice([40, 150, 600]))]
        for _ in range(per + (hot if g == 0 else 0)):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, len(t) // 60, len(t) // 12])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append(" ".join(t))
    for _ in range(90):
        own = [r.choice(words) for _ in range(150)]
        rows.append(" ".join(own[:70] + passage + own[70:]))
    r.shuffle(rows)
    return rows


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def groups(spark, texts, **k):
    """The least number among the texts of each one's group."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    distinct = copies.distinct_texts(docs).cache()
    least = {r["id"]: r["least"] for r in distinct.select("id", "least").collect()}
    root = {r["node"]: r["root"] for r in copies.similar_roots(docs, distinct, **k).collect()}
    first = {}
    for i, text in least.items():
        first[root.get(i, i)] = min(first.get(root.get(i, i), text), text)
    own = {r["doc_id"]: r["id"] for r in copies.sketched(docs).select("doc_id", "id").collect()}
    distinct.unpersist()
    return [first[root.get(own[i], own[i])] for i in range(len(texts))]


def brute_groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = []
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if similarity(sets[a], sets[b]) >= 0.8:
                near.append((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(texts))], near


@pytest.mark.parametrize("k", [{}, {"cell": 10}, {"cell": 3, "cell_shingles": 500}])
def test_groups_against_brute_force(spark, k):
    texts = corpus(hot=60)
    want, near = brute_groups(texts)
    got = groups(spark, texts, **k)
    for g in set(got):  # nothing is joined that brute force does not join
        assert len({want[i] for i in range(len(texts)) if got[i] == g}) == 1
    assert len(near) > 100 and sum(got[a] == got[b] for a, b in near) >= 0.99 * len(near)


def fresh(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


@pytest.mark.parametrize("words", [60, 300, 1500])
def test_pairs_at_the_threshold(spark, words):
    """Pairs whose similarity is 0.8 or a little over, beside pairs a little under it."""
    r, texts = random.Random(words), []
    shingles_ = words - 4
    most = shingles_ // 9  # (s - k) / (s + k) >= 0.8
    for k in range(300):
        base = fresh(r, words)
        changed = most if k % 2 == 0 else most + 1
        texts += [" ".join(base), " ".join(base[: words - changed] + fresh(r, changed))]
    sims = [similarity(shingles(texts[i]), shingles(texts[i + 1])) for i in range(0, 600, 2)]
    assert all((s >= 0.8) == (k % 2 == 0) for k, s in enumerate(sims)) and max(sims) < 0.82
    got = groups(spark, texts)
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(0, 300, 2)) >= 0.99 * 150
    assert not any(got[2 * k] == got[2 * k + 1] for k in range(1, 300, 2))


@pytest.mark.parametrize("k", [{}, {"cell": 40}])
def test_family_of_a_thousand(spark, k):
    """1000 texts share a template (similarity 0.74); 500 pairs of them are near copies."""
    r = random.Random(5)
    template, texts = fresh(r, 200), []
    for _ in range(500):
        own = fresh(r, 11)
        texts += [" ".join(template + own + fresh(r, 23)) for _ in range(2)]
    sets = [shingles(t) for t in texts]
    assert all(similarity(sets[i], sets[i + 1]) >= 0.8 for i in range(0, 1000, 2)) and similarity(sets[0], sets[2]) < 0.75
    got = groups(spark, texts, **k)
    assert sum(got[i] == got[i + 1] for i in range(0, 1000, 2)) >= 0.99 * 500
    assert len(set(got)) >= 500


def test_group_of_a_thousand(spark):
    """1000 copies of one text with up to two words changed are one group, and 100 other texts stay apart."""
    r = random.Random(8)
    base, texts = fresh(r, 120), []
    for _ in range(1000):
        t = list(base)
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = fresh(r, 1)[0]
        texts.append(" ".join(t))
    got = groups(spark, texts + [" ".join(fresh(r, 120)) for _ in range(100)], cell=50)
    assert max(got[:1000].count(g) for g in set(got[:1000])) >= 990 and len(set(got[1000:])) == 100


def test_texts_that_contain_another(spark):
    r, texts = random.Random(7), []
    for _ in range(100):
        base = fresh(r, 1600)
        texts += [" ".join(base), " ".join(base + fresh(r, 390))]
    assert 0.80 <= similarity(shingles(texts[0]), shingles(texts[1])) < 0.81
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = {r["doc_id"] for r in copies.keep_one(docs).select("doc_id").collect()}
    assert sum(2 * k in kept and 2 * k + 1 not in kept for k in range(100)) >= 98


def test_block_product_against_single_pairs():
    """Many pairs go through the product of membership rows, few through single comparisons; both give the same groups."""
    r = random.Random(3)
    base = fresh(r, 60)
    texts = [" ".join(base[: 60 - k % 12] + fresh(r, k % 12)) for k in range(80)]
    hashes = [copies._shingles(t) for t in texts]
    sets = [np.unique((h >> np.uint64(32)).astype("<u4")) for h in hashes]
    prints, every = np.array([copies._print(h) for h in hashes]), np.arange(80)
    product = copies.block_links(list(range(80)), every, every, every, prints, sets, 0.8)
    single = []
    for a in range(80):
        single += copies.block_links([a, *range(a + 1, 80)], np.arange(80 - a), np.array([0]), np.arange(1, 80 - a), prints[a:], sets[a:], 0.8)

    def closure(links):
        root = list(range(80))
        for _ in range(80):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    want, _ = brute_groups(texts)
    assert closure(product) == closure(single) == want


def test_chains_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, (40, copies.LANES), dtype=np.uint64)
    y = x.copy()
    for i in range(40):
        for b in rng.choice(256, 44 + i, replace=False):
            y[i, b // 64] ^= np.uint64(1 << int(b % 64))
    apart = np.array([np.bitwise_count(a ^ b).sum() for a, b in zip(x, y)])
    got = np.diag(copies.chains(x, y))
    assert (got == (apart <= copies.BUDGET)).all()  # the ring's chains never lose a pair within the budget
    rows = [(*map(int, a.view(np.int64)), *map(int, b.view(np.int64))) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} long" for i in range(8)))
    chained = [r[0] for r in df.select(copies.in_chain([F.col(f"c{i}") for i in range(4)], [F.col(f"c{i}") for i in range(4, 8)])).collect()]
    assert all(c for c, d in zip(chained, apart) if d <= copies.BUDGET) and not all(chained)


def test_keep_one(spark):
    texts = corpus(3, 12, 5)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "  \n", "en", "s", 3), (903, "short", "en", "s", 5), (904, "Short", "en", "s", 5), (905, "w " * 30000, "en", "s", 1)]
    rows += [(None, texts[0], "en", "s", 1), (None, "other", "en", "s", 1), (7, texts[7], "en", "s", 1), (907, texts[7], "en", "s", 1), (950, "one two three four five six", "a", "s", 1), (950, "quite another text here", "a", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("sketch", F.lit("clash")).withColumn("hashes", F.lit(1)).withColumn("_id", F.lit(1))
    docs = docs.drop("_id")
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    ids = [r["doc_id"] for r in out]
    assert ids.count(None) == 2 and ids.count(950) == 2 and ids.count(7) <= 1 and 907 not in ids
    assert 900 in ids and 901 not in ids and 902 not in ids and 903 in ids and 904 not in ids and 905 in ids
    sets = {r["doc_id"]: shingles(r["text"]) for r in out if r["doc_id"] is not None and r["doc_id"] < 900}
    want, _ = brute_groups(texts)
    assert len(set(want) ^ set(sets)) <= 2
    assert copies.keep_one(docs.limit(0)).count() == 0


def test_rows_without_id_are_read_once(spark):
    """Many rows without a doc_id, and many with one, in pairs of near copies: as many sets as texts, and one of each pair stays."""
    base = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(60)]
    rows = [(None if i % 2 else 5, t + end) for i, t in enumerate(base) for end in ("", " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = copies.distinct_texts(docs)
    sets = copies.shingle_sets(docs, texts, texts.select("id"))
    assert sets.count() == 120
    assert copies.keep_one(docs).count() >= 60
