import corpus_pipeline
from gritstone.llm import mixing, secrets, toxicity
from gritstone.llm.common import table

SF = "/root/testdata/sf0.001"


def _shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_by_hand(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, SF).cache()
        assert out.columns == names, name
        before, after = {r["doc_id"] for r in current.collect()}, [r["doc_id"] for r in out.collect()]
        assert set(after) <= before and after
        if name == "toxicity":
            scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, SF, "labels"))).collect()
            assert set(after) == {r["doc_id"] for r in scored if r["_score"] < 0.7}
        if name == "simhash":
            assert len(after) == len(set(after)) < len(before)
            sets = {r["doc_id"]: _shingles(r["text"]) for r in current.collect()}
            near = lambda a, b: len(sets[a] & sets[b]) >= 0.83 * len(sets[a] | sets[b])
            assert not any(near(a, b) for a in after for b in after if a < b)
            assert all(any(len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]) for j in sets if j != i) for i in before - set(after))
        if name == "secrets":
            assert set(after) == before
            assert all(not own for own in secrets.scan([r["text"] for r in out.collect()], secrets.model()))
        if name == "mixing":
            plan = {r["doc_id"]: r for r in mixing.plan_mix(current).collect()}
            want = sorted(i for i, r in plan.items() for _ in range(int(r["taken"] / r["size"] + 0.5) if r["size"] else 1))
            assert sorted(after) == want
        current = out
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in current.collect())
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_odd_tables_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null and empty texts, clashing columns, and an empty table."""
    docs = table(spark, SF, "documents").limit(60)
    odd = [(None, f"a text without an id that says {'this and that ' * 9} number {i}", "en", "web", 9) for i in range(30)]
    odd += [(7, f"one id for many texts and they say {' '.join(f'w{i}{k}' for k in range(20))}", None, None, 9) for i in range(12)]
    odd += [(8, None, "en", "web", 0), (9, "", "en", "web", 0), (None, None, None, None, None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    current = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = current.count()
        current = stage(spark, current, SF).cache()
        assert current.columns == docs.columns and 0 < current.count() <= 2 * before, name
    last = corpus_pipeline.STAGES[-1][1](spark, current, SF)
    assert last.count() == current.count()
    assert current.filter("doc_id = 7 AND text LIKE 'one id%'").select("text").distinct().count() > 3
    assert current.filter("text = '' OR text IS NULL").count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
