import json

import pytest
from pyspark.sql import functions as F

from gritstone import settings
from gritstone.operators import contexts
from gritstone.plans import queries, runs, tables
from gritstone.plans import drivers
from gritstone.sources import provider, store

FIELDS = "ea long, name string, callees array<string>, callers array<string>, strings array<string>, decoded array<string>, apis array<string>, constants array<string>, pre_tags array<string>, hints array<string>, n_insn int, code string"


def frame(spark, n=5):
    rows = [(i, f"sub_{i}", [], [], [f"s{i}"], [], ["VirtualAlloc", "connect"] if i % 2 else [], [], [], [], 20, "code") for i in range(n)]
    return spark.createDataFrame(rows, FIELDS)


def edges(spark):
    return spark.createDataFrame([(0, 1), (1, 2), (0, 3), (3, 4), (4, 3)], "caller long, callee long")


def sure(prompt, key):
    return json.dumps({"name": "n_" + prompt.split("\n")[0].strip("- "), "confidence": 0.9, "evidence": ["e"], "summary": "does it", "rename_recommendation": {"apply": True, "name": "n_new"}})


def test_settings():
    s = settings.from_json(json.dumps({"api_key": "k", "rename_order": "nonsense", "batch_size": 7, "gone": 1}))
    assert s.api_keys == ("k",) and s.rename_order == "best_effort_bottom_up" and s.batch_size == 7
    assert settings.from_json(settings.to_json(s)) == s
    assert settings.budget_mode("QUALITY_STRICT ") == "quality_strict" and settings.rename_order(None) == "best_effort_bottom_up"
    assert settings.request_size(s, "strict_bottom_up") == 40


@pytest.mark.parametrize("order", settings.ORDERS)
def test_rename_runs(spark, order):
    got = runs.rename_program(frame(spark), edges(spark), settings.Settings(rename_order=order, review_mode=False), provider.by_section(sure))
    out = {r["ea"]: r for r in got["outcomes"].collect()}
    assert set(out) == set(range(5)) and all(r["outcome"] == "renamed" for r in out.values())
    if order != "best_effort_bottom_up":
        assert [out[i]["level"] for i in (2, 1, 0)] == [0, 1, 2] and out[3]["level"] == out[4]["level"] == 3
    assert got["paused"].first()["level"] is None
    assert runs.history_items(got["outcomes"], "b", "p", "m").count() == 5


def test_strict_run_pauses(spark):
    got = runs.rename_program(frame(spark), edges(spark), settings.Settings(rename_order="strict_bottom_up"), provider.by_section(sure))
    assert got["paused"].first()["level"] == 0
    assert {r["ea"]: r["outcome"] for r in got["outcomes"].collect()} == {2: "queued"}
    assert runs.queue_items(got["outcomes"]).columns == spark.createDataFrame([], store.SCHEMAS["queue"]).columns


def test_children_hold_confidence_down(spark):
    def weak_leaf(prompt, key):
        return json.dumps({"name": "n" + prompt.split("\n")[0].strip("- "), "confidence": 0.7 if "sub_2" in prompt.split("\n")[0] else 0.95, "evidence": ["e"]})

    got = runs.rename_program(frame(spark), edges(spark), settings.Settings(rename_order="proposal_aware_bottom_up", review_mode=False), provider.by_section(weak_leaf))
    out = {r["ea"]: (r["confidence"], r["outcome"]) for r in got["outcomes"].collect()}
    assert out[2] == (0.7, "queued") and out[1] == (0.88, "renamed")


def test_cache_saves_requests(spark):
    cache = spark.createDataFrame([(i, sure(f"--- sub_{i} ---", "")) for i in range(5)], "ea long, raw string")

    def never(prompt, key):
        raise AssertionError("asked")

    got = runs.rename_program(frame(spark), edges(spark), settings.Settings(review_mode=False), never, cache)
    assert {r["outcome"] for r in got["outcomes"].collect()} == {"renamed"}
    assert got["estimate"].first()["requests"] == 0 and got["estimate"].first()["cached"] == 5


def test_analyzer(spark):
    nodes = spark.createDataFrame([(i, False) for i in range(5)], "ea long, is_library boolean")
    roots = spark.createDataFrame([(0,)], "ea long")
    got = runs.analyze_program(frame(spark), edges(spark), roots, nodes, settings.Settings(spa_ai_function_limit=3), sure)
    modes = {r["ea"]: r["mode"] for r in got["results"].collect()}
    assert modes == {0: "ai", 1: "ai", 3: "ai", 2: "static_only", 4: "static_only"}
    summary = got["summary"].first()
    assert (summary["total"], summary["ai_analyzed"], summary["static_only"], summary["suggestions"]) == (5, 3, 2, 3)
    assert {r["suggested_name"] for r in got["suggestions"].collect()} == {"n_new"}


def test_scope(spark):
    f = spark.createDataFrame([(3, True, False), (1, False, True), (2, True, False)], "ea long, is_entry boolean, is_current boolean")
    pick = lambda mode, **k: [r["ea"] for r in contexts.scope(f, mode, **k).sort("ea").collect()]
    assert pick("entry_points") == [2, 3] and pick("current_function") == [1] and pick("limited_program", limit=2) == [1, 2] and pick("x") == []
    assert pick("x", roots=f.filter("ea = 3")) == [3]
    v = spark.createDataFrame([(1, i, f"v{i}", "int", None if i else 8) for i in range(40)], "ea long, ord int, name string, type string, offset int")
    got = contexts.local_variables(v).first()["vars"]
    assert len(got) == 32 and got[0]["offset"] == 8 and got[1]["offset"] == -1


def test_report(spark):
    q = spark.createDataFrame([], store.SCHEMAS["queue"])
    h = spark.createDataFrame([], store.SCHEMAS["history"])
    iocs = spark.createDataFrame([("ipv4", "1.1.1.1", "a", ["a"])], "type string, value string, source string, sources array<string>")
    found = spark.createDataFrame([("dec",)], "string string")
    ctx = frame(spark).withColumns({"decoded": F.array(F.lit("dec")), "pre_tags": F.when(F.col("ea") == 1, F.array(F.lit("CRYPTO"))).otherwise(F.col("pre_tags"))})
    parts = runs.forensic_report(ctx, iocs, found, h, q)
    assert parts["top_decoded"].first().asDict() == {"value": "dec", "n": 6}
    assert [r["ea"] for r in parts["high_risk"].collect()] == [1]
    assert parts["coverage"].first()["percent"] == 0
    assert "IPV4: 1.1.1.1" in runs.program_summary(ctx, iocs, "x").first()["text"]
    assert json.loads(runs.export_function(1, ctx, spark.createDataFrame([], store.SCHEMAS["blobs"]), q, h).first()["json"])["context"][0]["ea"] == 1
    assert store.html_table(ctx.sort("ea"), ["ea", "name"], 2).first()["html"].count("<tr>") == 3


def test_rename_queries_take_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    rows = queries.function_context_frame(spark, sf).select("ea", (size("pre_tags") * 10 + size("apis") + size("strings")).alias("w")).collect()
    nodes = {r["ea"] for r in rows}
    callers = {r["caller"] for r in tables.call_edges(spark, sf).collect() if r["callee"] in nodes and r["caller"] in nodes}
    best = sorted(rows, key=lambda r: (r["ea"] in callers, -r["w"], r["ea"]))[:250]
    got = {r["ea"] for r in queries.QUERIES["rename_best_effort"](spark, sf).collect()}
    assert got == {r["ea"] for r in best} and max(got) >= 60


def test_contexts_and_report_take_every_decoded_string(spark):
    sf = "/root/testdata/sf0.001"
    orders = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey").collect()
    contexts_ = queries.function_context_frame(spark, sf).select("ea", "decoded").collect()
    placed = {r["ea"]: [] for r in contexts_}
    for r in sorted(orders, key=lambda r: r["o_orderkey"]):
        f, at = divmod(r["o_custkey"] * 1000 + r["o_orderkey"] % 900, 1000)
        if f in placed and at < 700:
            placed[f].append(f"decoded {r['o_orderkey']}")
    assert {r["ea"]: set(r["decoded"]) for r in contexts_} == {f: set(v[:30]) for f, v in placed.items()}
    times = {f"decoded {r['o_orderkey']}": 1 for r in orders}
    for v in placed.values():
        for x in v[:30]:
            times[x] += 1
    best = sorted(times.items(), key=lambda x: (-x[1], x[0]))[:40]
    assert sorted((r["value"], r["n"]) for r in queries.QUERIES["forensic_top_decoded"](spark, sf).collect()) == sorted(best)


def counting(tmp_path, one):
    """A provider that notes each request in a file, as tasks run in other processes."""

    def ask(prompt, key):
        with open(tmp_path / "asked", "a") as f:
            f.write(str(prompt.count("\n--- ")) + "\n")
        return provider.by_section(one)(prompt, key)

    return ask


def test_batches_answers_by_name_and_cap(spark, tmp_path):
    s = settings.Settings(review_mode=False, batch_size=2, max_ai_requests_per_run=2)
    got = runs.rename_program(frame(spark), edges(spark), s, counting(tmp_path, sure))
    out = {r["ea"]: r for r in got["outcomes"].collect()}
    assert len(out) == 4 and all(r["name"] == f"n_sub_{ea}" for ea, r in out.items())
    assert {r["ea"] for r in got["unasked"].collect()} | set(out) == set(range(5))
    assert (tmp_path / "asked").read_text().split() == ["2", "2"] and got["requests"].first().asDict() == {"sent": 2, "retried": 0}
    assert {r["ea"] for r in got["answers"].collect()} == set(out)


def test_left_out_functions_are_asked_again(spark, tmp_path):
    def forgetful(prompt, key):
        """Answers only for the first function of a request, and never for sub_4."""
        first = json.loads(provider.by_section(sure)(prompt, key))
        return json.dumps({k: v for k, v in list(first.items())[:1] if k != "sub_4"})

    s = settings.Settings(review_mode=False, batch_size=4, max_functions_per_request=4, min_functions_per_request=1)
    got = runs.rename_program(frame(spark), edges(spark), s, forgetful)
    out = {r["ea"]: r["outcome"] for r in got["outcomes"].collect()}
    counts = got["requests"].first()
    assert set(out) == set(range(5)) and counts["sent"] == 2 and 1 <= counts["retried"] <= 5
    assert out[4] == "failed_queued" and sum(v == "renamed" for v in out.values()) >= 3


def test_drivers(spark):
    s = settings.Settings()
    ctx = frame(spark)
    acc = spark.createDataFrame([(1, 8), (1, 16), (3, 8)], "func_ea long, offset long")
    got = {r["ea"]: r for r in drivers.structures(ctx, acc, s).collect()}
    assert set(got) == {1, 3} and [f["offset"] for f in got[1]["fields"]] == [8, 16]
    assert "typedef struct _sub_1_data {" in got[1]["definition"] and got[3]["note"] == "[AI-Struct] Struct: sub_3_data (fields: field_8@+8)"
    protos = drivers.prototypes(ctx, s)
    assert {(r["ea"], r["new_prototype"]) for r in protos.collect()} == {(i, f"int sub_{i}(void);") for i in range(5)}
    assert protos.columns == spark.createDataFrame([], store.SCHEMAS["queue"]).columns
    local = spark.createDataFrame([(2, 0, "v1", "int", False), (2, 1, "v2", "char", True)], "ea long, ord int, name string, type string, is_arg boolean")
    assert [(r["old_var"], r["new_var"], r["confidence"]) for r in drivers.variables(ctx, local, s).sort("old_var").collect()] == [("v1", "int_0", 0.6), ("v2", "char_1", 0.6)]
    assert drivers.structures(ctx, acc, s, lambda prompt, key: "no json").count() == 0


def test_services():
    sent = []

    def send(url, headers, body, timeout):
        sent.append((url, headers, body))
        if url.endswith("/v1/chat/completions") and ":11434" in url:
            raise OSError("connection refused")
        return {"message": {"content": "own"}} if url.endswith("/api/chat") else {"choices": [{"message": {"content": "chat"}}]} if "contents" not in body else {"candidates": [{"content": {"parts": [{"text": "g"}]}}]}

    make = lambda **k: provider.make_provider(settings.Settings(**k), send)
    assert make(provider="gemini", model="m", api_keys=("k",))("p", "k") == "g" and sent[-1][0].endswith("/models/m:generateContent")
    assert make(provider="groq", api_keys=("k",))("p", "k2") == "chat" and sent[-1][1] == {"Authorization": "Bearer k2"}
    assert make(provider="ollama")("p", "") == "own" and make(provider="lmstudio")("p", "") == "chat"
    assert make(provider="openai_compatible", base_url="http://x/v1/", api_keys=("k",))("p", "k") == "chat" and sent[-1][0] == "http://x/v1/chat/completions"
    for bad in ({"provider": "openai"}, {"provider": "none"}):
        with pytest.raises(provider.ProviderError):
            make(**bad)
    assert make(provider="offline") is provider.offline
