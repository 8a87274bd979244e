import json
import random
import uuid
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from gritstone.functions import answers, names
from gritstone.operators import code, graphs, indicators, state, triage
from gritstone.sources import decoded, provider, store


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.sort("i").select(column(F.col("x"))).collect()]


def test_sanitize(spark):
    got = values(spark, names.sanitize_name, ["  my func ", "`a`/b", "x#y", "9lives", "__a--b__", "", "///", "é", "a" * 80])
    assert got == ["my_func", "a", "x", "_9lives", "a_b", "unknown_func", "unknown_func", "unknown_func", "a" * 64]
    assert values(spark, lambda c: names.sanitize_name(c, "ai-"), ["run"]) == ["airun"]


def test_default_names(spark):
    got = values(spark, names.is_default_name, ["sub_401000", "SUB_1", "j_memcpy", "_12ab", "?sub_1", "wrap_sub_2", "func_parser", "main", "decrypt", "", None, "_abc"])
    assert got == [True, True, True, True, True, True, True, False, False, True, True, False]


def test_masks_clips_addresses(spark):
    assert values(spark, names.mask_key, ["abcdefghijkl", "short", "", None]) == ["abcdef...ijkl", "***", "***", "***"]
    assert values(spark, lambda c: names.clip(c, 5), ["abcdef", "abc"]) == ["ab...", "abc"]
    assert values(spark, names.parse_address, ["0x1F", "31", " 7 ", "x", "", "0x"]) == [31, 31, 7, None, None, None]
    assert values(spark, names.escape_html, ["<a & \"b\">"]) == ["&lt;a &amp; &quot;b&quot;&gt;"]


def ror13(s):
    h = 0
    for c in s + "\0":
        h = ((h >> 13 | h << 19) + ord(c)) & 0xFFFFFFFF
    return h


def test_hashes(spark):
    words = ["LoadLibraryA", "GetProcAddress", "", "x"]
    assert values(spark, names.hash_ror13, words) == [ror13(w) for w in words]
    assert values(spark, names.hash_djb2, ["a"]) == [5381 * 33 + 97]
    assert values(spark, names.hash_fnv1a, ["a"]) == [0xE40C292C]
    table = {r["value"]: r["api"] for r in code.hashed_names(spark).collect()}
    assert table[ror13("LoadLibraryA")] == "LoadLibraryA"


def test_errors_and_budgets(spark):
    got = values(spark, names.classify_error, ["Quota exceeded", "HTTP 429", "401 Unauthorized", "no such model", "blocked by safety", "timed out", "odd", None])
    assert got == ["quota_exhausted", "rate_limited", "auth_error", "model_not_found", "safety_block", "network_timeout", "unknown_error", "unknown_error"]
    assert names.budget_chars("gpt-4o") == 320_000 and names.budget_chars("other") == 32_000
    waits = spark.createDataFrame([(i,) for i in range(1, 8)], "n int").sort("n").select(names.backoff_seconds(F.col("n"))).collect()
    assert [r[0] for r in waits] == [5, 10, 20, 40, 80, 120, 120]


def test_cache_key_keeps_fields_apart(spark):
    none = F.array().cast("array<string>")
    key = lambda name, text: names.cache_key(F.lit(1), F.lit(name), F.lit(text), none, none, none, none, none, F.lit("m"), F.lit("p"))
    a, b, c = spark.range(1).select(key("ab", "c"), key("a", "bc"), key("ab", "c")).first()
    assert a == c != b


def test_struct_and_prototype(spark):
    fields = [(8, "size of it", "DWORD", "bytes"), (0, None, None, "")]
    df = spark.createDataFrame([("my struct", 0.8, fields)], "name string, c double, f array<struct<offset:int,name:string,type:string,purpose:string>>")
    text = df.select(names.struct_text(F.col("name"), F.col("c"), F.col("f"))).first()[0].split("\n")
    assert text[1] == "typedef struct _my_struct {" and text[2] == "    DWORD      field_0;  // +0x00" and text[3] == "    DWORD      size_of_it;  // +0x08 bytes" and text[4] == "} my_struct;"
    protos = ["int run(void)", "int run(void);;", "int runs(void)", "run", "typedef int run(void)", "int run(\nvoid)", None]
    got = values(spark, lambda c: names.check_prototype(c, F.lit("run")), protos)
    assert got == ["int run(void);", "int run(void);", "", "", "", "", ""]


CORPUS = """http://evil.example.com/a.exe 10.1.2.3 127.0.0.1 HKLM\\Software\\Run\\x C:\\Windows\\a.dll Mozilla/5.0 (Windows NT 10.0) x
me@site.org %APPDATA% \\\\srv\\share\\f Global\\Mutex_1 1.2.3.com fe80::1:2:3:4:5:6:7 QUFBQkJCQ0NDREREZWVlZmZmR0dHSEhISUlJSkpKS0tLTExM """


def test_indicators(spark):
    df = spark.createDataFrame([(CORPUS,), (None,), ("",)], "text string")
    found = {}
    for r in indicators.extract(df).collect():
        found.setdefault(r["type"], set()).add(r["value"])
    assert found["ipv4"] == {"10.1.2.3"} and found["email"] == {"me@site.org"} and "http://evil.example.com/a.exe" in found["url"]
    assert found["mutex"] == {"Global\\Mutex_1"} and found["env_var"] == {"%APPDATA%"} and found["unc_path"] == {"\\\\srv\\share\\f"}
    assert found["registry"] == {"HKLM\\Software\\Run\\x"} and len(found["base64"]) == 1 and any("a.dll" in v for v in found["win_path"])
    assert "evil.example.com" in found["domain"] and not any(v.startswith("1.2.") for v in found["domain"]) and found["user_agent"] and found["pe_artifact"] and found["ipv6"]
    merged = indicators.merge_sources((df, "text", "b"), (df, "text", "a"), types=("ipv4",)).collect()
    assert [(r["value"], r["source"], r["sources"]) for r in merged] == [("10.1.2.3", "a", ["a", "b"])]


def test_report_counts_the_rest(spark):
    many = spark.createDataFrame([("ipv4", f"9.9.9.{i}", "s", ["s"]) for i in range(35)], "type string, value string, source string, sources array<string>")
    lines = [r["line"] for r in indicators.report_lines(many).sort("section", "line_no").collect()]
    assert lines[0] == "[IPV4] (35)" and lines[-1] == "  ... (5 more)" and len(lines) == 32


def test_score(spark):
    rows = [
        ("resolve_wrapper", ["InternetOpenA", "VirtualAlloc", "CreateRemoteThread"], [], ["http://x.com"], [], [], 50),
        ("memcpy", [], [], [], [], [], 3),
        ("f", ["CreateFileW"], [], ["c:\\temp\\a"], ["dec"], ["DISPATCH"], 9),
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "name string, apis array<string>, callees array<string>, strings array<string>, decoded array<string>, pre_tags array<string>, n_insn int")
    got = {r["name"]: (r["score"], r["priority"]) for r in triage.review_score(df).collect()}
    assert got == {"resolve_wrapper": (10, "critical"), "memcpy": (-3, "low"), "f": (6, "high"), None: (0, "low")}


def test_candidates(spark):
    df = spark.createDataFrame([(1, "sub_1", 9, "critical", False, 0), (2, "named", 7, "high", False, 1), (3, "sub_3", 0, "low", True, 2), (4, "sub_4", 2, "low", False, 3), (1, "sub_1", 9, "critical", False, 4)], "ea long, name string, score int, priority string, is_root boolean, ord int")
    assert [r["ea"] for r in triage.top_candidates(df, 2).collect()] == [1, 2]
    assert [r["ea"] for r in triage.top_candidates(df, 9).collect()] == [1, 2, 3]
    assert [r["ea"] for r in triage.top_candidates(df, 9, include_named=False).collect()] == [1, 3]


def test_decisions(spark):
    rows = [(True, "a", "b", 0.9, 2), (False, "", "b", 0.9, 2), (False, "b", "b", 0.9, 2), (False, "a", "b", 0.9, 2), (False, "a", "b", 0.9, 0), (False, "a", "b", 0.5, 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e boolean, n string, o string, c double, v int").sort("i")
    pick = lambda **k: [r[0] for r in df.select(triage.decision(F.col("e"), F.col("n"), F.col("o"), F.col("c"), F.col("v"), **k)).collect()]
    assert pick() == ["failed_queued", "skipped", "skipped", "renamed", "queued", "comment"]
    assert pick(review_mode=True)[3:] == ["queued"] * 3


def test_answers(spark):
    raw = ['```json\n{"name": "do x", "confidence": 0.9, "evidence": ["a", " "], "tags": "net;FILE"}\n```', '{"name": "steal_it", "confidence": 0.95, "evidence": ["one"]}', "nothing", "[1, 2]", "", '{"name": "a", "confidence": "high", "category": "crypto", "evidence": ["e"]}', "text {'name': 'q', 'score': 3} more", '{"a": 1,}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    out = [r["r"] for r in answers.with_parsed(df, "raw").select("i", answers.normalize_answer(F.col("parsed"), F.lit("sub_1")).alias("r")).sort("i").collect()]
    assert (out[0]["name"], out[0]["confidence"], out[0]["evidence"], out[0]["tags"]) == ("do_x", 0.9, ["a"], ["FILE"])
    assert out[1]["confidence"] == 0.55 and out[1]["warnings"][0].startswith("overclaim")
    assert out[2]["error"] and out[3]["error"] and out[4]["error"] and out[2]["warnings"] == ["parse_error"] and out[2]["name"] == "sub_1"
    assert (out[5]["confidence"], out[5]["category"]) == (0.5, "CRYPTO")
    assert (out[6]["name"], out[6]["confidence"]) == ("q", 0.5)
    assert out[7]["name"] == "sub_1" and not out[7]["error"]
    issues = answers.with_parsed(df, "raw").select("i", answers.answer_issues(answers.normalize_answer(F.col("parsed"), F.lit("sub_1"))).alias("x")).sort("i").collect()
    assert issues[0]["x"] == [] and issues[2]["x"] == ["evidence missing or empty"]


def test_analysis(spark):
    raw = json.dumps({"function_name": "Do It", "confidence": 0.9, "category": "network", "priority": "HIGH", "evidence": ["e"], "rename_recommendation": {"apply": True, "name": "New Name", "reason": "r"}})
    weak = json.dumps({"confidence": 0.9, "rename_recommendation": {"apply": True, "name": "x"}})
    df = spark.createDataFrame([(0, raw), (1, weak), (2, "no")], "i int, raw string")
    out = [r["r"] for r in answers.with_parsed(df, "raw").select("i", answers.normalize_analysis(F.col("parsed"), F.lit("sub_1")).alias("r")).sort("i").collect()]
    assert (out[0]["function_name"], out[0]["category"], out[0]["priority"], out[0]["rename_recommendation"]["apply"], out[0]["rename_recommendation"]["name"]) == ("do_it", "NETWORK", "high", True, "new_name")
    assert out[1]["confidence"] == 0.5 and not out[1]["rename_recommendation"]["apply"] and out[2]["function_name"] == "sub_1"


def edges_df(spark, pairs):
    return spark.createDataFrame(pairs, "caller long, callee long")


def levels_of(spark, nodes, pairs):
    df = graphs.bottom_up_levels(spark.createDataFrame([(n,) for n in nodes], "ea long"), edges_df(spark, pairs))
    return {r["ea"]: r["level"] if not r["is_cycle"] else f"c{r['group_id']}" for r in df.collect()}


def test_levels(spark):
    assert levels_of(spark, [1, 2, 3], [(1, 2), (2, 3)]) == {3: 0, 2: 1, 1: 2}
    assert levels_of(spark, [1, 2, 3, 4], [(1, 2), (1, 3), (2, 4), (3, 4)]) == {4: 0, 2: 1, 3: 1, 1: 2}
    assert levels_of(spark, [1, 2, 3, 4], [(1, 2), (2, 1), (3, 1), (4, 4)]) == {1: "c1", 2: "c1", 3: 0, 4: "c4"}
    assert levels_of(spark, [], []) == {}


def tarjan(pairs):
    nodes = {x for p in pairs for x in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        stack, seen = [n], {n}
        while stack:
            for o in out[stack.pop()]:
                if o not in seen:
                    seen.add(o)
                    stack.append(o)
        reach[n] = seen
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_cycles(spark, seed):
    r = random.Random(seed)
    pairs = list({(r.randrange(25), r.randrange(25)) for _ in range(38)})
    want = tarjan(pairs)
    got = {x["ea"]: x["component"] for x in graphs.strong_components(edges_df(spark, pairs)).collect()}
    assert got == want
    cyclic = {x["ea"] for x in graphs.cyclic_nodes(edges_df(spark, pairs)).collect()}
    assert cyclic == {n for n in want if sum(v == want[n] for v in want.values()) > 1 or (n, n) in pairs}
    found = graphs.back_edges(edges_df(spark, pairs).withColumn("program_id", F.lit(1))).collect()
    assert all(x["path"][0] == x["path"][-1] and all((a, b) in pairs for a, b in zip(x["path"], x["path"][1:])) for x in found)
    assert bool(found) == bool(cyclic)


def test_reach(spark):
    e = edges_df(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6), (2, 9)])
    nodes = spark.createDataFrame([(n, n == 9) for n in range(1, 10)], "ea long, is_library boolean")
    roots = spark.createDataFrame([(1,)], "ea long")
    kept, inner, skipped = graphs.reach(e, roots, nodes, 2, 300)
    assert {r["ea"]: r["depth"] for r in kept.collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {(r["caller"], r["callee"]) for r in inner.collect()} == {(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)}
    assert {r["reason"]: r["n"] for r in skipped.collect()} == {"library_or_thunk": 1}
    kept, _, skipped = graphs.reach(e, roots, nodes, 5, 3)
    assert [r["ea"] for r in kept.sort("pos").collect()] == [1, 2, 3]


def test_batches(spark):
    levels = spark.createDataFrame([(i, 0, False, None) for i in range(93)], "ea long, level int, is_cycle boolean, group_id long")
    sizes = [r["count"] for r in graphs.level_batches(levels, 40).groupBy("batch").count().sort("batch").collect()]
    assert sizes == [40, 40, 13]
    none = spark.createDataFrame([], "ea long")
    assert graphs.request_estimate(spark.createDataFrame([(i, 0, False, None) for i in range(95)], levels.schema), none, 50).first()["requests"] == 2
    half = spark.createDataFrame([(i,) for i in range(50)], "ea long")
    got = graphs.request_estimate(spark.createDataFrame([(i, 0, False, None) for i in range(100)], levels.schema), half, 50).first()
    assert (got["requests"], got["cached"]) == (1, 50)
    retry = graphs.retry_batches(spark.createDataFrame([(i, i) for i in range(9)], "ea long, ord long"), 8, 2, 2)
    assert [r["count"] for r in retry.groupBy("batch").count().sort("batch").collect()] == [4, 4]
    assert graphs.dynamic_batch("strict_bottom_up") == 40 and graphs.dynamic_batch("proposal_aware_bottom_up") == 50
    items = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, 20, 3, 3, 3])], "ord long, chars long")
    assert [r["batch"] for r in graphs.packed_batches(items, 10, 2).sort("ord").collect()] == [0, 0, 1, 2, 2, 3]


def test_proposals(spark):
    df = spark.createDataFrame([(0.95, 0.5), (0.5, 0.9), (0.9, None)], "c double, m double")
    assert [r[0] for r in df.select(names.proposal_confidence(F.col("c"), F.col("m"))).collect()] == [0.8, 0.5, 0.9]


QUEUE = store.SCHEMAS["queue"]


def entry(ea, name, status="pending", kind="function_rename", deps=(), level=0, ord=0, var=None):
    return (kind, ea, f"sub_{ea}", name, var, f"{name}_v" if var else None, None, 0.9, status, level, [tuple(d) for d in deps], None, ord)


def test_queue(spark):
    rows = [entry(1, "a", ord=1), entry(1, "old", "applied", ord=2), entry(2, "b", deps=[(1, "a")], level=1, ord=3), entry(3, "v", kind="variable_rename", var="x", ord=4)]
    q = spark.createDataFrame(rows, QUEUE)
    new = spark.createDataFrame([entry(1, "a2", ord=9), entry(3, "w", kind="variable_rename", var="y", ord=10)], QUEUE)
    got = {(r["ea"], r["suggested_name"], r["status"]) for r in state.upsert_queue(q, new).collect()}
    assert got == {(1, "a2", "pending"), (1, "old", "applied"), (2, "b", "pending"), (3, "v", "pending"), (3, "w", "pending")}
    chosen = q.filter("ea = 2")
    assert [(r["parent_ea"], r["ea"]) for r in state.missing_dependencies(chosen, q).collect()] == [(2, 1)]
    assert state.apply_plan(chosen, q).count() == 0
    assert [r["ea"] for r in state.apply_plan(chosen, q, "include_dependencies").collect()] == [1, 2]
    assert [r["ea"] for r in state.apply_plan(chosen, q, "selected_only").collect()] == [2]
    done = state.set_status(q, q.filter("ord <= 2"), "rejected")
    assert {(r["ord"], r["status"]) for r in done.collect()} == {(1, "rejected"), (2, "applied"), (3, "pending"), (4, "pending")}
    assert [r["ord"] for r in state.confident(q, 0.85).collect()] == [1, 4, 3]


def test_store_and_stream(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert store.load(spark, root, "queue").count() == 0
    store.save(spark.createDataFrame([entry(1, "a", ord=1)], QUEUE), root, "queue")
    old = store.load(spark, root, "queue")
    store.save(old.unionByName(spark.createDataFrame([entry(2, "b", ord=2)], QUEUE)), root, "queue")
    assert store.load(spark, root, "queue").count() == 2
    from gritstone.streaming.queue import follow

    spark.createDataFrame([entry(1, "a3", ord=7)], QUEUE).write.parquet(f"{root}/incoming")
    follow(spark.readStream.schema(QUEUE).parquet(f"{root}/incoming"), root, f"{root}/ck").awaitTermination()
    assert {r["suggested_name"] for r in store.load(spark, root, "queue").collect()} == {"a3", "b"}
    (tmp_path / "keys.txt").write_text("# comment\n\n  k1 \nk2\n")
    assert [r["key"] for r in store.read_keys(spark, f"{root}/keys.txt").collect()] == ["k1", "k2"]


def test_decoded(spark):
    docs = [
        (0, json.dumps([{"string": "hello world", "address": "0x10", "encoding": "utf16"}, "plain text", "abc", {"s": {"value": "nested"}, "function": 5}])),
        (1, json.dumps({"strings": {"stack_strings": ["from stack", "from stack"], "decoded_strings": [{"decoded_string": "dec one", "va": 7}]}})),
        (2, json.dumps({"results": ["fallback"]})),
        (3, "FLOSS static strings:\n0x20: 'quoted one'\nno address here\n# c\nabc\n"),
    ]
    got = {(r["doc"], r["string"], r["kind"], r["address"]) for r in decoded.parse_any(spark.createDataFrame(docs, "doc int, raw string")).collect()}
    assert got == {
        (0, "hello world", "decoded_strings", 16), (0, "plain text", "decoded_strings", None), (0, "nested", "decoded_strings", 5), (1, "from stack", "stack_strings", None), (1, "dec one", "decoded_strings", 7), (2, "fallback", "decoded_strings", None), (3, "quoted one", "text_output", 32), (3, "no address here", "text_output", None),
    }


def test_ranges(spark):
    f = spark.createDataFrame([(0, 100), (100, 100), (5000, 30000)], "start long, end long")
    p = spark.createDataFrame([(0,), (99,), (100,), (4999,), (5000,), (29999,), (30000,)], "addr long")
    assert sorted((r["addr"], r["start"]) for r in code.containing(p, f, 256).collect()) == [(0, 0), (99, 0), (5000, 5000), (29999, 5000)]


def test_provider(spark):
    slept = []
    ring = provider.KeyRing(["a", "b"], slept.append)
    ring.failed("429 slow")
    ring.failed("rate limit")
    ring.failed("quota")
    assert slept == [5, 10] and ring.key == "b"
    with pytest.raises(provider.ProviderError):
        ring.failed("401")
    with pytest.raises(provider.ProviderError):
        provider.KeyRing(["a"], slept.append).failed("model not found")

    def flaky(prompt, key):
        if "bad" in prompt:
            raise RuntimeError("blocked")
        return json.dumps({"name": f"n_{len(prompt)}"})

    got = {r["id"]: (r["raw"], r["error"]) for r in provider.ask(spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string"), flaky, ("k1", "k2")).collect()}
    assert got[1][0] and got[2] == (None, "safety_block")


def test_no_round_of_a_graph_broadcasts_its_nodes(spark):
    """A broadcast passes through the driver, in every round again, as long as a table is under its limit."""
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "caller long, callee long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "ea long")
    for df in (graphs.edges_within(edges, nodes), graphs.cyclic_nodes(edges)):
        assert "SortMergeJoin" in planned(df) and "BroadcastHashJoin" not in planned(df)
    with graphs.rounds(spark) as keep:
        e = keep(edges)
        df = e.join(e.select(F.col("caller").alias("_c")).distinct(), F.col("callee") == F.col("_c"))
        assert "SortMergeJoin" in planned(df) and "BroadcastHashJoin" not in planned(df) and df.count() == 3


def test_requests_are_dealt_over_the_partitions(spark):
    """One key does not make one task; with `workers` there are no more tasks than that."""

    def told(prompt, key):
        from pyspark import TaskContext

        return f"{TaskContext.get().partitionId()} {key} {len(prompt)}"

    long = spark.range(64).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.sha2(F.concat_ws(" ", "id", i), 256)), "").alias("prompt"))
    got = [r["raw"].split() for r in provider.ask(long, told).collect()]
    assert len({part for part, _, _ in got}) > 1 and len(got) == 64 and {n for _, _, n in got} == {"192000"}
    got = [r["raw"].split() for r in provider.ask(long, told, ("k1", "k2")).collect()]
    assert {key for _, key, _ in got} == {"k1", "k2"}
    got = [r["raw"].split() for r in provider.ask(long, told, ("k1", "k2", "k3"), workers=2).collect()]
    assert len({part for part, _, _ in got}) <= 2 and {key for _, key, _ in got} <= {"k1", "k2"}


def test_more_requests_make_more_tasks(spark):
    """A task's share stays near the advisory size, whatever the number of a shuffle's partitions; equal requests are split as well."""

    def told(prompt, key):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId())

    def shares(n, same):
        long = spark.range(0, n, 1, 8).select(F.lit(7).alias("id") if same else "id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.sha2(F.concat_ws(" ", F.lit(7) if same else "id", i), 256)), "").alias("prompt"))
        return [r["count"] for r in provider.ask(long, told).groupBy("raw").count().collect()]

    given = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        few, many, same = shares(32, False), shares(128, False), shares(128, True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (sum(few), sum(many), sum(same)) == (32, 128, 128)
    assert len(many) > len(few) >= 2 and max(many) <= 32 and max(same) <= 32


def test_keys_are_shared(spark, tmp_path):
    """A key that one task finds dead is tried once in all; more tasks than requests, no requests, and no key left."""
    log = tmp_path / "log"
    log.mkdir()

    def logged(prompt, key):
        (log / f"{key}-{uuid.uuid4().hex}").write_text(prompt)
        if key == "dead":
            raise RuntimeError("401 invalid api key")
        if "blocked" in prompt:
            raise RuntimeError("blocked")
        return f"{prompt}!"

    requests = spark.createDataFrame([(i, "blocked" if i == 7 else f"p{i}") for i in range(40)], "id long, prompt string")
    got = {r["id"]: (r["raw"], r["error"]) for r in provider.ask_together(requests, logged, ("dead", "k1", "k2"), period=0).collect()}
    assert got == {i: (None, "safety_block") if i == 7 else (f"p{i}!", None) for i in range(40)}
    tried = [p.name.split("-")[0] for p in log.iterdir()]
    assert tried.count("dead") == 1 and len(tried) == 41
    assert provider.ask_together(requests.limit(1), logged, ("k1", "k2", "k3"), period=0).count() == 1
    assert provider.ask_together(requests.filter("id < 0"), logged, ("k1", "k2"), period=0).count() == 0
    assert {r["error"] for r in provider.ask_together(requests, logged, ("dead",), period=0).collect()} == {"quota_exhausted"}


def test_shared_keys():
    now = [100.0]
    one, two = (provider.SharedKeys(("a", "b"), i, lambda: now[0]) for i in (0, 1))
    assert (one.pick(), two.pick()) == (0, 1)
    assert one.failed(0, "429 slow") == "rate_limited"
    two.hear(one.told())
    assert one.told() == [] and one.pick() == 1
    two.hear([(1, 7)])
    assert two.pick() is None and two.rest() == 5
    now[0] += 5
    assert two.pick() == 0 and two.failed(0, "rate limit") == "rate_limited" and two.news == [(0, 10)]
    two.hear([(0, None), (1, None)])
    assert two.pick() is None and two.rest() is None
    with pytest.raises(ValueError):
        provider.SharedKeys((), 0, lambda: 0.0)


def test_heavy_values(spark):
    """As top_values, also where all values share few cells, with ties, nulls, fewer values than asked for, and none."""
    r = random.Random(5)
    rows = [(f"w{min(int(r.paretovariate(0.7)), 3000)}",) for _ in range(6000)] + [(None,), ("",), ("",)] + [(f"tie{i}",) for i in range(30)] * 50
    values = spark.createDataFrame(rows, "value string").repartition(4)
    for limit, least, width in ((10, 0, 1 << 16), (25, 4, 64), (40, 0, 4), (5000, 0, 512), (3, 99, 16)):
        assert triage.heavy_values(values, limit, least, width=width).collect() == triage.top_values(values, limit, least).collect()
    assert triage.heavy_values(values.limit(0), 5).collect() == []


def test_rollback_and_cache(spark):
    items = spark.createDataFrame([("b1", "2024-01-01", 1, "function_rename", "sub_1", "x"), ("b2", "2024-01-02", 1, "function_rename", "sub_1", "y"), ("b2", "2024-01-02", 2, "function_rename", "", "z"), ("b2", "2024-01-02", 3, "function_rename", "sub_3", "w")], "batch_id string, ts string, ea long, kind string, old_name string, new_name string")
    now = spark.createDataFrame([(1, "y"), (3, "hand_made")], "ea long, name string")
    assert {r["ea"]: r["outcome"] for r in state.rollback_plan(items, now).collect()} == {1: "restore", 2: "skipped", 3: "manual_skipped"}


def test_instruction_passes(spark):
    rows = [(1, 1, "cmp", "imm", None, 0x20000, None), (1, 2, "cmp", "reg", 1, 5, None), (1, 3, "je", "near", None, None, 77), (1, 4, "cmp", "imm", None, 0x30000, None), (1, 5, "mov", "reg", 1, None, 40), (1, 6, "jz", "near", None, None, 88), (1, 7, "push", "imm", None, 1, None), (1, 8, "call", "reg", 1, None, None), (1, 9, "push", "imm", None, 1, None)]
    insn = spark.createDataFrame(rows, "func_ea long, ea long, mnem string, op_type string, reg int, value long, addr long")
    fn = spark.createDataFrame([(1, "my_dispatcher")], "ea long, name string")
    assert [(r["value"], r["target"]) for r in code.compare_jumps(insn, fn).collect()] == [(0x20000, 77)]
    assert [(r["ea"], r["pointer"]) for r in code.last_loads(insn).collect()] == [(8, 40)]
    assert code.push_counts(insn).first()["pushes"] == 1
    assert [r["names"] for r in code.constants(insn).collect()] == [["0x20000", "0x30000"]]


def test_small_state(spark):
    q = spark.createDataFrame([entry(1, "a", "applied", ord=1), entry(1, "b", ord=3, deps=[(16, "x")]), entry(1, "c", ord=2)], QUEUE)
    assert state.pending_item(q, 1).first()["suggested_name"] == "c" and state.pending_item(q, 2).count() == 0
    assert q.filter("ord = 3").select(state.dependency_text(F.col("deps"))).first()[0] == "0x10 -> x"
    blobs = spark.createDataFrame([(1, "notes", "n"), (1, "code", "c"), (2, "notes", "m")], store.SCHEMAS["blobs"])
    assert {r[0] for r in state.saved_functions(blobs).collect()} == {1, 2}
    assert state.drop_blobs(blobs, blobs.filter("kind = 'notes'")).count() == 1
    cache = spark.createDataFrame([("k", None, "o", "asm", "x" * 2048)], "key string, ts timestamp, old_name string, code_type string, result string")
    assert state.cache_stats(cache).first().asDict() == {"entries": 1, "size_kb": 2.0}
    est = spark.createDataFrame([(30,)], "requests long")
    assert graphs.budget_plan(est).first()["exceeded"] and not graphs.budget_plan(est, 40).first()["exceeded"]


def test_pack(spark):
    got = values(spark, lambda c: answers.unpack(c).cast("string"), ['{"a": 1}', "plain", "", None])
    assert got == ['{"a":1}', "plain", None, None]
    assert spark.range(1).select(answers.pack(F.struct("id"))).first()[0] == '{"id":0}'


def small_graph(spark):
    r = random.Random(4)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(75)] + [(100, 101), (101, 102), (102, 100), (103, 100), (7, 7)]
    return spark.createDataFrame(pairs, "caller long, callee long"), spark.createDataFrame([(i,) for i in range(110)], "ea long")


def counted_rounds(monkeypatch):
    """Counts the tables that rounds write."""
    made, real = [], graphs.rounds

    @contextmanager
    def counting(spark):
        with real(spark) as keep:
            yield lambda df: made.append(1) or keep(df)

    monkeypatch.setattr(graphs, "rounds", counting)
    return made


def depths(nodes, pairs):
    """Level or cycle of every node, by recursion over the components of tarjan()."""
    home = {n: n for n in nodes} | tarjan(pairs)
    size = {c: sum(v == c for v in home.values()) for c in home.values()}
    cyclic = {n for n in nodes if size[home[n]] > 1 or (n, n) in pairs}
    level = {}

    def deep(n):
        if n not in level:
            level[n] = max([deep(b) + 1 for a, b in pairs if a == n and b not in cyclic], default=0)
        return level[n]

    return {n: f"c{home[n]}" if n in cyclic else deep(n) for n in nodes}


@pytest.mark.parametrize("growth", [8, 0])
def test_doubling_and_peeling(spark, growth):
    """growth 0 lets no round of doubling pass that makes a pair."""
    e, n = small_graph(spark)
    pairs = {(r[0], r[1]) for r in e.collect()}
    got = graphs.bottom_up_levels(n, e, growth).collect()
    assert {r["ea"]: f"c{r['group_id']}" if r["is_cycle"] else r["level"] for r in got} == depths(range(110), pairs) and len(got) == 110


def test_a_deep_chain(spark, monkeypatch):
    made = counted_rounds(monkeypatch)
    e = spark.range(2000).selectExpr("id AS caller", "id + 1 AS callee")
    got = {r["ea"]: r["level"] for r in graphs.bottom_up_levels(spark.range(2001).withColumnRenamed("id", "ea"), e).collect()}
    assert got == {i: 2000 - i for i in range(2001)} and len(made) < 60


def test_rings_and_chains_between_cycles(spark):
    """A ring of links alone, a chain that closes on one anchor, and a chain between two cycles."""
    ring = [(i, i % 40 + 1) for i in range(1, 41)]
    loop = [(100, 101), (101, 102), (102, 100), (100, 103), (103, 104), (104, 100)]
    bridge = [(104, 200), (200, 201), (201, 202), (202, 300), (300, 301), (301, 300), (300, 302), (302, 300)]
    got = {r["ea"]: r["component"] for r in graphs.strong_components(edges_df(spark, ring + loop + bridge)).collect()}
    assert got == tarjan(ring + loop + bridge)
    assert graphs.strong_components(edges_df(spark, [(1, 1)])).collect() == [(1, 1)] and graphs.strong_components(edges_df(spark, [(1, 2)]).limit(0)).count() == 0


def walked(pairs, members):
    """Back edges of a plain recursive walk of one component."""
    found, path, finished = [], [], set()

    def visit(n):
        path.append(n)
        for m in sorted(b for a, b in pairs if a == n and b in members):
            if m in path:
                found.append((n, m, tuple(path[path.index(m) :] + [m])))
            elif m not in finished:
                visit(m)
        finished.add(path.pop())

    visit(min(members))
    return found


def test_back_edges_of_several_programs(spark):
    r, rows = random.Random(8), []
    for p in (None, "a", "b"):
        rows += [(p, r.randrange(20), r.randrange(20)) for _ in range(34)]
    got = sorted((str(x["program_id"]), x["caller"], x["callee"], tuple(x["path"])) for x in graphs.back_edges(spark.createDataFrame(rows, "program_id string, caller long, callee long")).collect())
    want = []
    for p in (None, "a", "b"):
        pairs = {(x, y) for q, x, y in rows if q == p}
        home = tarjan(pairs)
        for c in set(home.values()):
            want += [(str(p), *f) for f in walked(pairs, {n for n in home if home[n] == c})]
    assert got == sorted(want) and len(want) > 5


def test_order_with_cycles(spark):
    e, n = small_graph(spark)
    pairs = {(r[0], r[1]) for r in e.collect()}
    rows = {r["ea"]: r for r in graphs.callees_first_with_cycles(n, e).collect()}
    assert sorted(r["ord"] for r in rows.values()) == list(range(1, 111))
    assert all(rows[a]["ord"] > rows[b]["ord"] for a, b in pairs if rows[a]["component"] != rows[b]["component"])
    assert {n: rows[n]["component"] for n in tarjan(pairs)} == tarjan(pairs)


def greedy(sizes, slot, most):
    out, batch, total, n = [], 0, 0, 0
    for c in sizes:
        if n and (total + c > slot or 0 < most <= n):
            batch, total, n = batch + 1, 0, 0
        total, n = total + c, n + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("slot, most", [(50, 0), (50, 3), (0, 2), (1000, 0), (100_000, 0)])
def test_packing_over_many_blocks(spark, slot, most):
    """One group with most rows, small ones, one without a name; zero, null and oversize items; batches longer than a block."""
    r, rows = random.Random(slot + most), []
    for g, n in (("hot", 400), ("b", 30), (None, 20), ("one", 1)):
        rows += [(g, i * 3, None if i % 17 == 5 else r.choice([0, 1, 5, 20, 49, 50, 51, 200])) for i in range(n)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x["g"], x["ord"]): x["batch"] for x in graphs.packed_batches(spark.createDataFrame(rows, "g string, ord long, chars long").repartition(9), slot, most, "g").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for g in {x[0] for x in rows}:
        mine = sorted((o, c or 0) for h, o, c in rows if h == g)
        assert [got[g, o] for o, _ in mine] == greedy([c for _, c in mine], slot, most)


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5)
    got = {r["id"]: r["place"] for r in graphs.numbered(df, [F.col("k").desc(), F.col("id")]).collect()}
    assert got == {i: p + 1 for p, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)))}
    assert graphs.numbered(df.limit(0), [F.col("id")]).count() == 0


def test_packing_without_groups(spark):
    items = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, 5, 20, 1, 1, 1, 9])], "ord long, chars long").repartition(3)
    assert [r["batch"] for r in graphs.packed_batches(items, 10, 2).sort("ord").collect()] == [0, 0, 1, 2, 3, 3, 4, 4]


def test_decoded_cache(spark, tmp_path):
    assert decoded.load_cache(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("")
    assert decoded.load_cache(spark, f"{tmp_path}/bad").count() == 0
    rows = [("first text", "decoded_strings", 16, None, "d"), ("second", "stack_strings", 48, 32, None), ("third", "stack_strings", None, None, None)]
    decoded.store_cache(spark.createDataFrame(rows, "string string, kind string, address long, function_ea long, detail string"), f"{tmp_path}/c")
    back = decoded.load_cache(spark, f"{tmp_path}/c").select("string", "kind", "address", "function_ea", "detail").collect()
    assert sorted(map(tuple, back)) == rows


def test_decoded_files(spark, tmp_path):
    """A bad file among others is a row that says why, read as a table and followed as a stream with a restart."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"stack_strings": [{"string": "one text", "va": "0x10", "function": 3, "encoding": "utf8"}], "tight_strings": ["two text", None, "two text"]}), encoding="utf-8-sig")
    (folder / "b.txt").write_text("# c\n0x20: 'three text'\n")
    (folder / "broken.json").write_text('{"stack_strings": ["cut of')
    (folder / "bytes.txt").write_bytes(b"four \xff text\nfive text\n")
    (folder / "empty.txt").write_text(" \n")
    (folder / "long.txt").write_text("x" * 5000)
    (folder / "none.json").write_text('{"other": 1}')
    columns = ["string", "kind", "address", "function_ea", "detail", "problem"]
    lines = lambda df: sorted(((r["doc"].rsplit("/", 1)[1], *[r[c] for c in columns]) for r in df.collect()), key=repr)
    none = [None] * 5
    want = sorted([
        ("a.json", "one text", "stack_strings", 16, 3, "utf8", None), ("a.json", "two text", "tight_strings", None, None, None, None), ("b.txt", "three text", "text_output", 32, None, None, None), ("broken.json", *none, "broken_json"),
        ("bytes.txt", *none, "not_utf8"), ("bytes.txt", "four \ufffd text", "text_output", None, None, None, None), ("bytes.txt", "five text", "text_output", None, None, None, None), ("empty.txt", *none, "empty"), ("long.txt", *none, "too_long"), ("none.json", *none, "no_lists"),
    ], key=repr)
    found = decoded.files_at(spark, str(folder), 4096)
    assert lines(decoded.parse_reported(found)) == want
    assert lines(decoded.parse_reported(decoded.files_at(spark, str(folder), 4096, pathGlobFilter="b*"))) == [w for w in want if w[0][0] == "b"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4096)" in plan and "GreaterThan(length,4096)" in plan
    follow = lambda: decoded.follow_files(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/ck", 4096).awaitTermination()
    follow()
    assert lines(spark.read.parquet(f"{tmp_path}/out")) == want
    (folder / "late.txt").write_text("late text")
    follow()
    assert lines(spark.read.parquet(f"{tmp_path}/out")) == sorted([*want, ("late.txt", "late text", "text_output", None, None, None, None)], key=repr)
    assert lines(decoded.parse_reported(found.filter("length < 0"))) == []


def test_versions_are_numbered(spark, tmp_path):
    one = spark.createDataFrame([(1, "k", "a")], store.SCHEMAS["blobs"])
    store.save(one, str(tmp_path), "blobs")
    store.save(store.load(spark, str(tmp_path), "blobs").withColumn("value", F.lit("b")), str(tmp_path), "blobs")
    assert store.load(spark, str(tmp_path), "blobs").first()["value"] == "b"
    assert sorted(r["number"] for r in spark.read.json(f"{tmp_path}/blobs/_versions_json").collect()) == [1, 2]


def test_ranges_of_any_length(spark):
    """Short, nested, overlapping, empty and very long ranges, and negative addresses."""
    r = random.Random(2)
    ranges = [(i, a, a + r.choice([1, 3, 100, 5000, 70_000])) for i, a in enumerate(r.randrange(-10_000, 200_000) for _ in range(60))]
    ranges += [(100, 5, 5), (101, -(2**61), 2**61), (102, 2**40, 2**41), (103, 9, 2), (104, 0, 2**40)]
    points = [(i, r.randrange(-20_000, 250_000)) for i in range(300)] + [(1000, 2**40), (1001, 2**41 - 1), (1002, 2**41), (1003, -(2**61)), (1004, 5)]
    got = code.containing(spark.createDataFrame(points, "p long, addr long"), spark.createDataFrame(ranges, "r long, start long, end long"), 16)
    assert got.columns == ["p", "addr", "r", "start", "end"]
    assert sorted((x["p"], x["r"]) for x in got.collect()) == sorted((p, k) for p, a in points for k, s, e in ranges if s <= a < e)


LITERALS = {
    "ipv4": ["10.1.2.3"], "ipv6": ["2001:0db8:0000:0000:0000:ff00:0042:8329", "::1"], "domain": ["evil.example.com"], "url": ["http://evil.example.com/a"], "win_path": ["C:\\Windows\\x"], "unc_path": ["\\\\srv\\share\\x"],
    "registry": ["HKLM\\Software\\Run"], "mutex": ["Global\\abc_123"], "user_agent": ["Mozilla/5.0 (Windows NT 10.0; x64)"], "base64": ["QWxhZGRpbjpvcGVuIHNlc2FtZVF3ZXJ0eTEyMzQ1Njc4OTA="], "pe_artifact": ["dropper.exe", "a_b.DLL"], "env_var": ["%APPDATA%", "%temp"], "email": ["a.b@c.org"],
}


@pytest.mark.parametrize("kind", sorted(LITERALS))
def test_gate_keeps_every_match(spark, kind):
    """Literals of each type alone, in prose, beside accented letters and at both ends; the gated search finds what the pattern does."""
    texts = [t for v in LITERALS[kind] for t in (v, f"see {v} now", f"é{v}é", f"\n{v}\n{v}", v.upper(), v.lower())] + ["", "plain prose. no match", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = df.select(F.explode(F.regexp_extract_all("text", F.lit(indicators.PATTERNS[kind]), F.lit(0))).alias("value")).select(F.trim("value").alias("value"))
    want = {r[0] for r in plain.filter(indicators.is_indicator(F.lit(kind), F.col("value"))).collect()}
    got = {r["value"] for r in indicators.extract(df, types=(kind,)).collect()}
    assert got == want and any(v in got for v in LITERALS[kind])


def test_score_is_planned_once(spark):
    """Filter, priority and sort key name a column, not the rules again."""
    df = spark.createDataFrame([(1, "sub_1", ["CreateRemoteThread"], ["x"], ["http://a.com"], [], [], 9)], "ea long, name string, apis array<string>, callees array<string>, strings array<string>, decoded array<string>, pre_tags array<string>, n_insn int")
    top = triage.top_candidates(triage.review_score(df).withColumns({"is_root": F.lit(False), "ord": F.col("ea")}), 80, 1)
    assert top.count() == 1
    assert top._jdf.queryExecution().optimizedPlan().toString().count("https?") == 1


def test_keyed_changes_rewrite_their_buckets_only(spark, tmp_path):
    root, blobs = str(tmp_path), store.SCHEMAS["blobs"]
    rows = lambda *r: spark.createDataFrame(list(r), blobs)
    store.save(rows(*[(i, "notes", f"v{i}") for i in range(200)], (None, "notes", "n")), root, "blobs")
    assert store.upsert(rows((5, "notes", "new"), (None, "code", "m")), root, "blobs", "func_ea") == 2  # deals the saved table to buckets
    before = store.manifest(spark, root, "blobs")["files"]
    assert len(before) > 40
    store.upsert(rows((5, "notes", "newer"), (1000, "notes", "x")), root, "blobs", "func_ea", gone=rows((7, None, None)))
    after = store.manifest(spark, root, "blobs")["files"]
    assert 1 <= sum(after.get(b) != p for b, p in before.items()) <= 3
    got = {r["func_ea"]: (r["kind"], r["value"]) for r in store.load(spark, root, "blobs").collect()}
    assert got == {i: ("notes", f"v{i}") for i in range(200) if i != 7} | {5: ("notes", "newer"), 1000: ("notes", "x"), None: ("code", "m")}
    assert store.upsert(rows((5, "a", "b")).limit(0), root, "blobs", "func_ea") == 3


def test_no_update_is_lost_to_another_writer(spark, tmp_path):
    """A second writer names a version between the first one's read and its commit; the first merges again."""
    root, blobs = str(tmp_path), store.SCHEMAS["blobs"]
    one, two = (spark.createDataFrame([(7, k, "v")], blobs) for k in ("one", "two"))
    runs = []

    def merge(old, new):
        runs.append(old.count())
        if len(runs) == 1:
            store.fold(two, root, "blobs", "func_ea", lambda a, b: a.unionByName(b))
        return old.unionByName(new)

    assert store.fold(one, root, "blobs", "func_ea", merge) == 2
    assert runs == [0, 1] and {r["kind"] for r in store.load(spark, root, "blobs").collect()} == {"one", "two"}


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root, blobs = str(tmp_path), store.SCHEMAS["blobs"]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.fold(spark.createDataFrame([(i % 2, str(i), "v")], blobs), root, "blobs", "func_ea", lambda a, b: a.unionByName(b)), range(8)))
    assert {r["kind"] for r in store.load(spark, root, "blobs").collect()} == {str(i) for i in range(8)}
    assert store.manifest(spark, root, "blobs")["number"] == 8
