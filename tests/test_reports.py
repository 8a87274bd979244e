import datetime as dt
import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from gritstone.functions import names, prompts
from gritstone.operators import contexts, graphs
from gritstone.plans import drivers, reports, runs
from gritstone.settings import Settings
from gritstone.sources import store

from .test_runs import edges, frame, sure

NOW = dt.datetime(2024, 5, 1)
IOCS = "type string, value string, source string, sources array<string>"


def lines(page, section):
    return [r["html"] for r in page.filter(F.col("section") == section).sort("ord").collect()]


def forensic(spark):
    queue = spark.createDataFrame([(None, 1, "sub_1", "<new>", None, None, None, 0.5, "pending", 0, None, NOW, 1)], store.SCHEMAS["queue"])
    history = spark.createDataFrame([("b1", NOW, "p", "m", 1, "function_rename", "a", "b", 0.9)], store.SCHEMAS["history"])
    iocs = spark.createDataFrame([("ipv4", f"1.1.1.{i:02}", "a", ["a", "decoded"] if i == 7 else ["a"]) for i in range(45)], IOCS)
    ctx = frame(spark, 3).withColumns({"pre_tags": F.when(F.col("ea") == 1, F.array(F.lit("CRYPTO"))).otherwise(F.col("pre_tags")), "size": F.lit(9), "n_callers": F.lit(0), "comment": F.lit(None).cast("string")})
    return runs.forensic_report(ctx, iocs, spark.createDataFrame([("dec",)], "string string"), history, queue), ctx, spark.createDataFrame([(2, "analyst_notes", "n" * 300), (2, "other", "x")], store.SCHEMAS["blobs"]), iocs


def test_forensic_page(spark, tmp_path):
    parts, ctx, blobs, iocs = forensic(spark)
    page = graphs.saved(reports.forensic_page(parts, ctx, blobs, iocs))
    assert lines(page, 2)[2] == "<tr><td>0x0</td><td>sub_0</td><td>unnamed</td><td>20</td><td>9</td><td>0</td><td></td><td></td></tr>" and len(lines(page, 2)) == 6
    assert lines(page, 3)[2].startswith("<tr><td>0x1</td>") and "&lt;new&gt;</td><td>0.50" in lines(page, 4)[2]
    assert lines(page, 5)[2].endswith(f"<td></td><td>{'n' * 220}</td><td></td></tr>")
    assert lines(page, 6)[2].startswith("<h3>IPV4 (45)</h3>") and lines(page, 6)[2].endswith(" +5 more") and lines(page, 6)[2].count("<span") == 40
    assert lines(page, 7)[2] == "<h3>IPV4 (1)</h3><span title='a, decoded'>1.1.1.07</span>"
    assert "<td>connect</td><td>1</td>" in "".join(lines(page, 8)) and len(lines(page, 11)) == 4
    reports.write_report(page, parts, f"file://{tmp_path}/r")
    text = "\n".join(f.read_text() for f in sorted(Path(tmp_path / "r/page").glob("part-*.txt")))
    assert text.startswith("<!DOCTYPE") and text.rstrip().endswith("</html>") and text.index("<h2>Coverage") < text.index("<h2>Functions<") < text.index("<h2>Batches")
    assert spark.read.parquet(f"file://{tmp_path}/r/parts/kind=coverage").first()["n_funcs"] == 3


def test_empty_page_and_export(spark):
    parts, ctx, blobs, iocs = forensic(spark)
    bare = {k: v.filter("false") if k != "coverage" else v for k, v in parts.items()}
    page = reports.forensic_page(bare, ctx.filter("false"), blobs.filter("false"), iocs.filter("false"))
    assert "No saved notes." in "".join(lines(page, 5)) and lines(page, 6)[2] == "<p>No indicators found.</p>"
    out = reports.forensic_export(parts, sample=2).collect()
    assert [json.loads(r["json"])["ea"] for r in out if r["part"] == "nodes_sample"] == [0, 1]
    assert [json.loads(r["json"])["nodes_count"] for r in out if r["part"] == "nodes_count"] == [3]
    assert sum(r["part"] == "queue" for r in out) == 1 and not any(r["part"] == "nodes" for r in out)


def test_analyzer_page(spark):
    f = frame(spark)
    roots = f.filter("ea = 0").select("ea")
    run = runs.analyze_program(f, edges(spark), roots, f.select("ea", F.lit(False).alias("is_library")), Settings(), sure)
    page = reports.analyzer_page(run, f, roots, spark.createDataFrame([([3, 4, 3],)], "path array<long>"))
    assert len(lines(page, 2)) == 8 and lines(page, 4)[2] == "<tr><td>0x3 -&gt; 0x4 -&gt; 0x3</td></tr>"
    assert all(x.startswith("<h3>0x") for x in lines(page, 5)[2:-1]) and "does it" in "".join(lines(page, 5))
    kept = reports.analyzer_parts(run, f, spark.createDataFrame([], IOCS))
    assert kept["code"].count() == kept["context"].count() == kept["analysis"].count() == 5 and "code" not in kept["context"].columns
    assert kept["call_graph"].columns == ["caller", "callee"] and set(kept) == {"summary", "call_graph", "function_scores", "review_suggestions", "iocs", "context", "analysis", "code"}


def test_candidates_own_graph(spark):
    c = spark.createDataFrame([(0, [1, 9, 0, None]), (1, None), (2, [])], "ea long, callee_eas array<long>")
    given = spark.createDataFrame([(1, 2), (2, 0)], "caller long, callee long")
    pairs = lambda df: sorted((r["caller"], r["callee"]) for r in df.collect())
    assert pairs(graphs.candidate_edges(c, given)) == [(0, 1)]
    assert pairs(graphs.candidate_edges(c.filter("ea > 0"), given)) == [(1, 2)]
    assert pairs(graphs.candidate_edges(c.withColumn("callee_eas", F.array(F.lit(None).cast("long"))), given)) == [(1, 2), (2, 0)]
    assert pairs(graphs.candidate_edges(c.select("ea"), given)) == [(1, 2), (2, 0)]


def test_contexts_between_levels(spark, tmp_path):
    f = frame(spark, 3).withColumns({"callees": F.array(F.concat(F.lit("sub_"), F.col("ea") + 1)), "code": F.concat(F.lit("x = sub_"), F.col("ea") + 1, F.lit("(sub_"), F.col("ea") + 1, F.lit("0);"))})
    inner = spark.createDataFrame([(0, 1), (1, 2)], "caller long, callee long")
    new = spark.createDataFrame([(1, "read_file"), (2, "sub_2")], "ea long, idb_name string")
    got = {r["ea"]: r for r in contexts.refreshed(f, inner, new).collect()}
    assert got[0]["code"] == "x = read_file(sub_10);" and got[0]["callees"] == ["read_file"] and got[1]["code"] == "x = sub_2(sub_20);" and got[0]["name"] == "sub_0"
    told = str(tmp_path)

    def spy(prompt, key):
        Path(told, prompt.split("--- ")[-1].split(" ")[0]).write_text(prompt)
        return sure(prompt[prompt.find("--- "):], key)

    s = replace(Settings(), rename_order="strict_bottom_up", review_mode=False, prefix="")
    runs.rename_program(f, inner, s, spy)["outcomes"].collect()
    text = (tmp_path / "sub_0").read_text()
    assert "x = n_sub_1(sub_10);" in text and "Callees: n_sub_1" in text.replace("Calls", "Callees")


def test_range_and_program_requests(spark):
    code = spark.createDataFrame([(1, "CreateFile(x)\ny"), (2, " "), (3, None)], "ea long, code string")
    assert [r.asDict() for r in drivers.ranges(code, Settings()).collect()] == [{"ea": 1, "summary": "2 lines of code", "evidence": ["CreateFile"], "warnings": []}]
    told = spark.createDataFrame([("Binary: x\nIPV4: 1.1.1.1",)], "text string")
    assert drivers.program(told, Settings()).first().asDict() == {"summary": "Binary: x", "capabilities": ["ipv4"], "evidence": [], "risk": "unknown"}
    assert drivers.program(told, Settings(), lambda p, k: '{"summary": null, "evidence": "one"}').first().asDict() == {"summary": "", "capabilities": [], "evidence": ["one"], "risk": ""}


def test_range_requests_hold_whole_texts(spark):
    """A piece's last line and last name count, behind any length and any fence inside it."""
    long = "x = y;\n" * 60_000 + "LastCall(x)"
    code = spark.createDataFrame([(1, long), (2, "a\n```\nAfterFence(b)\n```\nc"), (3, "x" * 4001 + "\nz")], "ea long, code string")
    got = {r["ea"]: (r["summary"], r["evidence"]) for r in drivers.ranges(code, Settings()).collect()}
    assert got == {1: ("60001 lines of code", ["LastCall"]), 2: ("5 lines of code", ["AfterFence"]), 3: ("2 lines of code", [])}
    sent = code.select("ea", prompts.range_request(F.col("code")).alias("p")).filter("ea = 1").first()["p"]
    assert sent == f"{prompts.RANGE}\n```\n{long}\n```"
    assert code.limit(1).select(prompts.range_request(F.lit(None).cast("string")).alias("p")).first()["p"] == f"{prompts.RANGE}\n```\n\n```"


def test_lists_from_answers(spark):
    df = spark.createDataFrame([(1, '["a", " ", 2, null]'), (2, '"one"'), (3, '" "'), (4, "7"), (5, '{"a": 1}'), (6, json.dumps(["x" * 400])), (7, None)], "i int, j string")
    got = {r["i"]: r["v"] for r in df.select("i", names.as_list(F.try_parse_json("j")).alias("v")).collect()}
    assert got == {1: ["a", "2"], 2: ["one"], 3: [], 4: [], 5: [], 6: ["x" * 300], 7: []}
    rows = spark.createDataFrame([(["a", "b", "c"],), ([],), (None,)], "v array<string>").select(names.lines_of(F.col("v"), 2).alias("t")).collect()
    assert [r["t"] for r in rows] == ["a\nb", "-", "-"]
