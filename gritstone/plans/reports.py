"""Reports as rows: every line of a page and every record of an export is a row, so a page over all functions of a large program is no task's burden.

A page is (section, ord, html): sorted by section and ord, and written in that order over many files, its lines one after the other are the page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import clip, escape_html, hex_address, is_default_name
from ..operators.indicators import REPORT_ORDER
from ..operators.triage import high_risk
from ..sources.store import write_artifacts

#: Rows of a page's parts that are lists of the first few: open proposals, values of an indicator type, batches.
QUEUE_ROWS, TYPE_ROWS, BATCH_ROWS = 50, 40, 15


def _text(value: Column) -> Column:
    return escape_html(F.coalesce(value.cast("string"), F.lit("")))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), _text(c), F.lit("</td>"))], F.lit("</tr>"))


def _joined(values: Column, most: int, sep: str) -> Column:
    return F.array_join(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, most), sep)


def _section(spark: SparkSession, number: int, title: str, rows: DataFrame, columns: tuple[str, ...], empty: str = "None.") -> DataFrame:
    """rows (ord, html) under a heading, inside a table if there are columns; a line that says so where there are none."""
    opened, closed = ("<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>", "</table>") if columns else ("<div>", "</div>")
    fixed = spark.createDataFrame([(-1, f"<h2>{title}</h2>"), (0, opened), (2**62, closed)], "ord long, html string")
    none = rows.select(F.lit(1).alias("_x")).limit(1)
    blank = spark.createDataFrame([(1, f"<tr><td colspan='{len(columns)}'>{empty}</td></tr>" if columns else f"<p>{empty}</p>")], "ord long, html string")
    every = fixed.unionByName(rows.select((F.col("ord") + 2).alias("ord"), "html")).unionByName(blank.join(none, F.lit(True), "left_anti"))
    return every.select(F.lit(number).alias("section"), "ord", "html")


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """For short lists only: all rows are numbered in one window."""
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _page(spark: SparkSession, title: str, sections: list[DataFrame]) -> DataFrame:
    ends = spark.createDataFrame([(0, 0, f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>'), (2**31 - 1, 0, "</body></html>")], "section int, ord long, html string")
    return reduce(DataFrame.unionByName, sections, ends)


def forensic_page(parts: dict[str, DataFrame], contexts: DataFrame, blobs: DataFrame, iocs: DataFrame, title: str = "Forensic report") -> DataFrame:
    """(section, ord, html): coverage, all functions, those at risk, open proposals, saved notes, indicators, indicators of decoded strings,
    calls, strings, decoded strings, batches.

    parts as forensic_report makes them; contexts (ea, name, n_insn, size, n_callers, pre_tags, hints, comment); blobs (func_ea, kind, value);
    iocs (type, value, sources). Functions go by address, so ord is their address; of long lists the first are shown and the rest is counted.
    """
    spark = contexts.sparkSession
    named = F.when(is_default_name(F.coalesce("name", F.lit(""))), "unnamed").otherwise("renamed")
    functions = contexts.select(F.col("ea").alias("ord"), _row(hex_address(F.col("ea")), F.col("name"), named, F.col("n_insn"), F.col("size"), F.col("n_callers"), _joined(F.col("pre_tags"), 50, " "), F.substring("comment", 1, 100)).alias("html"))
    risky = high_risk(contexts.withColumn("tags", F.col("pre_tags"))).select(F.col("ea").alias("ord"), _row(hex_address(F.col("ea")), F.col("name"), _joined(F.col("tags"), 50, " "), F.substring(_joined(F.col("hints"), 50, ", "), 1, 100)).alias("html"))
    waiting = _numbered(parts["queue"].limit(QUEUE_ROWS), F.size(F.coalesce("deps", F.array().cast("array<struct<ea:bigint,suggested_name:string>>"))) > 0, F.coalesce("dependency_level", F.lit(0)), F.col("ts"), F.col("ord"))
    waiting = waiting.select("ord", _row(F.col("old_name"), F.col("suggested_name"), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0)))).alias("html"))
    kinds = ("ai_summary", "analyst_notes", "readable_c")
    notes = blobs.filter(F.col("kind").isin(*kinds)).groupBy(F.col("func_ea").alias("_f")).agg(*[F.max(F.when(F.col("kind") == k, F.substring("value", 1, 180 if k == "ai_summary" else 220))).alias(k) for k in kinds])
    notes = contexts.join(notes, F.col("ea") == F.col("_f")).select(F.col("ea").alias("ord"), _row(hex_address(F.col("ea")), F.col("name"), *[F.col(k) for k in kinds]).alias("html"))
    top = lambda part: _numbered(parts[part], F.col("n").desc(), F.col("value")).select("ord", _row(F.col("value"), F.col("n")).alias("html"))
    batches = _numbered(parts["history"].sort(F.col("ts").desc(), F.col("batch_id").desc()).limit(BATCH_ROWS), F.col("ts"), F.col("batch_id")).select("ord", _row(F.col("ts"), F.col("batch_id"), F.col("items")).alias("html"))
    cover = parts["coverage"].select(F.lit(1).cast("long").alias("ord"), _row(F.col("n_funcs"), F.col("n_renamed"), F.col("n_unnamed"), F.concat("percent", F.lit("%"))).alias("html"))
    decoded = iocs.filter(F.array_contains("sources", "decoded"))
    return _page(spark, title, [
        _section(spark, 1, "Coverage", cover, ("Functions", "Renamed", "Unnamed", "Coverage")),
        _section(spark, 2, "Functions", functions, ("Address", "Name", "Status", "Instructions", "Bytes", "Callers", "Tags", "Comment")),
        _section(spark, 3, "Functions at risk", risky, ("Address", "Name", "Tags", "Hints"), "None found."),
        _section(spark, 4, "Open proposals", waiting, ("Name", "Proposal", "Confidence"), "The queue is empty."),
        _section(spark, 5, "Notes", notes, ("Address", "Name", "Summary", "Notes", "Readable code"), "No saved notes."),
        _section(spark, 6, "Indicators", _types(iocs), (), "No indicators found."),
        _section(spark, 7, "Indicators of decoded strings", _types(decoded), (), "None found."),
        _section(spark, 8, "Calls", top("top_apis"), ("API", "Functions")),
        _section(spark, 9, "Strings", top("top_strings"), ("String", "Functions")),
        _section(spark, 10, "Decoded strings", top("top_decoded"), ("String", "Count")),
        _section(spark, 11, "Batches", batches, ("Time", "Batch", "Items"), "No history."),
    ])


def _types(iocs: DataFrame) -> DataFrame:
    """(ord, html): a line for each indicator type that has values: how many, the first TYPE_ROWS by value, and how many more."""
    place = F.array_position(F.array(*[F.lit(t) for t in REPORT_ORDER]), F.col("type"))
    nth = F.row_number().over(Window.partitionBy("type").orderBy("value"))
    shown = iocs.withColumn("_n", nth).filter(F.col("_n") <= TYPE_ROWS).groupBy("type").agg(F.sort_array(F.collect_list(F.struct("value", F.array_join("sources", ", ").alias("s")))).alias("v"))
    counts = iocs.filter(place > 0).groupBy("type").agg(F.count("*").alias("n"))
    spans = F.array_join(F.transform("v", lambda x: F.concat(F.lit("<span title='"), _text(x["s"]), F.lit("'>"), _text(x["value"]), F.lit("</span>"))), " ")
    more = F.when(F.col("n") > TYPE_ROWS, F.concat(F.lit(" +"), F.col("n") - TYPE_ROWS, F.lit(" more"))).otherwise("")
    return shown.join(counts, "type").select(place.cast("long").alias("ord"), F.concat(F.lit("<h3>"), _text(F.upper("type")), F.lit(" ("), F.col("n"), F.lit(")</h3>"), spans, more).alias("html"))


def forensic_export(parts: dict[str, DataFrame], sample: int = 200) -> DataFrame:
    """(part, json): each part of forensic_report as JSON records; of the functions the first `sample` and their number."""
    rows = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("json")) for name, df in parts.items() if name != "nodes"]
    nodes = parts["nodes"].sort("ea").limit(sample)
    count = parts["coverage"].select(F.lit("nodes_count").alias("part"), F.to_json(F.struct(F.col("n_funcs").alias("nodes_count"))).alias("json"))
    return reduce(DataFrame.unionByName, [*rows, count, nodes.select(F.lit("nodes_sample").alias("part"), F.to_json(F.struct(*nodes.columns)).alias("json"))])


def analyzer_parts(run: dict[str, DataFrame], contexts: DataFrame, iocs: DataFrame) -> dict[str, DataFrame]:
    """What is kept of a run of analyze_program: summary, call graph, scores, proposals, indicators, and each function's context, analysis and code."""
    own = contexts.join(run["scores"].select("ea"), "ea", "left_semi")
    return {
        "summary": run["summary"],
        "call_graph": run["edges"].select("caller", "callee"),
        "function_scores": run["scores"],
        "review_suggestions": run["suggestions"],
        "iocs": iocs,
        "context": own.drop("code"),
        "analysis": run["results"],
        "code": own.select("ea", F.coalesce("code", F.lit("")).alias("code")),
    }


def analyzer_page(run: dict[str, DataFrame], contexts: DataFrame, roots: DataFrame, cycles: DataFrame, title: str = "Program analysis") -> DataFrame:
    """(section, ord, html) of a run of analyze_program: counts, functions by score, roots and cycles, analyses, proposals.

    roots (ea); cycles (path array of addresses). Functions and analyses go by address.
    """
    spark = contexts.sparkSession
    r = run["results"].select("ea", "r")
    scored = run["scores"].join(r, "ea", "left")
    table = scored.select(F.col("ea").alias("ord"), _row(hex_address(F.col("ea")), F.col("name"), F.col("score"), F.col("priority"), F.col("r.category"), _joined(F.col("reasons"), 4, "; ")).alias("html"))
    told = scored.join(contexts.select("ea", "apis", "strings", "decoded"), "ea").select(
        F.col("ea").alias("ord"),
        F.concat(
            F.lit("<h3>"), _text(hex_address(F.col("ea"))), F.lit(" "), _text(F.col("name")), F.lit("</h3><p>Suggested: "), _text(F.col("r.rename_recommendation.name")), F.lit(" confidence "), F.format_string("%.2f", F.coalesce("r.confidence", F.lit(0.0))),
            F.lit(" priority "), _text(F.col("r.priority")), F.lit(" category "), _text(F.col("r.category")), F.lit("</p><p>"), _text(F.col("r.summary")), F.lit("</p><pre>"), _text(_joined(F.col("r.evidence"), 8, "\n")),
            F.lit("</pre><p>APIs: "), _text(_joined(F.col("apis"), 12, ", ")), F.lit("</p><p>Strings: "), _text(_joined(F.col("strings"), 8, "; ")), F.lit("</p><p>Decoded: "), _text(_joined(F.filter(F.slice("decoded", 1, 8), lambda d: d != ""), 8, "; ")), F.lit("</p>"),
        ).alias("html"),
    )
    counts = run["summary"].select(F.lit(1).cast("long").alias("ord"), _row(F.col("total"), F.col("ai_analyzed"), F.col("static_only"), F.col("high_or_critical"), F.col("suggestions")).alias("html"))
    way = F.array_join(F.transform("path", hex_address), " -> ")
    proposals = run["suggestions"].select(F.col("ea").alias("ord"), _row(hex_address(F.col("ea")), F.col("old_name"), F.col("suggested_name"), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), clip(_joined(F.col("evidence"), 8, "; "), 300)).alias("html"))
    return _page(spark, title, [
        _section(spark, 1, "Counts", counts, ("Functions", "Analyzed", "Static only", "High or critical", "Proposals")),
        _section(spark, 2, "Functions", table, ("Address", "Name", "Score", "Priority", "Category", "Reasons")),
        _section(spark, 3, "Roots", roots.select(F.col("ea").alias("ord"), _row(hex_address(F.col("ea"))).alias("html")), ("Address",)),
        _section(spark, 4, "Cycles", cycles.select(F.element_at("path", 1).alias("ord"), _row(way).alias("html")), ("Path",)),
        _section(spark, 5, "Analyses", told, ()),
        _section(spark, 6, "Proposals", proposals, ("Address", "Name", "Proposal", "Confidence", "Evidence")),
    ])


def write_page(page: DataFrame, path: str) -> None:
    """The page's lines in order, over as many files as the sort makes; read in the order of their names they are the page."""
    line = F.regexp_replace("html", "[\r\n]+", "&#10;")
    page.sort("section", "ord", "html").select(line.alias("value")).write.mode("overwrite").text(path)


def write_report(page: DataFrame, parts: dict[str, DataFrame], root: str) -> None:
    """A page under root/page, and each part as Parquet beside it."""
    write_page(page, f"{root}/page")
    write_artifacts(parts, f"{root}/parts")
