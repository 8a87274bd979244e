"""Whole runs: the program analyzer, renaming in three orders, and the forensic report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers, names, prompts
from ..operators import code, graphs, indicators, state, triage
from ..operators.contexts import refreshed
from ..settings import Settings, request_size
from ..sources.provider import ask, offline


def analyze_program(contexts: DataFrame, edges: DataFrame, roots: DataFrame, nodes: DataFrame, settings: Settings, provider: Callable[[str, str], str] = offline) -> dict[str, DataFrame]:
    """call graph, scores, results, suggestions and summary of a bounded part of a program.

    contexts as function_contexts makes them, with `code`; edges (caller, callee); nodes (ea, is_library). The best candidates go to
    the model level by level, callees first, with their children's summaries; every other function gets a record from
    its static score alone. Candidates are few by the settings, so a level is one small round.
    """
    s = settings
    library = nodes if not s.spa_include_library_funcs else nodes.withColumn("is_library", F.lit(False))
    kept, inner, skipped = graphs.reach(edges, roots, library, s.spa_max_depth, s.spa_max_functions)
    scored = triage.review_score(contexts.join(kept.select("ea", "depth"), "ea"))
    scored = graphs.saved(scored.withColumns({"is_root": F.col("depth") == 0, "ord": F.col("ea")}))
    chosen = graphs.saved(triage.top_candidates(scored, s.spa_ai_function_limit, s.spa_min_priority_score, s.spa_include_named_funcs))
    among = graphs.edges_within(inner, chosen)
    levels = graphs.saved(graphs.bottom_up_levels(chosen.select("ea"), among))
    order = [r["level"] for r in levels.select("level").distinct().sort(F.col("level").asc_nulls_last()).collect()]  # at most one for each candidate
    results = None
    for level in order:
        now = chosen.join(levels.filter(F.col("level").eqNullSafe(F.lit(level))).select("ea"), "ea")
        if results is not None:
            children = among.join(results.select(F.col("ea").alias("_c"), F.col("r.function_name").alias("name"), F.col("r.summary").alias("summary")), F.col("callee") == F.col("_c"))
            cut = triage.cut_summaries(children.select("caller", F.col("callee").alias("ord"), "name", "summary"), s.spa_child_summary_limit)
            now = now.join(cut.select(F.col("caller").alias("ea"), F.array_join(F.transform("summaries", lambda x: F.concat(x["name"], F.lit(": "), x["summary"])), "\n").alias("below")), "ea", "left")
        else:
            now = now.withColumn("below", F.lit(None).cast("string"))
        prompt = F.concat_ws("\n", code.prompt_text(F.struct("name", "callees", "callers", "strings", "decoded", "apis", "constants", "pre_tags", "hints", F.substring("code", 1, s.spa_prompt_char_budget).alias("code"))), F.concat(F.lit("// Callees:\n"), F.col("below")))
        raw = graphs.saved(ask(now.select(F.col("ea").alias("id"), prompt.alias("prompt")), provider, s.api_keys or ("offline",)))
        parsed = answers.with_parsed(raw.filter("raw IS NOT NULL"), "raw").join(now.select(F.col("ea").alias("id"), "name"), "id")
        done = graphs.saved(parsed.select(F.col("id").alias("ea"), F.col("name").alias("old_name"), answers.normalize_analysis(F.col("parsed"), F.col("name"), s.auto_apply_confidence).alias("r")))
        results = done if results is None else results.union(done)
    static = scored if results is None else scored.join(results.select("ea"), "ea", "left_anti")
    alone = static.select("ea", F.col("name").alias("old_name"), answers.static_only(F.lower(names.sanitize_name(F.coalesce("name", F.lit("")))), F.col("priority"), F.col("reasons")).alias("r"), F.lit("static_only").alias("mode"))
    every = alone if results is None else results.withColumn("mode", F.lit("ai")).unionByName(alone)
    every = graphs.saved(every)
    suggestions = every.filter("r.rename_recommendation.apply AND r.rename_recommendation.name <> ''").select("ea", "old_name", F.col("r.rename_recommendation.name").alias("suggested_name"), "r.confidence", "r.category", "r.evidence")
    marked = scored.join(every.select("ea", (F.col("mode") == "ai").alias("ai_analyzed"), F.col("r.rename_recommendation.apply").alias("apply")), "ea")
    return {"nodes": kept, "edges": inner, "skipped": skipped, "scores": scored.select("ea", "name", "score", "priority", "reasons", "tags"), "results": every, "suggestions": suggestions, "summary": triage.analysis_summary(marked)}


def ask_in_batches(items: DataFrame, batches: DataFrame, settings: Settings, provider: Callable[[str, str], str]) -> DataFrame:
    """(ea, raw) of items (ea, name, ord, prompt) that a batch's answer names; one request for each batch of batches (ea, batch).

    An answer is an object of results under the functions' names; functions of one name in a batch share theirs. The answer to a
    request for one function may be that function's result itself.
    """
    rows = items.join(batches, "ea")
    requests = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("ord", "prompt"))).alias("p"), F.count("*").alias("n"))
    text = F.concat_ws("\n\n", F.lit(prompts.instruction(settings.naming_mode)), F.array_join("p.prompt", "\n\n"))
    raw = ask(requests.select(F.col("batch").alias("id"), text.alias("prompt")), provider, settings.api_keys or ("offline",), workers=settings.request_workers)
    parsed = answers.with_parsed(raw, "raw").filter("parse_error IS NULL").select(F.col("id").cast("int").alias("batch"), "parsed")
    by_name = F.try_variant_get("parsed", "$", "map<string,variant>")
    alone = F.when((F.col("n") == 1) & (F.try_variant_get("parsed", "$.name", "string").isNotNull() | F.try_variant_get("parsed", "$.function_name", "string").isNotNull()), F.col("parsed"))
    found = rows.join(parsed, "batch").join(requests.select("batch", "n"), "batch")
    return found.select("ea", F.to_json(F.coalesce(F.try_element_at(by_name, F.col("name")), alone)).alias("raw")).filter("raw IS NOT NULL")


def rename_program(candidates: DataFrame, edges: DataFrame, settings: Settings, provider: Callable[[str, str], str] = offline, cache: DataFrame | None = None, queue: DataFrame | None = None) -> dict[str, DataFrame]:
    """outcomes (ea, old_name, name, confidence, outcome, level), the request estimate, and the level at which a strict run paused; answers
    (ea, raw) to put in the cache, the number of requests sent, and unasked (ea), which the cap on requests left out.

    candidates (ea, name and prompt fields). best_effort asks for everything at once, callees first; strict finishes a level before
    the next and pauses when something waits for review; proposal-aware hands pending names of callees to their callers and
    holds the callers' confidence down accordingly. Applied names of one step stand in the next one's prompts. Where candidates bring
    callee_eas, those are the graph. cache (ea, raw) answers are used without asking.
    """
    s = settings
    inner = graphs.saved(graphs.candidate_edges(candidates, edges))
    candidates = graphs.saved(graphs.reduced_scope(candidates, inner, s.max_functions_per_rename_run).select(*candidates.columns))
    inner = graphs.saved(graphs.edges_within(inner, candidates))
    levels = graphs.saved(graphs.bottom_up_levels(candidates.select("ea"), inner))
    known = cache.select("ea", "raw") if cache is not None and s.enable_cache else candidates.filter("false").select("ea", F.lit(None).cast("string").alias("raw"))
    size = s.batch_size if s.rename_order == "best_effort_bottom_up" else request_size(s, s.rename_order)
    estimate = graphs.request_estimate(levels if s.rename_order != "best_effort_bottom_up" else levels.withColumns({"level": F.lit(0), "group_id": F.lit(None).cast("long")}), known, size, s.max_ai_requests_per_run, s.warn_if_estimated_requests_above)
    steps = [(None, levels)]
    if s.rename_order != "best_effort_bottom_up":
        groups = levels.select("level", "group_id").distinct().sort(F.col("level").asc_nulls_last(), F.col("group_id")).collect()  # no more than candidates
        steps = [(k, levels.filter(F.col("level").eqNullSafe(F.lit(g["level"])) & F.col("group_id").eqNullSafe(F.lit(g["group_id"])))) for k, g in enumerate(groups)]
    virtual = state.virtual_names(candidates, queue) if queue is not None else candidates.select("ea", F.col("name").alias("idb_name"), F.col("name").alias("suggested_name"), F.lit(1.0).alias("confidence"), F.lit("applied").alias("status"), F.lit(-1).alias("level"))
    virtual = graphs.saved(virtual.withColumn("evidence", F.array().cast("array<string>")))
    order = graphs.saved(graphs.callees_first(levels))
    outcomes, paused, sent, retried, asked_rows, unasked = None, None, 0, 0, None, candidates.select("ea").filter("false")
    for k, (step, members) in enumerate(steps):
        now = refreshed(candidates, inner, virtual.filter("status = 'applied'")).join(members.select("ea"), "ea")
        children = graphs.child_context(inner, virtual)
        now = now.join(children.select("ea", "context", "least_confidence"), "ea", "left")
        with_children = s.rename_order == "proposal_aware_bottom_up" and s.proposal_use_pending_child_names
        prompt = code.prompt_text(F.struct("name", "callees", "callers", "strings", "decoded", "apis", "constants", "pre_tags", "hints", "code"))
        prompt = F.concat_ws("\n", prompt, F.col("context")) if with_children else prompt
        hits = now.join(known, "ea").select("ea", "raw")
        items = graphs.saved(now.join(known.select("ea"), "ea", "left_anti").join(order, "ea").select("ea", "name", "ord", prompt.alias("prompt")))
        packed = graphs.packed_batches(items.select("ord", F.length("prompt").alias("chars")), names.budget_chars(s.model), size)
        batches = graphs.saved(items.select("ea", "ord").join(packed, "ord").select("ea", "batch"))
        left = max(0, s.max_ai_requests_per_run - sent)
        unasked = unasked.union(batches.filter(F.col("batch") >= left).select("ea"))
        batches = batches.filter(F.col("batch") < left)
        sent += batches.select("batch").distinct().count()
        asked = graphs.saved(ask_in_batches(items, batches, s, provider))
        missing = graphs.saved(items.join(batches.select("ea"), "ea", "left_semi").join(asked.select("ea"), "ea", "left_anti"))
        if s.max_retry_requests_per_run > retried and not missing.isEmpty():
            again = graphs.saved(graphs.retry_batches(missing.select("ea", "ord"), size, s.retry_batch_shrink_factor, s.max_retry_requests_per_run - retried))
            retried += again.select("batch").distinct().count()
            asked = graphs.saved(asked.union(ask_in_batches(missing, again, s, provider)))
        asked_rows = asked if asked_rows is None else asked_rows.union(asked)
        failed = missing.join(asked.select("ea"), "ea", "left_anti").select("ea", F.lit(None).cast("string").alias("raw"))
        raw = graphs.saved(hits.unionByName(asked).unionByName(failed))
        rows = answers.with_parsed(raw, "raw").join(now.select("ea", "name", "least_confidence"), "ea")
        rows = rows.select("ea", F.col("name").alias("old_name"), "least_confidence", answers.normalize_answer(F.col("parsed"), F.col("name"), s.prefix, s.require_evidence).alias("r"))
        conf = F.col("r.confidence")
        if with_children and s.proposal_propagate_child_confidence:
            conf = names.proposal_confidence(conf, F.col("least_confidence"))
        out = triage.decision(F.col("r.error"), F.col("r.name"), F.col("old_name"), conf, F.size("r.evidence"), s.review_mode, s.auto_apply_confidence, s.comment_only_below_confidence, s.require_evidence)
        done = graphs.saved(rows.select("ea", "old_name", "r.name", conf.alias("confidence"), "r.evidence", out.alias("outcome"), F.lit(k).alias("level")))
        outcomes = done if outcomes is None else outcomes.union(done)
        if k % 16 == 15:
            outcomes, asked_rows = graphs.saved(outcomes), graphs.saved(asked_rows)
        status = F.when(F.col("outcome") == "renamed", "applied").otherwise("pending_review")
        fresh = done.filter("outcome IN ('renamed', 'queued')").select("ea", F.when(F.col("outcome") == "renamed", F.col("name")).otherwise(F.col("old_name")).alias("idb_name"), F.col("name").alias("suggested_name"), "confidence", status.alias("status"), F.lit(k).alias("level"), F.slice("evidence", 1, 8).alias("evidence"))
        virtual = graphs.saved(virtual.join(fresh.select("ea"), "ea", "left_anti").unionByName(fresh.select(*virtual.columns)))
        if s.rename_order == "strict_bottom_up" and s.review_mode and s.strict_pause_for_review and not done.filter("outcome = 'queued'").isEmpty():
            paused = step
            break
    return {"outcomes": outcomes.drop("evidence"), "counts": state.run_counts(outcomes), "estimate": estimate, "virtual": virtual, "answers": asked_rows, "unasked": unasked, "requests": candidates.sparkSession.range(1).select(F.lit(sent).alias("sent"), F.lit(retried).alias("retried")), "paused": candidates.sparkSession.range(1).select(F.lit(paused).cast("int").alias("level"))}


def history_items(outcomes: DataFrame, batch_id: str, provider: str, model: str) -> DataFrame:
    """A run's applied names as rows of the history table."""
    done = outcomes.filter("outcome = 'renamed'")
    return done.select(F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("ts"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), "ea", F.lit("function_rename").alias("kind"), "old_name", F.col("name").alias("new_name"), F.round("confidence", 3).alias("confidence"))


def queue_items(outcomes: DataFrame) -> DataFrame:
    """A run's queued names as rows of the review queue."""
    waiting = outcomes.filter("outcome IN ('queued', 'failed_queued')")
    none = F.lit(None).cast("string")
    return waiting.select(F.lit("function_rename").alias("kind"), "ea", "old_name", F.col("name").alias("suggested_name"), none.alias("old_var"), none.alias("new_var"), none.alias("new_prototype"), "confidence", F.lit("pending").alias("status"), F.col("level").cast("int").alias("dependency_level"), F.array().cast("array<struct<ea:bigint,suggested_name:string>>").alias("deps"), F.current_timestamp().alias("ts"), F.col("ea").alias("ord"))


def forensic_report(contexts: DataFrame, iocs: DataFrame, decoded: DataFrame, history: DataFrame, queue: DataFrame, sample: int = 200) -> dict[str, DataFrame]:
    """The parts of the report: coverage, most frequent calls and strings, risky functions, indicators, last batches, open proposals, sample.

    A decoded string counts once for each function it belongs to and once for itself.
    """
    each = lambda c: contexts.select(F.explode(c).alias("value"))
    decoded_values = each("decoded").union(decoded.filter("string <> ''").select("string"))
    return {
        "coverage": triage.coverage(contexts),
        "top_apis": triage.top_values(each(F.slice("apis", 1, 12)), 30),
        "top_strings": triage.top_values(each(F.slice("strings", 1, 8)), 20, 6),
        "top_decoded": triage.top_values(decoded_values, 40),
        "high_risk": triage.high_risk(contexts.withColumn("tags", F.col("pre_tags"))).select("ea", "name", "tags", "hints"),
        "iocs": indicators.report_lines(iocs),
        "history": state.keep_batches(history.groupBy("batch_id").agg(F.max("ts").alias("ts"), F.count("*").alias("items")), 15),
        "queue": state.sort_queue(queue.filter("status = 'pending'")),
        "nodes": contexts.sort("ea").limit(sample),
    }


def program_summary(contexts: DataFrame, iocs: DataFrame, program: str) -> DataFrame:
    """One row, `text`: what a model is told of a whole program: coverage, first renamed functions, values of each indicator type."""
    cover = triage.coverage(contexts).select(F.concat(F.lit(f"Binary: {program}\nTotal functions: "), "n_funcs", F.lit("  Renamed: "), "n_renamed").alias("a"))
    named = contexts.filter(~names.is_default_name(F.col("name"))).sort("ea").limit(20).agg(F.concat(F.lit("Top renamed: "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ea", "name"))), lambda x: x["name"]), ", ")).alias("b"))
    top = iocs.withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy("value"))).filter("_n <= 8")
    lines = top.groupBy("type").agg(F.concat(F.upper("type"), F.lit(": "), F.array_join(F.sort_array(F.collect_list("value")), ", ")).alias("line"))
    listed = lines.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("c"))
    return reduce(lambda x, y: x.crossJoin(y), [cover, named, listed]).select(F.concat_ws("\n", "a", "b", "c").alias("text"))  # one row each


def export_function(ea: int, contexts: DataFrame, blobs: DataFrame, queue: DataFrame, history: DataFrame) -> DataFrame:
    """One row, `json`: everything about one function."""
    pick = lambda df, key, item: df.filter(F.col(key) == ea).agg(F.collect_list(item).alias("x"))
    parts = [pick(contexts, "ea", F.struct(*contexts.columns)).toDF("context"), pick(blobs, "func_ea", F.struct("kind", "value")).toDF("metadata"), pick(queue.filter("status = 'pending'"), "ea", F.struct(*queue.columns)).toDF("pending"), state.function_history(history, ea).agg(F.collect_list(F.struct(*history.columns)).alias("history"))]
    return reduce(lambda x, y: x.crossJoin(y), parts).select(F.to_json(F.struct("context", "metadata", "pending", "history")).alias("json"))  # one row each
