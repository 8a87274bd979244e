"""Keyed state: review queue, rename history, result cache, key-value blobs.

Each operator takes the current table and returns the next one; writing it is up to the caller (see sources.store).
Queue rows: kind, ea, old_name, suggested_name, old_var, new_var, new_prototype, confidence, status, dependency_level,
deps array<struct<ea,suggested_name>>, ts, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_default_name

KEPT_BATCHES, KEPT_RESULTS = 50, 5000


def item_key(kind: Column = None) -> Column:
    """What makes two queue rows the same proposal, by kind."""
    kind = F.coalesce("kind", F.lit("function_rename")) if kind is None else kind
    what = F.when(kind == "variable_rename", F.to_json(F.struct("old_var", "new_var"))).when(kind == "prototype_change", F.to_json(F.struct("new_prototype"))).otherwise(F.to_json(F.struct("suggested_name")))
    return F.concat_ws("|", kind, F.col("ea").cast("string"), what)


def slot_key() -> Column:
    """What a new pending row replaces: one per function, and per variable for variable renames."""
    return F.concat_ws("|", F.coalesce("kind", F.lit("function_rename")), F.col("ea").cast("string"), F.when(F.col("kind") == "variable_rename", F.col("old_var")))


def upsert_queue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """queue with `new` pending rows in place of pending rows of the same slot; of several new rows for a slot the last (ord) counts."""
    last = Window.partitionBy(slot_key()).orderBy(F.col("ord").desc())
    fresh = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    slots = fresh.select(slot_key().alias("_slot"))
    pending = queue.filter("status = 'pending'").withColumn("_mine", slot_key())
    kept = pending.join(slots, F.col("_mine") == F.col("_slot"), "left_anti").drop("_mine")
    return queue.filter("status IS NULL OR status <> 'pending'").unionByName(kept).unionByName(fresh.select(*queue.columns))


def queue_order() -> list[Column]:
    deps = F.size(F.coalesce("deps", F.array().cast("array<struct<ea:bigint,suggested_name:string>>")))
    return [deps > 0, F.coalesce("dependency_level", F.lit(0)), deps, F.col("ts"), F.col("ord")]


def sort_queue(queue: DataFrame) -> DataFrame:
    """Rows without pending dependencies first, then by level, number of dependencies and time."""
    return queue.sort(*queue_order())


def set_status(queue: DataFrame, chosen: DataFrame, status: str) -> DataFrame:
    """Pending rows that match a chosen pending row get the status; final rows stay as they are."""
    keys = chosen.filter("status = 'pending'").select(item_key().alias("_key")).distinct()
    marked = queue.withColumn("_own", item_key()).join(keys, F.col("_own") == F.col("_key"), "left")
    done = F.when((F.col("status") == "pending") & F.col("_key").isNotNull(), status).otherwise(F.col("status"))
    return marked.withColumn("status", done).select(*queue.columns)


def confident(queue: DataFrame, threshold: float) -> DataFrame:
    return sort_queue(queue.filter((F.col("status") == "pending") & (F.col("confidence") >= threshold)))


def missing_dependencies(chosen: DataFrame, queue: DataFrame) -> DataFrame:
    """(parent_ea, *queue columns): pending function renames that chosen rows depend on and that are not chosen themselves."""
    own = chosen.select(item_key().alias("_have")).distinct()
    wants = chosen.filter("coalesce(kind, 'function_rename') = 'function_rename'").select(F.col("ea").alias("parent_ea"), F.explode("deps").alias("_d"))
    pending = queue.filter("status = 'pending' AND coalesce(kind, 'function_rename') = 'function_rename'").withColumn("_own", item_key())
    hits = wants.join(pending, (F.col("_d.ea") == F.col("ea")) & (F.col("_d.suggested_name") == F.col("suggested_name")))
    return hits.join(own, F.col("_own") == F.col("_have"), "left_anti").select("parent_ea", *queue.columns)


def apply_plan(chosen: DataFrame, queue: DataFrame, missing: str = "cancel") -> DataFrame:
    """The rows to apply, in dependency order: nothing if something is missing and missing is cancel; include_dependencies adds
    one hop of them; selected_only goes ahead without."""
    pending = chosen.filter("status = 'pending'").select(*queue.columns)
    lack = missing_dependencies(pending, queue).drop("parent_ea")
    if missing == "cancel":
        return sort_queue(pending.join(lack.select(F.lit(1).alias("_x")).limit(1), F.lit(True), "left_anti"))
    if missing == "include_dependencies":
        once = lack.withColumn("_n", F.row_number().over(Window.partitionBy(item_key()).orderBy("ord"))).filter("_n = 1").drop("_n")
        pending = pending.unionByName(once)
    return sort_queue(pending)


def run_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def keep_batches(batches: DataFrame, keep: int = KEPT_BATCHES) -> DataFrame:
    """The latest batches (batch_id, ts)."""
    return batches.sort(F.col("ts").desc(), F.col("batch_id").desc()).limit(keep)


def function_history(items: DataFrame, ea: int, keep: int = 10) -> DataFrame:
    return items.filter(F.col("ea") == ea).sort(F.col("ts").desc(), F.col("batch_id").desc()).limit(keep)


def rollback_plan(items: DataFrame, current: DataFrame) -> DataFrame:
    """(ea, kind, restore, outcome) for the items of the last batch.

    items (batch_id, ts, ea, kind, old_name, new_name); current (ea, name). Functions renamed by hand since are left alone.
    """
    last = items.agg(F.max(F.struct("ts", "batch_id")).alias("m")).select("m.*").toDF("_ts", "_batch")
    mine = items.join(F.broadcast(last), (F.col("ts") == F.col("_ts")) & (F.col("batch_id") == F.col("_batch")), "left_semi")
    now = current.select(F.col("ea").alias("_ea"), F.col("name").alias("_name"))
    rows = mine.join(now, F.col("ea") == F.col("_ea"), "left")
    by_hand = (F.coalesce("_name", F.lit("")) != "") & (F.col("_name") != F.col("new_name")) & ~is_default_name(F.col("_name"))
    outcome = F.when(F.coalesce("old_name", F.lit("")) == "", "skipped").when((F.col("kind") == "function_rename") & by_hand, "manual_skipped").otherwise("restore")
    return rows.select("ea", "kind", F.col("old_name").alias("restore"), outcome.alias("outcome"))


def cache_hits(wanted: DataFrame, cache: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """wanted (key, ...) with `result`, null for entries that are absent, empty or older than the time to live."""
    live = cache.filter((F.col("ts") >= now - F.make_dt_interval(F.lit(days))) & (F.coalesce("result", F.lit("")) != "")).select(F.col("key").alias("_key"), "result")
    return wanted.join(live, F.col("key") == F.col("_key"), "left").drop("_key")


def cache_put(cache: DataFrame, new: DataFrame, keep: int = KEPT_RESULTS) -> DataFrame:
    """The newest `keep` entries after the new ones took the place of old ones under their keys."""
    every = cache.join(new.select("key"), "key", "left_anti").unionByName(new.select(*cache.columns))
    return every.sort(F.col("ts").desc(), "key").limit(keep)


def put_blobs(blobs: DataFrame, new: DataFrame) -> DataFrame:
    """blobs (func_ea, kind, value) with new values under their keys."""
    return blobs.join(new.select("func_ea", "kind"), ["func_ea", "kind"], "left_anti").unionByName(new.select(*blobs.columns))


def virtual_names(candidates: DataFrame, queue: DataFrame) -> DataFrame:
    """(ea, idb_name, suggested_name, confidence, status, level): the names functions would have if pending renames went through."""
    last = Window.partitionBy("ea").orderBy(F.col("ord").desc())
    pending = queue.filter("status = 'pending' AND coalesce(kind, 'function_rename') = 'function_rename'").withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    q = pending.select(F.col("ea").alias("_ea"), F.col("old_name").alias("_old"), F.col("suggested_name").alias("_new"), F.coalesce("confidence", F.lit(0.0)).alias("_conf"), F.coalesce("dependency_level", F.lit(0)).alias("_level"))
    rows, has = candidates.join(q, F.col("ea") == F.col("_ea"), "left"), F.col("_ea").isNotNull()
    pick = lambda a, b: F.when(has, a).otherwise(b)
    return rows.select("ea", pick(F.col("_old"), F.col("name")).alias("idb_name"), pick(F.col("_new"), F.col("name")).alias("suggested_name"), pick(F.col("_conf"), F.lit(1.0)).alias("confidence"), pick(F.lit("pending_review"), F.lit("applied")).alias("status"), pick(F.col("_level"), F.lit(-1)).alias("level"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """One row: entries and kB of stored results."""
    return cache.agg(F.count("*").alias("entries"), F.round(F.coalesce(F.sum(F.octet_length("result")), F.lit(0)) / 1024.0, 1).alias("size_kb"))


def pending_item(queue: DataFrame, ea: int, kind: str = "function_rename") -> DataFrame:
    """The first pending row of a function and kind, or none."""
    return queue.filter((F.col("ea") == ea) & (F.coalesce("kind", F.lit("function_rename")) == kind) & (F.col("status") == "pending")).sort("ord").limit(1)


def dependency_text(deps: Column) -> Column:
    """A line for each dependency: address and the name it waits for."""
    return F.array_join(F.transform(deps, lambda d: F.concat(F.lit("0x"), F.hex(d["ea"]), F.lit(" -> "), d["suggested_name"])), "\n")


def saved_functions(blobs: DataFrame) -> DataFrame:
    return blobs.select("func_ea").distinct()


def drop_blobs(blobs: DataFrame, keys: DataFrame) -> DataFrame:
    return blobs.join(keys.select("func_ea", "kind"), ["func_ea", "kind"], "left_anti")


def apply_counts(chosen: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: requested, applied, failed, skipped. chosen are the rows of an apply plan; those not pending are skipped; failed (ord) are the rows that a host could not apply."""
    rows = chosen.select("ord", "status").join(failed.select(F.col("ord").alias("_f")).distinct(), F.col("ord") == F.col("_f"), "left")
    pending = F.col("status") == "pending"
    return rows.agg(F.count("*").alias("requested"), F.count_if(pending & F.col("_f").isNull()).alias("applied"), F.count_if(pending & F.col("_f").isNotNull()).alias("failed"), F.count_if(~F.coalesce(pending, F.lit(False))).alias("skipped"))


def change_of(queue: DataFrame) -> DataFrame:
    """(ord, kind, ea, target, value): what applying a row of the queue changes: a function's name, one of its variables, or its prototype."""
    kind = F.coalesce("kind", F.lit("function_rename"))
    value = F.when(kind == "variable_rename", F.col("new_var")).when(kind == "prototype_change", F.col("new_prototype")).otherwise(F.col("suggested_name"))
    target = F.when(kind == "variable_rename", F.col("old_var")).when(kind == "prototype_change", F.lit("prototype")).otherwise(F.lit("name"))
    return queue.select("ord", kind.alias("kind"), "ea", target.alias("target"), value.alias("value")).filter(F.coalesce("value", F.lit("")) != "")


def append_batch(history: DataFrame, batch: DataFrame, keep: int = 50) -> DataFrame:
    """history with a batch's rows; only the newest `keep` batches stay, and confidences have three digits."""
    every = history.unionByName(batch.select(*history.columns).withColumn("confidence", F.round("confidence", 3)))
    newest = every.groupBy("batch_id").agg(F.max("ts").alias("ts")).sort(F.col("ts").desc(), F.col("batch_id").desc()).limit(keep)
    return every.join(F.broadcast(newest.select("batch_id")), "batch_id", "left_semi")  # `keep` ids
