"""Requests about structures, prototypes and variables: context in, checked suggestions out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, names, prompts
from ..settings import Settings
from ..sources.provider import ask, offline

#: A structure is noted on its function from this confidence on.
NOTED = 0.70


def _parsed(requests: DataFrame, settings: Settings, provider: Callable[[str, str], str]) -> DataFrame:
    """(ea, v) of the requests (ea, prompt) whose answers can be read."""
    raw = ask(requests.select(F.col("ea").alias("id"), "prompt"), provider, settings.api_keys or ("offline",), workers=settings.request_workers)
    return answers.with_parsed(raw, "raw").filter("parse_error IS NULL").select(F.col("id").alias("ea"), F.col("parsed").alias("v"))


def structures(contexts: DataFrame, accesses: DataFrame, settings: Settings, provider: Callable[[str, str], str] = offline) -> DataFrame:
    """(ea, struct_name, confidence, fields, definition, note) for functions with accesses (func_ea, offset) and an answer that has fields.

    note is null below NOTED. Functions without accesses are not asked about.
    """
    offsets = accesses.groupBy(F.col("func_ea").alias("_f")).agg(F.slice(F.sort_array(F.collect_set("offset")), 1, settings.max_struct_fields).alias("offsets"))
    asked = contexts.join(offsets, F.col("ea") == F.col("_f")).select("ea", prompts.structure_request(F.col("name"), F.col("offsets"), F.col("strings"), F.col("apis"), F.col("code"), settings.max_struct_fields).alias("prompt"))
    kind = "array<struct<offset:bigint,name:string,type:string,purpose:string>>"
    rows = _parsed(asked, settings, provider).select("ea", F.try_variant_get("v", "$.struct_name", "string").alias("struct_name"), F.coalesce(F.try_variant_get("v", "$.confidence", "double"), F.lit(0.0)).alias("confidence"), F.try_variant_get("v", "$.fields", kind).alias("fields"))
    rows = rows.filter(F.size(F.coalesce("fields", F.array().cast(kind))) > 0)
    shown = F.array_join(F.transform(F.slice("fields", 1, 6), lambda f: F.concat(names.sanitize_name(F.coalesce(f["name"], F.lit("?"))), F.lit("@+"), F.lower(F.hex(F.coalesce(f["offset"], F.lit(0)))))), ", ")
    note = F.when(F.col("confidence") >= NOTED, F.concat(F.lit("[AI-Struct] Struct: "), F.coalesce("struct_name", F.lit("?")), F.lit(" (fields: "), shown, F.lit(")")))
    return rows.select("ea", "struct_name", "confidence", "fields", names.struct_text(F.col("struct_name"), F.col("confidence"), F.col("fields")).alias("definition"), note.alias("note"))


def _queue_rows(rows: DataFrame, kind: str, **given: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    column = lambda name: given.get(name, none).alias(name)
    fixed = [F.lit("pending").alias("status"), F.lit(0).alias("dependency_level"), F.array().cast("array<struct<ea:bigint,suggested_name:string>>").alias("deps"), F.current_timestamp().alias("ts"), F.col("ea").alias("ord")]
    return rows.select(F.lit(kind).alias("kind"), "ea", *[column(c) for c in ("old_name", "suggested_name", "old_var", "new_var", "new_prototype")], "confidence", *fixed)


def prototypes(contexts: DataFrame, settings: Settings, provider: Callable[[str, str], str] = offline) -> DataFrame:
    """Review-queue rows with the prototypes that declare their function; functions without code are not asked about."""
    fields = ("name", "callers", "callees", "apis", "strings", "decoded", "constants", "pre_tags", "code")
    asked = contexts.filter(F.coalesce("code", F.lit("")) != "").select("ea", prompts.prototype_request({c: F.col(c) for c in fields}).alias("prompt"))
    rows = _parsed(asked, settings, provider).join(contexts.select("ea", "name"), "ea")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get("v", "$.confidence", "double"), F.lit(0.0))))
    rows = rows.select("ea", "name", names.check_prototype(F.try_variant_get("v", "$.prototype", "string"), F.col("name")).alias("prototype"), F.round(conf, 3).alias("confidence")).filter("prototype <> ''")
    return _queue_rows(rows, "prototype_change", old_name=F.col("name"), new_prototype=F.col("prototype"))


def variables(contexts: DataFrame, locals_: DataFrame, settings: Settings, provider: Callable[[str, str], str] = offline) -> DataFrame:
    """Review-queue rows with checked new names for local variables (ea, ord, name, type, is_arg)."""
    listed = locals_.groupBy(F.col("ea").alias("_f")).agg(F.sort_array(F.collect_list(F.struct("ord", "name", "type", "is_arg"))).alias("vars"))
    asked = contexts.join(listed, F.col("ea") == F.col("_f")).select("ea", prompts.variables_request(F.col("name"), F.col("vars"), F.col("code")).alias("prompt"))
    kind = "array<struct<old_name:string,new_name:string,confidence:double,reason:string>>"
    given = _parsed(asked, settings, provider).select("ea", F.posexplode(F.try_variant_get("v", "$.variables", kind)).alias("ord", "x")).select("ea", "ord", "x.*")
    checked = answers.check_suggestions(given, locals_.select("ea", F.col("name").alias("var"))).join(contexts.select("ea", "name"), "ea")
    return _queue_rows(checked, "variable_rename", old_name=F.col("name"), old_var=F.col("old_name"), new_var=F.col("new_name"))


def ranges(snippets: DataFrame, settings: Settings, provider: Callable[[str, str], str] = offline) -> DataFrame:
    """(ea, summary, evidence, warnings) of pieces of code (ea, code), one request each; empty pieces are not asked about.

    A piece goes whole, however long; one that the model refuses or answers without JSON has no row.
    """
    asked = snippets.filter(F.trim(F.coalesce("code", F.lit(""))) != "").select("ea", prompts.range_request(F.col("code")).alias("prompt"))
    return _parsed(asked, settings, provider).select("ea", F.coalesce(F.try_variant_get("v", "$.summary", "string"), F.lit("")).alias("summary"), *[names.as_list(F.try_variant_get("v", f"$.{k}", "variant")).alias(k) for k in ("evidence", "warnings")])


def program(summary: DataFrame, settings: Settings, provider: Callable[[str, str], str] = offline) -> DataFrame:
    """(summary, capabilities, evidence, risk): what a model makes of a whole program from runs.program_summary's one row (text)."""
    asked = summary.select(F.lit(0).cast("long").alias("ea"), prompts.program_request(F.col("text")).alias("prompt"))
    told = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")).alias(k)
    listed = lambda k: names.as_list(F.try_variant_get("v", f"$.{k}", "variant")).alias(k)
    return _parsed(asked, settings, provider).select(told("summary"), listed("capabilities"), listed("evidence"), told("risk"))
