"""Everything known about a function in one row, and which functions a run looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import code, triage

LIBRARY_BIT, THUNK_BIT = 0x4, 0x80


def refreshed(candidates: DataFrame, inner: DataFrame, names: DataFrame) -> DataFrame:
    """candidates whose callees, callers and code say the names that functions have now.

    inner (caller, callee) edges among candidates; names (ea, idb_name): applied names, not those that wait for review. Only names of a function
    itself and of its neighbours are looked for, as whole words. Other columns stay as they are.
    """
    now = candidates.select(F.col("ea").alias("_n"), F.col("name").alias("was")).join(names.select(F.col("ea").alias("_e"), F.col("idb_name").alias("is")), F.col("_n") == F.col("_e")).filter("was <> is").select("_n", "was", "is")
    near = inner.select(F.col("caller").alias("_c"), F.col("callee").alias("_t")).union(inner.select("callee", "caller")).union(candidates.select("ea", "ea")).distinct()
    found = near.join(now, F.col("_t") == F.col("_n")).groupBy("_c", "was").agg(F.min("is").alias("is"))
    maps = found.groupBy("_c").agg(F.map_from_entries(F.collect_list(F.struct("was", "is"))).alias("_names"))
    renamed = lambda x: F.coalesce(F.try_element_at(F.col("_names"), x), x)
    words = F.split("code", r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])")
    new = {c: F.when(F.col("_names").isNull(), F.col(c)).otherwise(F.transform(c, renamed)) for c in ("callees", "callers") if c in candidates.columns}
    if "code" in candidates.columns:
        new["code"] = F.when(F.col("_names").isNull(), F.col("code")).otherwise(F.array_join(F.transform(words, renamed), ""))
    return candidates.join(maps, F.col("ea") == F.col("_c"), "left").withColumns(new).select(*candidates.columns)


def is_library_or_thunk(flags):
    return flags.bitwiseAND(F.lit(LIBRARY_BIT | THUNK_BIT)) != 0


def scope(functions: DataFrame, mode: str, roots: DataFrame | None = None, limit: int = 300) -> DataFrame:
    """(ea): the functions a run starts from. Given roots come first; else current_function (is_current), entry_points (is_entry), or the
    first `limit` addresses for review_priority_only and limited_program. Any other mode gives none."""
    if roots is not None:
        return roots.select("ea").distinct()
    if mode == "current_function":
        return functions.filter("is_current").select("ea")
    if mode == "entry_points":
        return functions.filter("is_entry").select("ea").distinct()
    if mode in ("review_priority_only", "limited_program"):
        return functions.select("ea").sort("ea").limit(limit)
    return functions.filter("false").select("ea")


def local_variables(variables: DataFrame, limit: int = 32) -> DataFrame:
    """(ea, vars): the first local variables (ea, ord, name, type, offset) of each function; -1 for those not on the stack."""
    nth = F.row_number().over(Window.partitionBy("ea").orderBy("ord"))
    top = variables.withColumn("_n", nth).filter(F.col("_n") <= limit)
    item = F.struct("_n", "name", "type", F.coalesce("offset", F.lit(-1)).alias("offset"))
    return top.groupBy("ea").agg(F.sort_array(F.collect_list(item)).alias("v")).select("ea", F.transform("v", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["offset"].alias("offset"))).alias("vars"))


def function_contexts(functions: DataFrame, insns: DataFrame, edges: DataFrame, names: DataFrame, string_refs: DataFrame, strings: DataFrame, decoded: DataFrame, dimension: DataFrame) -> DataFrame:
    """One row per function: ea, name, size_bytes, n_insn, callers, callees, strings, decoded, apis, constants, pre_tags, pre_reasons, hints, n_callers, n_callees.

    functions (ea, name, size_bytes, start, end); edges (src, dst, ea); names (ea, name); string_refs (func_ea, ea, addr); strings
    (addr, text); decoded (ord, string, address, function_ea, kind). Every list is cut per function before it is gathered, so
    no group grows with the program; each part is joined once on ea.
    """
    none = F.array().cast("array<string>")
    callees = code.first_names(edges, functions.select("ea", "name"), 20)
    callers = code.first_names(edges, functions.select("ea", "name"), 10, by="dst", of="src")
    apis = code.imported_names(edges, functions, names, 30)
    texts = code.referenced_strings(string_refs, strings)
    starts = functions.select(F.col("ea").alias("_ea"), "start")
    found = code.decoded_for_functions(decoded, functions).withColumnRenamed("ea", "start").join(starts, "start").select(F.col("_ea").alias("ea"), "value")
    fresh = found.join(texts.select("ea", F.explode("names").alias("value")), ["ea", "value"], "left_anti").groupBy("ea").agg(F.sort_array(F.collect_list("value")).alias("names"))
    called = callees.select("ea", F.explode("names").alias("api")).union(apis.select("ea", F.explode("names").alias("api")))
    tagged = triage.api_tags(called, dimension)
    tagged = tagged.unionByName(triage.string_tags(texts.select("ea", F.array_join(F.slice("names", 1, 15), " ").alias("text")))).unionByName(triage.dispatch_tags(insns))
    tags = triage.classify(tagged)
    out = code.function_sizes(functions, insns).join(functions.select("ea", "size_bytes"), "ea").join(code.xref_counts(edges, functions), "ea")
    for name, part in (("callees", callees), ("callers", callers), ("apis", apis), ("strings", texts), ("decoded", fresh), ("constants", code.constants(insns))):
        out = out.join(part.select("ea", F.col("names").alias(name)), "ea", "left")
    out = out.join(tags.select("ea", F.col("tags").alias("pre_tags"), F.col("reasons").alias("pre_reasons"), "hints"), "ea", "left")
    lists = ("callees", "callers", "apis", "strings", "decoded", "constants", "pre_tags", "pre_reasons", "hints")
    return out.withColumns({c: F.coalesce(F.col(c), none) for c in lists})
