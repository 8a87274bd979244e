"""Messy JSON answers of models: repair, parse, normalise, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import bound, holds_any, sanitize_name

# Categories a result can have.
CATEGORIES = ("WRAPPER", "NETWORK", "CRYPTO", "INJECT", "PERSIST", "EVASION", "RECON", "EXEC", "FILE", "MEMORY", "DISPATCH", "CTOR", "INIT", "LOADER", "CONFIG", "UTIL", "UNKNOWN")
ANALYZER_CATEGORIES = ("MEMORY", "NETWORK", "CRYPTO", "FILE", "DISPATCH", "WRAPPER", "INIT", "UTIL", "UNKNOWN")
PRIORITIES = ("low", "medium", "high", "critical")
# Words in a name that claim much and need two pieces of evidence.
OVERCLAIMS = ("exfiltrate", "steal", "backdoor", "c2", "c&c", "keylog", "rootkit", "bootkit", "ransom")


# What repair and reading look for: fences, what stands before the first and after the last bracket, commas before a
# closing bracket, the outermost braces, a fenced object.
FENCE, BEFORE, AFTER, LOOSE_COMMA = r"```(?:json)?\s*", r"(?s)^[^\[{]+(?=[\[{])", r"(?s)(?<=[}\]])[^}\]]*$", r",\s*([}\]])"
BRACES, FENCED = r"(?s)(\{.*\})", r"(?s)```json\s*(\{.*?\})\s*```"
# The issues of an answer and of an analysis.
ISSUES = ("invalid name", "confidence out of range", "unknown category", "evidence missing or empty")
ANALYSIS_ISSUES = ("evidence missing", "confidence out of range", "invalid priority", "invalid category", "rename recommendation missing name")


def _parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def repair_json(text: Column) -> Column:
    """Strip fences and prose, straighten quotes, drop trailing commas; single quotes turn double if that parses."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), FENCE, "")
    # from the first opening bracket to the last closing one
    s = F.regexp_replace(s, BEFORE, "")
    s = F.regexp_replace(s, AFTER, "")
    s = F.translate(s, "“”‘’", "\"\"''")
    s = F.regexp_replace(s, LOOSE_COMMA, "$1")

    def straightened(s: Column) -> Column:
        single = (F.length(s) - F.length(F.replace(s, F.lit("'"), F.lit(""))) >= 2) & ~F.contains(F.substring(s, 1, 20), F.lit('"'))
        return F.when(single, bound(F.regexp_replace(s, r"(?<!\\)'", '"'), lambda doubled: F.when(_parsed(doubled).isNotNull(), doubled).otherwise(s))).otherwise(s)

    return F.when(F.coalesce(text, F.lit("")) == "", "{}").otherwise(bound(s, straightened))


def parse_json(text: Column) -> Column:
    """The first of six readings that parses, as VARIANT: the text and its repaired form, each whole, as its outermost braces, or as
    a fenced block. Null if none does or there is no text."""

    def readings(form: Column) -> list[Column]:
        return [_parsed(form), _parsed(F.regexp_extract(form, BRACES, 1)), _parsed(F.regexp_extract(form, FENCED, 1))]

    mended = bound(repair_json(text), lambda form: F.coalesce(*readings(form)))
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(*readings(text), mended))


def with_parsed(df: DataFrame, column: str, out: str = "parsed") -> DataFrame:
    """df with `out` (VARIANT) and `parse_error`: null, or the reason."""
    text = F.col(column)
    return df.withColumn(out, parse_json(text)).withColumn("parse_error", F.when(F.coalesce(text, F.lit("")) == "", "empty response").when(F.col(out).isNull(), "all parse attempts failed"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _strings(v: Column, *paths: str) -> Column:
    """A list field as strings: a list, or a single text as a list of one."""
    out = []
    for p in paths:
        out += [_get(v, p, "array<string>"), F.when(F.coalesce(_get(v, p, "string"), F.lit("")) != "", F.array(_get(v, p, "string")))]
    return F.coalesce(*out, F.array().cast("array<string>"))


def _kept(items: Column, width: int) -> Column:
    return F.transform(F.filter(items, lambda e: F.trim(e) != ""), lambda e: F.substring(e, 1, width))


def normalize_answer(v: Column, original: Column, prefix: str = "", require_evidence: bool = True) -> Column:
    """A struct with name, confidence, category, description, evidence, warnings, tags and error from a parsed answer."""
    none = F.array().cast("array<string>")
    given = F.coalesce(F.nullif(_get(v, "name", "string"), F.lit("")), _get(v, "function_name", "string"), F.lit(""))
    named = bound(sanitize_name(given, prefix), lambda own: F.when(own == "unknown_func", sanitize_name(original, prefix)).otherwise(own))
    tag_text = F.coalesce(_get(v, "tags", "array<string>"), F.split(_get(v, "tags", "string"), r"[,;\s]+"), none)
    found = F.struct(
        F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"),
        named.alias("name"),
        _kept(_strings(v, "evidence", "evidence_list"), 300).alias("evidence"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_get(v, "confidence", "double"), _get(v, "score", "double"), F.lit(0.5)))).alias("conf"),
        F.filter(F.transform(tag_text, lambda t: F.upper(t)), lambda t: t.isin(*CATEGORIES)).alias("tags"),
        F.upper(F.coalesce(_get(v, "category", "string"), F.lit("UNKNOWN"))).alias("category"),
        F.transform(F.slice(_strings(v, "warnings", "analyst_warnings"), 1, 10), lambda w: F.substring(w, 1, 200)).alias("warnings"),
    )
    description = F.substring(F.trim(F.coalesce(_get(v, "description", "string"), _get(v, "summary", "string"), F.lit(""))), 1, 600)

    def result(b: Column) -> Column:
        conf = F.when(F.size(b["evidence"]) == 0, F.least(b["conf"], F.lit(0.5))).otherwise(b["conf"]) if require_evidence else b["conf"]
        bold = holds_any(F.lower(b["name"]), OVERCLAIMS) & (F.size(b["evidence"]) < 2)
        conf = F.when(bold, F.least(conf, F.lit(0.55))).otherwise(conf)
        category = F.when(b["category"].isin(*CATEGORIES), b["category"]).otherwise(F.coalesce(F.try_element_at(b["tags"], F.lit(1)), F.lit("UNKNOWN")))
        warnings = F.when(bold, F.concat(b["warnings"], F.array(F.concat(F.lit("overclaim_name_without_sufficient_evidence: "), b["name"])))).otherwise(b["warnings"])

        def pick(good: Column, bad: Column) -> Column:
            return F.when(b["is_object"], good).otherwise(bad)

        return F.struct(
            pick(b["name"], sanitize_name(original, prefix)).alias("name"),
            pick(F.round(conf, 3), F.lit(0.0)).alias("confidence"),
            pick(category, F.lit("UNKNOWN")).alias("category"),
            pick(description, F.lit("Parse error: the answer could not be decoded.")).alias("description"),
            pick(F.slice(b["evidence"], 1, 15), none).alias("evidence"),
            pick(warnings, F.array(F.lit("parse_error"))).alias("warnings"),
            pick(b["tags"], none).alias("tags"),
            (~b["is_object"]).alias("error"),
        )

    return bound(found, result)


def answer_issues(r: Column) -> Column:
    """What is wrong with a normalised answer; empty if nothing."""
    issues = F.array(
        F.when(~F.coalesce(r["name"], F.lit("")).rlike("^[a-zA-Z_][a-zA-Z0-9_]{0,63}$"), ISSUES[0]),
        F.when(~F.coalesce(r["confidence"].between(0, 1), F.lit(False)), ISSUES[1]),
        F.when(~F.coalesce(r["category"].isin(*CATEGORIES), F.lit(False)), ISSUES[2]),
        F.when(F.size(F.coalesce(r["evidence"], F.array().cast("array<string>"))) == 0, ISSUES[3]),
    )
    return F.array_compact(issues)


def normalize_analysis(v: Column, original: Column, threshold: float = 0.85) -> Column:
    """The analyzer's result struct; a rename is recommended only with a flag, a name and enough confidence."""
    text = lambda path, n: F.substring(F.coalesce(_get(v, path, "string"), F.lit("")), 1, n)
    evidence = _kept(_strings(v, "evidence"), 300)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_get(v, "confidence", "double"), F.lit(0.0))))
    conf = F.when(F.size(evidence) == 0, F.least(conf, F.lit(0.5))).otherwise(conf)
    category, priority = F.upper(_get(v, "category", "string")), F.lower(_get(v, "priority", "string"))
    fallback = F.coalesce(F.nullif(_get(v, "function_name", "string"), F.lit("")), F.nullif(original, F.lit("")))
    name = F.lower(sanitize_name(F.coalesce(F.nullif(_get(v, "rename_recommendation.name", "string"), F.lit("")), fallback, F.lit(""))))
    apply = F.coalesce(_get(v, "rename_recommendation.apply", "boolean"), F.lit(False)) & (conf >= threshold)
    return F.struct(
        F.lower(sanitize_name(F.coalesce(fallback, F.lit("unknown_func")))).alias("function_name"),
        F.round(conf, 3).alias("confidence"),
        F.when(priority.isin(*PRIORITIES), priority).otherwise("low").alias("priority"),
        F.when(category.isin(*ANALYZER_CATEGORIES), category).otherwise("UNKNOWN").alias("category"),
        text("summary", 800).alias("summary"),
        text("technical_behavior", 1800).alias("technical_behavior"),
        F.slice(evidence, 1, 15).alias("evidence"),
        F.slice(_kept(_strings(v, "data_flows"), 300), 1, 12).alias("data_flows"),
        F.slice(_kept(_strings(v, "called_behaviors"), 300), 1, 12).alias("called_behaviors"),
        F.slice(_kept(_strings(v, "warnings"), 300), 1, 10).alias("warnings"),
        F.struct(apply.alias("apply"), name.alias("name"), text("rename_recommendation.reason", 500).alias("reason")).alias("rename_recommendation"),
        F.slice(_kept(_strings(v, "analyst_notes"), 300), 1, 10).alias("analyst_notes"),
    )


def analysis_issues(r: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.size(F.coalesce(r["evidence"], F.array().cast("array<string>"))) == 0, ANALYSIS_ISSUES[0]),
            F.when(~F.coalesce(r["confidence"].between(0, 1), F.lit(False)), ANALYSIS_ISSUES[1]),
            F.when(~F.coalesce(r["priority"].isin(*PRIORITIES), F.lit(False)), ANALYSIS_ISSUES[2]),
            F.when(~F.coalesce(r["category"].isin(*ANALYZER_CATEGORIES), F.lit(False)), ANALYSIS_ISSUES[3]),
            F.when(r["rename_recommendation"]["apply"] & (F.coalesce(r["rename_recommendation"]["name"], F.lit("")) == ""), ANALYSIS_ISSUES[4]),
        )
    )


def static_only(name: Column, score: Column, reasons: Column) -> Column:
    """The analyzer's record for a function that no model looked at."""
    none = F.array().cast("array<string>")
    return F.struct(
        name.alias("function_name"), F.lit(0.0).alias("confidence"), score.alias("priority"), F.lit("UNKNOWN").alias("category"), F.lit("Static triage only.").alias("summary"), F.lit("").alias("technical_behavior"), F.slice(reasons, 1, 15).alias("evidence"),
        none.alias("data_flows"), none.alias("called_behaviors"), none.alias("warnings"), F.struct(F.lit(False).alias("apply"), name.alias("name"), F.lit("").alias("reason")).alias("rename_recommendation"), none.alias("analyst_notes"),
    )


def check_suggestions(df: DataFrame, known: DataFrame) -> DataFrame:
    """Variable suggestions (ea, ord, old_name, new_name, confidence, reason) that rename a known variable (ea, var); first of each old name.

    New names are sanitised and lower-cased and must change something; confidence is clamped, and is at most 0.5 without
    a reason. ord is of any type that sorts and should differ within an ea: which of equal ones is first is left open.
    """
    from pyspark.sql import Window

    names = known.select(F.col("ea").alias("_ea"), F.col("var").alias("_var")).distinct()
    clean = df.withColumn("old_name", F.trim("old_name")).withColumn("new_name", F.lower(sanitize_name(F.col("new_name"))))
    clean = clean.join(names, (F.col("ea") == F.col("_ea")) & (F.col("old_name") == F.col("_var")), "left_semi")
    clean = clean.filter(F.col("new_name").rlike("^[a-z_][a-z0-9_]{0,63}$") & (F.col("new_name") != F.col("old_name")))
    first = Window.partitionBy("ea", "old_name").orderBy("ord")
    reason = F.substring(F.coalesce("reason", F.lit("")), 1, 400)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    clean = clean.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return clean.select("ea", "old_name", "new_name", F.round(F.when(reason == "", F.least(conf, F.lit(0.5))).otherwise(conf), 3).alias("confidence"), reason.alias("reason"))


def pack(value: Column) -> Column:
    """A structure as JSON text."""
    return F.to_json(value)


def unpack(text: Column) -> Column:
    """Stored text as VARIANT: parsed where it is JSON, else the text itself; null for nothing."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(_parsed(text), F.try_variant_get(F.try_parse_json(F.to_json(F.array(text))), "$[0]", "variant")))
