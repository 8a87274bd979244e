"""Names, addresses, masks, hashes and short texts as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of generated names; any-case, matched at the start of a name.
DEFAULT_NAME = r"(?i)^(sub_|loc_|nullsub_|j_|unknown_libname_|fn_|func_|_[0-9a-f]{4,}|[?@]sub_|wrap_sub_)"

# Input characters a model takes, by model; others 10 000 tokens. Four characters count as a token.
MODEL_TOKENS = {
    "gemini-1.5-flash": 800_000, "gemini-1.5-pro": 800_000, "gemini-2.0-flash": 800_000, "gemini-2.5-flash": 800_000, "gemini-2.5-flash-preview-04-17": 800_000, "gemini-2.5-pro": 800_000,
    "llama3-70b-8192": 6_000, "llama3-8b-8192": 6_000, "mixtral-8x7b-32768": 28_000, "gpt-4o": 100_000, "gpt-4-turbo": 100_000, "gpt-3.5-turbo": 14_000,
}

# What a provider's message says about the kind of error; the first class with a word in it holds.
ERROR_WORDS = (
    ("quota_exhausted", ("quota", "resource_exhausted", "billing", "payment")),
    ("rate_limited", ("rate", "429", "too many", "ratelimit", "slow down", "throttle")),
    ("auth_error", ("auth", "401", "403", "invalid_api_key", "permission", "unauthorized", "invalid key")),
    ("model_not_found", ("model not found", "model_not_found", "no such model", "404", "does not exist")),
    ("safety_block", ("safety", "blocked", "harmful", "policy", "finish_reason")),
    ("network_timeout", ("timeout", "timed out", "connection", "network", "socket", "ssl", "unreachable")),
)


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def holds_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def sanitize_name(name: Column, prefix: str = "") -> Column:
    """A valid identifier of at most 64 characters, before the prefix; unknown_func if nothing is left."""
    cleaned = F.regexp_replace(F.trim(name), "`", "")
    cleaned = F.trim(F.regexp_extract(cleaned, r"^([^/#]*)", 1))
    cleaned = F.trim(F.regexp_replace(cleaned, "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    cleaned = F.regexp_replace(cleaned, "^(?=[0-9])", "_")
    lead = "".join(c for c in prefix if c.isascii() and (c.isalnum() or c == "_"))
    whole = F.concat(F.lit(lead), F.substring(cleaned, 1, 64))
    return F.coalesce(F.regexp_replace(whole, "^$", "unknown_func"), F.lit("unknown_func"))


def is_default_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).eqNullSafe("") | F.coalesce(name.rlike(DEFAULT_NAME), F.lit(False))


def rename_reason(name: Column, skip_named: Column | bool) -> Column:
    """no_name, default, named or force; all but no_name and named mean that the function is worth renaming."""
    skip = F.lit(skip_named) if isinstance(skip_named, bool) else skip_named
    return F.when(F.coalesce(name, F.lit("")) == "", "no_name").when(is_default_name(name), "default").when(skip, "named").otherwise("force")


def mask_key(key: Column) -> Column:
    return F.when(F.length(key) >= 12, F.concat(F.substring(key, 1, 6), F.lit("..."), F.right(key, F.lit(4)))).otherwise("***")


def escape_html(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def clip(text: Column, limit: int = 120) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def lines_of(values: Column, limit: int = 20) -> Column:
    """The first values, one to a line; a dash where there are none."""
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.array_join(F.slice(values, 1, limit), "\n", "")).otherwise("-")


def as_list(v: Column, limit: int = 300) -> Column:
    """A variant as a list of texts of at most `limit` characters: a list's values that are not blank, a text that is not blank, else none."""
    kept = lambda values: F.transform(F.filter(values, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), lambda x: F.substring(x, 1, limit))
    text = F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
    return F.coalesce(kept(F.coalesce(F.try_variant_get(v, "$", "array<string>"), text)), F.array().cast("array<string>"))


def hex_address(ea: Column) -> Column:
    """0x and upper-case hexadecimal digits."""
    return F.concat(F.lit("0x"), F.hex(ea))


def parse_address(text: Column) -> Column:
    """A decimal number, or hexadecimal after 0x; null if it is neither."""
    value = F.lower(F.trim(text))
    digits = F.regexp_extract(value, r"^0x([0-9a-f]{1,15})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long")).when(value.rlike(r"^[+-]?[0-9]{1,18}$"), value.try_cast("long"))


def _codes(name: Column) -> Column:
    return F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


MASK = 0xFFFFFFFF


def hash_djb2(name: Column) -> Column:
    return F.aggregate(_codes(name), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(MASK)))


def hash_fnv1a(name: Column) -> Column:
    return F.aggregate(_codes(name), F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(MASK)))


def hash_ror13(name: Column) -> Column:
    """Rotate right by 13 and add, over the name and a closing zero."""

    def step(h, c):
        return (F.shiftright(h, 13).bitwiseOR(F.shiftleft(h, 19)).bitwiseAND(F.lit(MASK)) + c).bitwiseAND(F.lit(MASK))

    return F.aggregate(F.concat(_codes(name), F.array(F.lit(0).cast("long"))), F.lit(0).cast("long"), step)


CACHE_VERSION = "v5"
# Fixed value: the version in keys of caches that are filled without a separator.
JOINED_VERSION = "v5.2"
FIELD_MARK = "\x1f"


def cache_key(ea: Column, name: Column, code: Column, callers: Column, callees: Column, strings: Column, decoded: Column, apis: Column, model: Column, provider: Column, version: str = CACHE_VERSION, mark: str = FIELD_MARK) -> Column:
    """SHA-256 over all that a result depends on. A separator keeps neighbouring fields apart, so no two inputs share a key by
    running together. An empty mark and version JOINED_VERSION give the keys of caches that are filled without a separator."""

    def listed(a):
        return F.array_join(F.sort_array(F.coalesce(a, F.array().cast("array<string>"))), ",")

    empty = F.lit("")
    parts = [F.concat(F.lit("0x"), F.lower(F.hex(ea))), F.coalesce(name, empty), F.coalesce(code, empty), listed(callers), listed(callees), listed(strings), listed(decoded), listed(apis), F.lit(version), F.coalesce(model, empty), F.coalesce(provider, empty)]
    return F.sha2(F.concat_ws(mark, *parts), 256)


def input_hash(fields: Column) -> Column:
    """Hash of a structure's JSON form, marked as an analyzer input."""
    return F.concat(F.lit("spa_"), F.sha2(F.to_json(fields), 256))


def classify_error(message: Column) -> Column:
    text, out = F.lower(F.coalesce(message, F.lit(""))), None
    for kind, words in ERROR_WORDS:
        out = F.when(holds_any(text, words), kind) if out is None else out.when(holds_any(text, words), kind)
    return out.otherwise("unknown_error")


def retries_with(kind: Column) -> Column:
    """What the key rotation does on an error: next_key, same_key or stop."""
    return F.when(kind.isin("quota_exhausted", "auth_error"), "next_key").when(kind.isin("rate_limited", "network_timeout"), "same_key").otherwise("stop")


def backoff_seconds(failures: Column) -> Column:
    """Wait before the retry after so many rate-limit failures in a row (1, 2, ...): 5 doubling, at most 120."""
    return F.least(F.lit(120), F.lit(5) * F.pow(F.lit(2), failures - 1)).cast("int")


def budget_chars(model: str) -> int:
    return int(MODEL_TOKENS.get(model, 10_000) * 4 * 0.80)


def result_comment(description: Column, tags: Column, warnings: Column, confidence: Column, category: Column) -> Column:
    """One line for an analyst: description, tags, up to two warnings, confidence and category where known."""
    some = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    return F.concat(
        F.lit("[AI] "),
        F.concat_ws(
            " | ",
            F.when(F.coalesce(description, F.lit("")) != "", description),
            F.when(some(tags), F.concat(F.lit("["), F.array_join(tags, ","), F.lit("]"))),
            F.when(some(warnings), F.concat(F.lit("[!] "), F.array_join(F.slice(warnings, 1, 2), "; "))),
            F.concat(F.lit("conf="), F.format_string("%.2f", F.coalesce(confidence, F.lit(0.0)))),
            F.when((F.coalesce(category, F.lit("")) != "") & (category != "UNKNOWN"), F.concat(F.lit("cat="), category)),
        ),
    )


def struct_text(name: Column, confidence: Column, fields: Column) -> Column:
    """A C structure from array<struct<offset,name,type,purpose>>, fields by offset."""
    title = sanitize_name(F.coalesce(name, F.lit("inferred_struct")))

    def line(f):
        named = F.coalesce(f["name"], F.concat(F.lit("field_"), F.lower(F.hex(f["offset"].cast("long")))))
        note = F.concat(F.lit("  // +0x"), F.lpad(F.lower(F.hex(f["offset"].cast("long"))), 2, "0"), F.when(F.coalesce(f["purpose"], F.lit("")) != "", F.concat(F.lit(" "), f["purpose"])).otherwise(""))
        return F.concat(F.lit("    "), F.rpad(F.coalesce(f["type"], F.lit("DWORD")), 10, " "), F.lit(" "), sanitize_name(named), F.lit(";"), note)

    head = F.format_string("// Inferred structure  (confidence=%.2f)", F.coalesce(confidence, F.lit(0.0)))
    return F.concat_ws("\n", head, F.concat(F.lit("typedef struct _"), title, F.lit(" {")), F.array_join(F.transform(F.array_sort(fields), line), "\n"), F.concat(F.lit("} "), title, F.lit(";")))


def check_prototype(prototype: Column, function: Column) -> Column:
    """The prototype, closed by one semicolon, if it is one line of at most 300 characters that declares the function; else empty."""
    proto = F.concat(F.regexp_replace(F.trim(F.coalesce(prototype, F.lit(""))), ";+$", ""), F.lit(";"))
    quoted = F.concat(F.lit(r"(^|\W)\Q"), function, F.lit(r"\E(\W|$)"))
    fine = ~F.contains(proto, F.lit("\n")) & (F.length(proto) <= 300) & F.contains(proto, F.lit("(")) & F.contains(proto, F.lit(")"))
    fine = fine & F.rlike(proto, quoted) & ~F.lower(proto).rlike(r"typedef|#include|[{}]")
    return F.when(fine, proto).otherwise("")


def proposal_confidence(confidence: Column, least_child: Column) -> Column:
    """A parent's confidence, held down by its least certain pending child; unchanged without one."""
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5))))
    return F.when(least_child.isNull(), F.coalesce(confidence, F.lit(0.5))).otherwise(F.round(F.least(own, F.lit(0.60) + F.lit(0.40) * least_child), 3))
