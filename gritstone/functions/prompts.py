"""Texts of requests to models: instructions in this package's own words, and builders for the kinds of request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = 'Answer with one JSON object: {"name", "confidence" from 0 to 1, "category", "description", "evidence": [...], "warnings": [...], "tags": [...]}.'
#: How bold a name may be, by naming mode.
MODES = {
    "conservative": "Name each function for what its code visibly does. Avoid words that claim intent unless the code proves it; if unsure, choose a general name and a low confidence.",
    "malware": "Names may state malicious purpose where at least two separate facts in the code support it; list those facts as evidence.",
    "blog": "Choose readable names that could stand in a published write-up, each backed by evidence from the code.",
}
ANALYZE = 'Explain the function. Answer with one JSON object: {"function_name", "confidence", "priority", "category", "summary", "technical_behavior", "evidence", "data_flows", "called_behaviors", "warnings", "rename_recommendation": {"apply", "name", "reason"}, "analyst_notes"}.'
RANGE = 'Task: range\nExplain this piece of code. Answer with one JSON object: {"summary", "evidence", "warnings"}.'
PROGRAM = 'Task: program\nSay what the whole program is for. Answer with one JSON object: {"summary", "capabilities", "evidence", "risk"}.'
STRUCTURE = 'Task: structure\nInfer the structure behind these accesses. Answer with one JSON object: {"struct_name", "confidence", "fields": [{"offset", "name", "type", "purpose"}]}.'
PROTOTYPE = 'Task: prototype\nGive the function its C prototype, on one line. Answer with one JSON object: {"prototype", "confidence", "reason"}.'
VARIABLES = 'Task: variables\nGive local variables better names. Answer with one JSON object: {"variables": [{"old_name", "new_name", "confidence", "reason"}]}.'


def instruction(mode: str) -> str:
    """The instruction of a naming mode; that of conservative for any other word."""
    return f"{MODES.get(mode, MODES['conservative'])}\n{ANSWER}"


def _listed(values: Column, most: int, sep: str = ", ") -> Column:
    return F.array_join(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, most), sep)


def _fenced(text: Column) -> Column:
    return F.concat(F.lit("```\n"), F.coalesce(text, F.lit("")), F.lit("\n```"))


def _code(text: Column, most: int) -> Column:
    return _fenced(F.substring(text, 1, most))


def range_request(code: Column) -> Column:
    """The whole piece of code, however long."""
    return F.concat(F.lit(f"{RANGE}\n"), _fenced(code))


def program_request(text: Column) -> Column:
    return F.concat(F.lit(f"{PROGRAM}\n"), F.substring(text, 1, 6000))


def structure_request(name: Column, offsets: Column, strings: Column, apis: Column, code: Column, most: int = 24) -> Column:
    """For the offsets a function reads or writes; strings, APIs and code only where there are any."""
    some = lambda title, values, n, sep: F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{title}: "), _listed(values, n, sep)))
    each = F.transform(F.slice(F.array_sort(F.array_distinct(offsets)), 1, most), lambda o: F.concat(F.lit("0x"), F.lower(F.hex(o.cast("long"))), F.lit(" (+"), o.cast("string"), F.lit(")")))
    return F.concat_ws("\n", F.lit(STRUCTURE), F.concat(F.lit("Function: "), name), F.concat(F.lit("Offsets: "), F.array_join(each, ", ")), some("Strings", strings, 6, "; "), some("APIs", apis, 8, ", "), F.when(F.coalesce(code, F.lit("")) != "", _code(code, 2000)))


def prototype_request(c: dict[str, Column]) -> Column:
    """c: name, callers, callees, apis, strings, decoded, constants, pre_tags, code."""
    lines = [F.concat(F.lit(f"{title}: "), _listed(c[key], n, sep)) for title, key, n, sep in (("Callers", "callers", 12, ", "), ("Callees", "callees", 20, ", "), ("APIs", "apis", 20, ", "), ("Strings", "strings", 10, "; "), ("Decoded strings", "decoded", 8, "; "), ("Constants", "constants", 16, ", "), ("Tags", "pre_tags", 50, ", "))]
    return F.concat_ws("\n", F.lit(PROTOTYPE), F.concat(F.lit("Function: "), c["name"]), *lines, _code(c["code"], 7500))


def variables_request(name: Column, variables: Column, code: Column, most: int = 80) -> Column:
    """variables: array<struct<name,type,is_arg>>."""
    lines = F.transform(F.slice(variables, 1, most), lambda v: F.concat(F.lit("- "), v["name"], F.lit(" : "), v["type"], F.lit(" arg="), v["is_arg"].cast("string")))
    return F.concat_ws("\n", F.lit(VARIABLES), F.concat(F.lit("Function: "), name), F.lit("Local variables:"), F.array_join(lines, "\n"), _code(code, 7000))
