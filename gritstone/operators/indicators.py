"""Indicators of compromise: extraction from texts, merging of sources, counts and the text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import saved

# A pattern for each indicator type. Case is ignored where the pattern begins with (?i); digits are ASCII.
PATTERNS = {
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b",
    "domain": r"(?i)\b(?:[a-zA-Z0-9\-]+\.)+(?:com|net|org|io|ru|cn|de|uk|onion|xyz|top|info|cc|tk|biz|site|club|online|tech|pro|pw|me|in|fr|jp|br|au|gov|edu|mil|int|arpa|mobi|name|travel|coop|aero|museum)\b",
    "url": r"(?i)(?:https?|ftp)://[^\s\"'<>\x00-\x1f]{5,250}",
    "win_path": r"[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*",
    "unc_path": r"\\\\[a-zA-Z0-9\-_\.]+(?:\\[^\\\s]+)+",
    "registry": r"(?i)(?:HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKEY_CLASSES_ROOT|HKEY_USERS|HKEY_CURRENT_CONFIG|HKLM|HKCU|HKCR|HKU|HKCC)\\[^\s\"'\x00-\x1f]{3,200}",
    "mutex": r"\bGlobal\\[a-zA-Z0-9_\-\{\}]{4,80}\b",
    "user_agent": r"(?i)Mozilla/[0-9]\.[0-9][^\r\n\"]{10,150}",
    "base64": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])",
    "pe_artifact": r"(?i)\b[^\s\"']{3,80}\.(?:exe|dll|sys|drv|ocx|scr|bat|cmd|ps1|vbs|vbe|js|jse|wsf|wsh|msi|cab|inf|reg)\b",
    "env_var": r"(?i)%(?:APPDATA|LOCALAPPDATA|TEMP|TMP|WINDIR|SYSTEMROOT|PROGRAMFILES|USERPROFILE|COMSPEC|PUBLIC|ALLUSERSPROFILE|USERNAME|USERDOMAIN|COMPUTERNAME|SystemDrive|SystemRoot)%?",
    "email": r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b",
}
#: What every match of a type holds, cheap to look for: literals, or a pattern that hardly ever has to try twice at one place. A text
#: without it is not searched for the type.
NEEDS = {
    "ipv4": r"\d\.\d",
    "ipv6": r"[0-9a-fA-F:]:[0-9a-fA-F:]",
    "domain": r"(?i)[a-z0-9\-]\." + PATTERNS["domain"].partition(r"+\.)+")[2],
    "url": ("://",),
    "win_path": (":\\",),
    "unc_path": ("\\\\",),
    "registry": ("\\",),
    "mutex": ("Global\\",),
    "user_agent": r"(?i)mozilla/",
    "base64": r"[A-Za-z0-9+/]{40}",
    "pe_artifact": r"(?i)" + PATTERNS["pe_artifact"].partition("{3,80}")[2],
    "env_var": ("%",),
    "email": ("@",),
}
# The order of types in the text report.
REPORT_ORDER = ("url", "domain", "ipv4", "ipv6", "win_path", "unc_path", "registry", "mutex", "user_agent", "pe_artifact", "email", "env_var", "base64")


def is_indicator(kind: Column, value: Column) -> Column:
    """False for the usual false positives of a type."""
    bad = F.when(kind == "ipv4", value.rlike(r"^(0\.0\.0\.|127\.0\.|255\.255\.|169\.254\.)"))
    bad = bad.when(kind == "base64", value.rlike("^(AAAA|////|MMMM)") | (F.size(F.array_distinct(F.split(value, ""))) < 6))
    bad = bad.when(kind == "domain", value.rlike(r"^\d+\.\d+\."))
    return (value != "") & ~F.coalesce(bad, F.lit(False))


def found_in(text: Column, types=tuple(PATTERNS)) -> Column:
    """Array of (type, value) of all matches in a text; a pattern runs only where the text has what all its matches need.

    `\\b` and `\\w` know ASCII letters, digits and the underscore only, so a match may begin or end beside an accented letter.
    """
    lists = [_labelled(t, F.when(_may_hold(text, t), F.regexp_extract_all(text, F.lit(PATTERNS[t]), F.lit(0))).otherwise(F.array().cast("array<string>"))) for t in types]
    return F.concat(*lists) if len(lists) > 1 else lists[0]


def _may_hold(text: Column, kind: str) -> Column:
    needs = NEEDS[kind]
    return text.rlike(needs) if isinstance(needs, str) else F.contains(text, F.lit(needs[0]))


def _labelled(kind: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("type"), F.trim(v).alias("value")))


def extract(df: DataFrame, text: str = "text", keys: tuple[str, ...] = (), types=tuple(PATTERNS)) -> DataFrame:
    """(*keys, type, value): the distinct indicators of each key (of the whole table without keys)."""
    hits = df.select(*keys, F.explode(found_in(F.col(text), types)).alias("hit")).select(*keys, "hit.type", "hit.value")
    return hits.filter(is_indicator(F.col("type"), F.col("value"))).distinct()


def merge_sources(*tagged: tuple[DataFrame, str, str], types=tuple(PATTERNS)) -> DataFrame:
    """(type, value, source, sources) over (frame, text column, source tag) triples; source is the first of the sorted sources."""
    hits = None
    for df, text, source in tagged:
        one = extract(df, text, types=types).withColumn("tag", F.lit(source))
        hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy("type", "value").agg(F.sort_array(F.collect_set("tag")).alias("sources"))
    return merged.select("type", "value", F.get("sources", F.lit(0)).alias("source"), "sources")


def from_records(records: DataFrame, source: str = "floss_decoded") -> DataFrame:
    """(type, value, source, sources) of decoded-string records (string): each value of a type once, under one source tag."""
    return merge_sources((records, "string", source))


def type_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.countDistinct("value").alias("n"))


def report_lines(merged: DataFrame, known: int = 30, other: int = 10) -> DataFrame:
    """(section, line_no, line): a heading for each type, its first values and a line that counts the rest.

    Values are counted by groups, and only the first of each type are ordered: tasks drop the others before they meet.
    """
    merged = saved(merged.select("type", "value", "sources"))
    order = F.array_position(F.array(*[F.lit(t) for t in REPORT_ORDER]), F.col("type"))
    section = F.when(order > 0, order).otherwise(len(REPORT_ORDER) + 1)
    limit = F.when(order > 0, known).otherwise(other)
    nth = F.row_number().over(Window.partitionBy("type").orderBy("value"))
    first = merged.withColumn("rn", nth).filter(F.col("rn") <= max(known, other) + 1)
    sizes = merged.groupBy("type").agg(F.count("*").alias("n"))
    ranked = first.join(sizes, "type").withColumns({"section": section, "limit": limit}).filter("rn <= limit + 1")
    line = lambda at, text: F.struct(at.cast("int").alias("line_no"), text.alias("line"))
    body = F.when(F.col("rn") <= F.col("limit"), line(F.col("rn"), F.concat(F.lit("  "), F.col("value"), F.lit("  ["), F.array_join("sources", ","), F.lit("]"))))
    head = F.when(F.col("rn") == 1, line(F.lit(0), F.concat(F.lit("["), F.upper("type"), F.lit("] ("), F.col("n"), F.lit(")"))))
    rest = F.when((F.col("rn") > F.col("limit")) & (F.col("section") <= len(REPORT_ORDER)), line(F.lit(known + 1), F.concat(F.lit("  ... ("), F.col("n") - known, F.lit(" more)"))))
    return ranked.select("section", "type", F.explode(F.array_compact(F.array(head, body, rest))).alias("l")).select("section", "type", "l.line_no", "l.line")
