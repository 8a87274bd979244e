"""Decoded-string files: JSON in several layouts, or plain text, normalised to one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import bound, parse_address

# Keys under which records, texts and addresses are found, in order of preference.
KINDS = ("static_strings", "stack_strings", "tight_strings", "decoded_strings")
TEXT_KEYS = ("string", "decoded_string", "value", "s")
ADDRESS_KEYS = ("address", "ea", "offset", "va", "virtual_address", "string_va", "decoded_at", "decoding_routine", "function", "function_va", "function_address")
FUNCTION_KEYS = ("function", "function_va", "function_address")
DETAIL_KEYS = ("decoder", "encoding", "location_type")

#: Longest file that is opened, in bytes; a task holds one file at a time.
LONGEST = 256 << 20


# All fields of a record as texts, and the texts in one that is itself an object.
FIELDS = "struct<" + ", ".join(f"`{k}`: string" for k in dict.fromkeys((*TEXT_KEYS, *ADDRESS_KEYS, *FUNCTION_KEYS, *DETAIL_KEYS))) + ">"
NESTED = "struct<" + ", ".join(f"`{k}`: string" for k in TEXT_KEYS) + ">"


def _record(v: Column, f: Column, kind: Column) -> Column:
    """A record from its JSON v and f, that JSON's FIELDS. Written short: generated code for each key and reading was too long to compile."""
    inner = lambda k: bound(F.try_variant_get(v, f"$.{k}", NESTED), lambda n: F.coalesce(*[n[j] for j in TEXT_KEYS]))
    nested = [F.when(~F.startswith(f[k], F.lit("{")), f[k]).when(f[k].isNotNull(), inner(k)) for k in TEXT_KEYS]
    number = lambda keys: F.try_element_at(F.array_compact(F.transform(F.array_compact(F.array(*[f[k] for k in keys])), parse_address)), F.lit(1))
    detail = F.coalesce(*[F.nullif(f[k], F.lit("")) for k in DETAIL_KEYS])
    plain = F.when(f.isNull() & (F.schema_of_variant(v) == "STRING"), F.try_variant_get(v, "$", "string"))
    return F.struct(F.coalesce(plain, *nested).alias("string"), kind.alias("kind"), number(ADDRESS_KEYS).alias("address"), number(FUNCTION_KEYS).alias("function_ea"), F.substring(detail, 1, 80).alias("detail"))


def _lists(v: Column) -> Column:
    """The lists of a document: (kind, items), items null where there is none. A list is one of decoded strings; an object has lists by
    kind, at its top or under `strings`, else under decoded, results or strings."""
    lists = [F.struct(F.lit("decoded_strings").alias("kind"), F.try_variant_get(v, "$", "array<variant>").alias("items"))]
    lists += [F.struct(F.lit(k).alias("kind"), F.coalesce(F.try_variant_get(v, f"$.strings.{k}", "array<variant>"), F.try_variant_get(v, f"$.{k}", "array<variant>")).alias("items")) for k in KINDS]
    rest = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("decoded", "results", "strings")])
    named = F.filter(F.array(*lists), lambda x: x["items"].isNotNull())
    return bound(named, lambda n: F.when(F.size(n) > 0, n).otherwise(F.array(F.struct(F.lit("decoded_strings").alias("kind"), rest.alias("items")))))


def _line_record(line: Column) -> Column:
    """A plain line's record, a leading address read; null for comments, banners and headings."""

    def read(trimmed: Column) -> Column:
        told = (trimmed != "") & ~trimmed.rlike("^(#|FLOSS|WARNING|INFO)") & ~trimmed.rlike("(?i):$|strings:")
        head = F.regexp_extract(trimmed, r"^(\S+)\s+\S", 1)
        return F.when(told, bound(F.when(head != "", parse_address(F.rtrim(head, F.lit(":")))), lambda address: record(trimmed, address)))

    def record(trimmed: Column, address: Column) -> Column:
        text = F.when(address.isNotNull(), F.regexp_extract(trimmed, r"^\S+\s+(.*)$", 1)).otherwise(trimmed)
        return F.struct(F.regexp_replace(text, "^[ \"']+|[ \"']+$", "").alias("string"), F.lit("text_output").alias("kind"), address.alias("address"), F.lit(None).cast("long").alias("function_ea"), F.lit(None).cast("string").alias("detail"))

    return bound(F.regexp_replace(line, r"^\s+|\s+$", ""), read)


def _json_items(lists: Column) -> Column:
    item = lambda kind, x, at: F.struct(at.cast("long").alias("ord"), kind.alias("kind"), x.alias("json"), F.lit(None).cast("string").alias("line"))
    return F.flatten(F.transform(F.filter(lists, lambda l: l["items"].isNotNull()), lambda l, i: F.transform(l["items"], lambda x, j: item(l["kind"], x, i * F.lit(1_000_000_000) + j))))


def _text_items(text: Column) -> Column:
    return F.transform(F.split(text, "\r\n|[\n\r]"), lambda x, j: F.struct(j.cast("long").alias("ord"), F.lit("text_output").alias("kind"), F.lit(None).cast("variant").alias("json"), x.alias("line")))


def _records(items: DataFrame, least: int) -> DataFrame:
    """Records of (doc, problem, items), one for each (string, address, kind) of a document, and a row for each problem."""
    mark = F.when(F.col("problem").isNotNull(), F.array(F.lit(None).cast(items.schema["items"].dataType.elementType)))
    none = F.array().cast(items.schema["items"].dataType)
    rows = items.select("doc", "problem", F.explode(F.concat(F.coalesce(mark, none), F.coalesce("items", none))).alias("i")).withColumn("problem", F.when(F.col("i").isNull(), F.col("problem")))
    json = F.col("i.json")
    rows = rows.select("doc", "i", "problem", F.try_variant_get(json, "$", FIELDS).alias("_f"))
    record = F.when(json.isNotNull(), _record(json, F.col("_f"), F.col("i.kind"))).otherwise(_line_record(F.col("i.line")))
    rows = rows.select("doc", F.col("i.ord").alias("ord"), record.alias("r"), "problem").select("doc", "ord", "r.*", "problem")
    return _once(rows.filter((F.length("string") >= least) | F.col("problem").isNotNull()))


def parse_json_text(df: DataFrame, column: str = "raw", least: int = 4) -> DataFrame:
    """(doc, ord, string, kind, address, function_ea, detail) from (doc, raw) rows that hold JSON; other rows give nothing.

    One row for each (string, address, kind) of a document.
    """
    rows = df.select("doc", F.try_parse_json(F.col(column)).alias("v")).filter("v IS NOT NULL")
    return _records(rows.select("doc", F.lit(None).cast("string").alias("problem"), _json_items(_lists(F.col("v"))).alias("items")), least).drop("problem")


def parse_plain_text(df: DataFrame, column: str = "raw", least: int = 4) -> DataFrame:
    """The same columns from (doc, raw) rows of plain lines: comments, banners and headings go, a leading address is read."""
    return _records(df.select("doc", F.lit(None).cast("string").alias("problem"), _text_items(F.col(column)).alias("items")), least).drop("problem")


def _once(rows: DataFrame) -> DataFrame:
    first = Window.partitionBy("doc", "string", "address", "kind").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def parse_any(df: DataFrame, column: str = "raw", least: int = 4) -> DataFrame:
    """JSON where it parses, else text; each document is parsed once."""
    rows = df.select("doc", F.col(column).alias("_raw"), F.try_parse_json(F.col(column)).alias("v"))
    items = F.when(F.col("v").isNotNull(), _json_items(_lists(F.col("v")))).otherwise(_text_items(F.col("_raw")))
    return _records(rows.select("doc", F.lit(None).cast("string").alias("problem"), items.alias("items")), least).drop("problem")


def parse_reported(files: DataFrame, least: int = 4) -> DataFrame:
    """Records of (path, content, length) rows with their problem; content null: a file too long to be read.

    (doc, ord, string, kind, address, function_ea, detail, problem): rows of records have a null problem, a file with a problem has one row
    with nothing else: too_long, empty (blank), broken_json (begins like JSON and does not parse), no_lists (JSON without any), not_utf8
    (its records follow all the same, with U+FFFD for what is no UTF-8).
    """
    text = F.col("content").cast("string")
    rows = files.select(F.col("path").alias("doc"), F.col("content").isNull().alias("_long"), F.is_valid_utf8(text).alias("_valid"), F.regexp_replace(F.make_valid_utf8(text), "^\ufeff", "").alias("_raw"))
    rows = rows.select("*", F.try_parse_json("_raw").alias("v")).select("*", F.when(F.col("v").isNotNull(), _lists(F.col("v"))).alias("_lists"))
    problem = F.when(F.col("_long"), "too_long").when(~F.col("_raw").rlike(r"\S"), "empty")
    problem = problem.when(F.col("v").isNull() & F.col("_raw").rlike(r"^\s*(\{|\[\s*[\[{\"\]])"), "broken_json")
    problem = problem.when(F.col("v").isNotNull() & ~F.exists("_lists", lambda x: x["items"].isNotNull()), "no_lists").when(~F.col("_valid"), "not_utf8")
    items = F.when(F.col("v").isNotNull(), _json_items(F.col("_lists"))).otherwise(_text_items(F.col("_raw")))
    rows = rows.select("doc", problem.alias("problem"), "_lists", "_raw", "v")
    return _records(rows.select("doc", "problem", F.when(F.col("problem").isNull() | (F.col("problem") == "not_utf8"), items).alias("items")), least)


def files_at(spark: SparkSession, path: str, longest: int = LONGEST, stream: bool = False, **options) -> DataFrame:
    """(path, content, length) of all files under path, as a table or, with stream, as a stream of new files.

    options are those of Spark's file readers (pathGlobFilter, modifiedAfter, recursiveFileLookup, maxFilesPerTrigger). Files over `longest` bytes have a
    null content and are never opened: both halves push their test of the length into the scan.
    """
    found = (spark.readStream if stream else spark.read).format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").options(**options).load(path)
    short = found.filter(F.col("length") <= longest).select("path", "content", "length")
    return short.unionByName(found.filter(F.col("length") > longest).select("path", F.lit(None).cast("binary").alias("content"), "length"))


def follow_files(spark: SparkSession, path: str, root: str, checkpoint: str, longest: int = LONGEST, least: int = 4, trigger: dict | None = None, **options) -> StreamingQuery:
    """Keeps the records of all files that arrive under path as Parquet under root, one folder for each micro-batch.

    A micro-batch that runs again after a lost driver replaces its own folder, so no file counts twice. By default the stream takes
    what is there and ends. `problem` tells of files that could not be read; they stop nothing.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        parse_reported(batch, least).write.mode("overwrite").parquet(f"{root}/batch={epoch}")

    found = files_at(spark, path, longest, stream=True, **options)
    return found.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_files(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """All decoded-string files under a path any Spark reader opens; doc is the file. What cannot be read gives no rows: see parse_reported."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("raw"))
    return parse_any(files, "raw", least)


def load_cache(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """The decoded strings stored at path; none where there is nothing or nothing that can be read."""
    try:
        return read_files(spark, path, least)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "doc string, ord long, string string, kind string, address long, function_ea long, detail string")


def store_cache(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Records (string, kind, address, function_ea, detail) as JSON lists that load_cache reads, each once; a file holds some per_file of them.

    Only a record with a function but no address reads back otherwise: readers take the function for its address.
    """
    once = records.select("string", "kind", "address", "function_ea", "detail").distinct()
    parts = once.count() // per_file + 1
    item = F.to_json(F.struct("string", F.col("address").cast("string").alias(ADDRESS_KEYS[0]), F.col("function_ea").cast("string").alias(FUNCTION_KEYS[0]), F.col("detail").alias(DETAIL_KEYS[0])))
    part = F.pmod(F.xxhash64("string", "address", "function_ea", "detail"), F.lit(parts))
    lists = once.groupBy("kind", part.alias("_part")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    whole = lists.select(F.concat(F.lit('{"strings": {"'), "kind", F.lit('": ['), "items", F.lit("]}}")).alias("value"), F.col("kind").alias("_kind"), "_part")
    # a folder for each list, so that a file is one JSON text
    whole.write.mode("overwrite").partitionBy("_kind", "_part").text(path)
