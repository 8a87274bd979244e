"""Tables of state and reports: read with a declared schema, written beside the old version and then named as current.

A version is one small file under _versions_json that names the table's files and is created only where there is none of its number; who
comes second starts again from the version that came first. Old files stay, so readers of an old version can go on.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "queue": "kind string, ea long, old_name string, suggested_name string, old_var string, new_var string, new_prototype string, confidence double, status string, dependency_level int, deps array<struct<ea:bigint,suggested_name:string>>, ts timestamp, ord long",
    "history": "batch_id string, ts timestamp, provider string, model string, ea long, kind string, old_name string, new_name string, confidence double",
    "cache": "key string, ts timestamp, old_name string, code_type string, result string",
    "blobs": "func_ea long, kind string, value string",
}


#: Buckets of a table that is changed by key; attempts to name a new version before a writer gives up.
BUCKETS, TRIES = 64, 8
#: Half seconds to wait for the content of a version that a writer has just created; one that stays empty was given up by its writer.
WAITS = 20
#: Writers of one process take turns, as a local disk does not create files exclusively; other stores do.
_NAMING = threading.Lock()


def _files(spark: SparkSession, path: str):
    """The file system that holds path, and path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, root: str, name: str) -> dict:
    """The current version of a table: number, key, and its files by bucket (-1: rows of all buckets); number 0 if there is none yet."""
    files, folder = _files(spark, f"{root}/{name}/_versions_json")
    numbers = [int(f.getPath().getName().partition(".")[0]) for f in (files.listStatus(folder) if files.exists(folder) else ()) if f.getPath().getName().endswith(".json")]
    if not numbers:
        return {"number": 0, "key": "", "files": {}}
    for number in sorted(numbers, reverse=True):
        for _ in range(WAITS):
            row = spark.read.schema("number long, key string, files map<string,string>").json(f"{root}/{name}/_versions_json/{number:020d}.json").first()
            if row is not None:
                return {"number": max(numbers), "key": row["key"], "files": {int(b): p for b, p in row["files"].items()}}
            time.sleep(0.5)
    return {"number": max(numbers), "key": "", "files": {}}


def _named(spark: SparkSession, root: str, name: str, number: int, key: str, files: dict[int, str]) -> bool:
    """Makes these files version `number`; False if another writer has taken it. The file is created only where there is none."""
    system, path = _files(spark, f"{root}/{name}/_versions_json/{number:020d}.json")
    try:
        with _NAMING:
            out = system.create(path, False)
            out.write(bytearray(json.dumps({"number": number, "key": key, "files": files}).encode()))
            out.close()
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def _read(spark: SparkSession, root: str, name: str, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(*[f"{root}/{name}/{p}" for p in sorted(paths)])


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a table, empty if there is none yet."""
    return _read(spark, root, name, list(manifest(spark, root, name)["files"].values()))


def save(df: DataFrame, root: str, name: str) -> None:
    """Write a whole new version, then name it as current; readers never see half a table, and df may read the old version."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}/{version}")
    for _ in range(TRIES):
        if _named(spark, root, name, manifest(spark, root, name)["number"] + 1, "", {-1: version}):
            return
    raise RuntimeError(f"{name} changes too often to be saved")


def fold(changes: DataFrame, root: str, name: str, key: str, merge, buckets: int = BUCKETS) -> int:
    """Rewrites the buckets (by hash of `key`) that changes touch as merge(their rows, changes); returns the new version's number.

    merge sees all rows whose key is in a touched bucket. Files of other buckets are neither read nor written; a table that was
    saved whole, or by another key, is dealt to buckets the first time. If another writer has named a version meanwhile, the
    merge is done again on that version, so no update is lost. merge may run more than once.
    """
    spark, by = changes.sparkSession, f"{key}/{buckets}"
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = {r[0] for r in changes.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` rows
    for _ in range(TRIES):
        now = manifest(spark, root, name)
        same = now["key"] == by
        old = {b: p for b, p in now["files"].items() if not same or b in touched}
        if not touched and same:
            return now["number"]
        version = f"v-{uuid.uuid4().hex}"
        merged = merge(_read(spark, root, name, list(old.values())), changes).withColumn("_bucket", bucket)
        merged.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{root}/{name}/{version}")
        system, folder = _files(spark, f"{root}/{name}/{version}")
        made = [f.getPath().getName() for f in system.listStatus(folder) if f.isDirectory()]
        files = {b: p for b, p in now["files"].items() if b not in old} | {int(m.partition("=")[2]): f"{version}/{m}" for m in made if m.startswith("_bucket=")}
        if _named(spark, root, name, now["number"] + 1, by, files):
            return now["number"] + 1
        system.delete(folder, True)
    raise RuntimeError(f"{name} changes too often to be folded")


def upsert(changes: DataFrame, root: str, name: str, key: str, gone: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Rows of changes replace all rows of the same key (null is a key); keys in gone (key) go. Untouched buckets are left as they are."""
    columns = changes.columns
    marked = changes.withColumn("_keep", F.lit(True))
    if gone is not None:
        marked = marked.unionByName(gone.select(key).distinct().withColumn("_keep", F.lit(False)), allowMissingColumns=True)

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        named = new.select(F.col(key).alias("_key")).distinct()
        kept = old.join(named, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        return kept.select(*columns).unionByName(new.filter("_keep").select(*columns))

    return fold(marked, root, name, key, merge, buckets)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw): one row per JSON or text answer file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key): the lines of a key file without blanks and comments."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias("key")).filter((F.col("key") != "") & ~F.startswith("key", F.lit("#")))


def write_artifacts(parts: dict[str, DataFrame], root: str) -> None:
    """Each part of an analysis (summary, call_graph, scores, suggestions, iocs, ...) as Parquet under its own folder."""
    for kind, df in parts.items():
        df.write.mode("overwrite").parquet(f"{root}/kind={kind}")


def html_table(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """One row, `html`: the first rows of df as an escaped table; df should be sorted and small."""
    from ..functions.names import escape_html

    cells = F.concat(*[x for c in columns for x in (F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))])
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    rows = df.limit(limit).select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("r"))
    return rows.agg(F.concat(F.lit(head), F.array_join(F.collect_list("r"), ""), F.lit("</table>")).alias("html"))
