"""SimHash near-dedup with pigeonring filtering.

A fingerprint's 64 bits lie on a ring of five segments. If two fingerprints differ in at most 2 bits, some segment starts a chain
whose cumulative differences stay within the proportional budgets floor(2 * length / 5) = 0, 0, 1, 1, 2. So the first two segments of
that chain are equal: they are the key that candidates meet by, 25 or 26 bits wide. Candidates then must keep the rest of the
chain within its budgets, and only those that do meet the full Hamming check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpointed, releasing, table
from .components import components

BITS, BUDGET = 64, 2
#: (lowest bit, width) of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints in a cell; a bucket is dealt to as many as it needs, and each cell meets each.
CELL = 1000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of a text: majority of XXH64 over word shingles; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    packed = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(packed[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs plus _fp, the fingerprint's 64 bits as a long. Null texts count as empty."""
    at, names = docs.columns.index("text"), [*docs.columns, "_fp"]

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names)

    return docs.mapInArrow(releasing(run), StructType([*docs.schema.fields, StructField("_fp", LongType())]))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of docs."""
    return with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, seed).select("doc_id", F.col("_fp").alias("fp"))


def _segment(fp: Column, i: int) -> Column:
    low, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _key(fp: Column, i: int) -> Column:
    """The chain's first two segments and its start, as one number."""
    pair = F.shiftleft(_segment(fp, i), SEGMENTS[(i + 1) % len(SEGMENTS)][1]).bitwiseOR(_segment(fp, i + 1))
    return pair * len(SEGMENTS) + i


def _in_chain(x: Column, y: Column, start: Column) -> Column:
    """Whether the chain from segment `start`, whose first two are equal, keeps within its budgets."""
    apart, out = x.bitwiseXOR(y), None
    for i in range(len(SEGMENTS)):
        total, within = F.lit(0), F.lit(True)
        for length in range(3, len(SEGMENTS)):
            total = total + F.bit_count(_segment(apart, i + length - 1))
            within = within & (total <= BUDGET * length // len(SEGMENTS))
        out = F.when(start == i, within) if out is None else out.when(start == i, within)
    return out


def fingerprint_links(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b), a < b, between the distinct fingerprints `fp` that differ in at most 2 bits: all of them, each once.

    A fingerprint lies in one bucket for each start of a chain. Every bucket is dealt to ceil(size / cell) cells and each pair of cells
    meets in a task of its own, so a crowded bucket is spread and no task holds it whole. A fingerprint has at most 2080 links.
    """
    keyed = prints.select("fp", F.explode(F.array(*[_key(F.col("fp"), i) for i in range(len(SEGMENTS))])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / cell).cast("int").alias("cells"))
    rows = keyed.join(sizes, "key").withColumn("cell", F.pmod(F.xxhash64("fp", "key"), F.col("cells")).cast("int"))
    rows = checkpointed(rows)
    x = rows.select("key", F.col("cell").alias("c"), F.explode(F.sequence("cell", F.col("cells") - 1)).alias("d"), F.col("fp").alias("a"))
    y = rows.select(F.col("key").alias("_k"), F.explode(F.sequence(F.lit(0), "cell")).alias("_c"), F.col("cell").alias("_d"), F.col("fp").alias("b"))
    once = (F.col("c") < F.col("d")) | (F.col("a") < F.col("b"))
    start = F.pmod(F.col("key"), F.lit(len(SEGMENTS)))
    met = x.join(y, (x["key"] == y["_k"]) & (F.col("c") == F.col("_c")) & (F.col("d") == F.col("_d")) & once & _in_chain(F.col("a"), F.col("b"), start))
    near = met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BUDGET)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) of every distinct fingerprint in rows (doc_id, fp); root names its component."""
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(fingerprint_links(prints))
    named = checkpointed(prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "n", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of docs; component_id is the smallest doc_id reachable by links.

    Copies collapse to one fingerprint before any comparison. Null texts and texts without words have fingerprint 0 and
    link like any other; rows whose component has only null ids get a null component_id; repeated rows are all returned.
    """
    rows = checkpointed(fingerprints(docs, shingle, seed))
    return attach(rows, classes(rows), "fp")


def attach(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows joined to the one row of `named` for their key; rows of keys held by many (column n) are spread by salt.

    A key counts as hot from a 500th of all rows on, so at most 500 of them are broadcast.
    """
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = named.filter(F.col("n") >= max(2000, total // 500))
    marked = rows.join(F.broadcast(hot.withColumnRenamed(key, "_hot").drop("n")), F.col(key) == F.col("_hot"), "left")
    given = [c for c in named.columns if c not in (key, "n")]
    near = marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, *given)
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(named.drop("n"), key)
    return near.unionByName(rest.select(*near.columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component one row with its smallest doc_id stays.

    Rows that share a doc_id but not a component each stand for their own. Rows without doc_id stay: nothing names them.
    """
    found = near_duplicates(docs)
    kept = checkpointed(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")))
    nameless = docs.filter("doc_id IS NULL")
    once = docs.join(kept.filter("_n = 1").select("_id"), docs["doc_id"] == F.col("_id"), "left_semi").unionByName(nameless)
    if kept.filter("_n > 1").isEmpty():
        return once
    again = with_fingerprint(docs.join(kept.filter("_n > 1").select("_id"), docs["doc_id"] == F.col("_id"), "left_semi"))
    roots = found.filter("doc_id = component_id").select(F.col("fp").alias("_of"), F.col("root").alias("_root"), F.col("component_id").alias("_least")).distinct()
    again = again.join(roots, (F.col("_fp") == F.col("_of")) & (F.col("doc_id") == F.col("_least"))).dropDuplicates(["doc_id", "_root"])
    return once.unionByName(again.select(*docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
