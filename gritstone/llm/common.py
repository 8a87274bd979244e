"""Shared pieces: cut lineage in the cluster's folder, exact distributed running totals, per-process caches."""

from __future__ import annotations

import sys
import tempfile
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+`: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only where a local session names none (tests); else that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gritstone-"))
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder; survives lost executors and cuts the lineage."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def process_cache() -> dict:
    """A dictionary that lives as long as this Python process, shared by all tasks it runs."""
    return sys.modules.setdefault("_gritstone_process_cache", types.ModuleType("_gritstone_process_cache")).__dict__


def releasing(run):
    """run (a mapInArrow function) that gives freed memory back to the system when a task ends; workers live on between tasks."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # not glibc

    return task


def two_generations(limit: int):
    """A bounded word cache: (young, old) dictionaries; when the young one is full it becomes the old one."""

    class Cache(dict):
        def __init__(self):
            self.old: dict = {}

        def age(self):
            if len(self) >= limit:
                self.old = dict(self)
                self.clear()

    return Cache()


def text_slices(batch, column: int, most: int = 2 << 20):
    """(slice of the batch, its texts as Python strings), about `most` UTF-8 bytes at a time; a longer text comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        part = batch.slice(start, stop - start)
        yield part, part.column(column).to_pylist()
        start = stop


def bits_for(rows: int, rows_per_bucket: int, most: int = 24) -> int:
    """So many leading bits of a uniform key that a bucket holds about rows_per_bucket rows."""
    k = 0
    while k < most and rows >> k > rows_per_bucket:
        k += 1
    return k


def running_totals(df: DataFrame, part: list[str], bucket: list[str], order: list[Column], values: dict[str, str]) -> DataFrame:
    """Exact exclusive running sums of each value column (new column: old column) within part, over (bucket, order).

    Two levels: totals by bucket (pre-aggregated), a window over those few totals, and a window inside each bucket.
    No task sees more than one bucket of rows, or the bucket totals of one part.
    """
    keys = part + bucket
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    over = Window.partitionBy(*part).orderBy(*[F.col(c).asc_nulls_first() for c in bucket]).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*[F.col(c).alias(f"_k_{i}") for i, c in enumerate(keys)], *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_h_{n}") for n in values])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in values.items()})
    on = None
    for i, c in enumerate(keys):
        same = rows[c].eqNullSafe(heads[f"_k_{i}"])
        on = same if on is None else on & same
    out = rows.join(heads, on, "inner") if keys else rows.crossJoin(heads)
    return out.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_h_{n}")).alias(n) for n in values])
