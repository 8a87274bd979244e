"""Embeddings as vectors of whole numbers, on which scores and distances are exact; tables written between rounds."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Components outside +-LARGEST are set to it: products of two still add up in 64 bits, and in doubles without rounding.
LARGEST = 1 << 20


def integer_vectors(vectors: DataFrame, factor: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, *extra, v) with v = floor(factor * component), array<long>, of the rows whose vector can be compared.

    Rows with a null or empty vector, or with a null, NaN or infinite component, take no part. Components are set to +-LARGEST where
    they pass it.
    """
    plain = F.col("embedding").cast("array<double>")
    good = (F.size(plain) > 0) & F.forall(plain, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(plain, lambda x: F.least(F.greatest(F.floor(x * factor), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long"))
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), *extra, whole.alias("v"))


def one_per_id(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each vec_id, which names it: of several the smallest (*extra, v). Rows without vec_id go."""
    least = F.min(F.struct(*extra, "v")).alias("_least")
    return rows.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(least).select("vec_id", *[F.col(f"_least.{c}").alias(c) for c in (*extra, "v")])


def matrix(column, dtype=np.int64) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1).astype(dtype, copy=False) if len(whole) else np.zeros((0, 0), dtype)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read back; and the table's path. Readers get only the columns they use."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """The table at path goes, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
