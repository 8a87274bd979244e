"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source has a piecewise-linear weight schedule over training time 0..1. The schedule's integral is the source's
weight, from which its target follows; cumulative demand (target times the normalised integral) is inverted in closed form
to give every taken document the moment at which the mix consumes it, and documents are range-sorted by that position.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bits_for, checkpointed, running_totals, table

#: Knots (time, weight) of the schedules that sources take in turn; their integrals are 3, 1 and 2.
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def demand_time(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the share u (0..1) of a source's demand is met: the inverse of the schedule's integral."""
    whole, before, when = integral(knots), 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        x = u * F.lit(whole) - F.lit(before)
        # w0 s + (w1 - w0) s^2 / (2 d) = x for the time s since t0, in the form that also holds for w1 = w0
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2.0 * (w1 - w0) / (t1 - t0)) * x))
        s = F.lit(t0) + (x * F.lit(2.0)) / (F.lit(w0) + root)
        before += area
        when = F.when(u * F.lit(whole) <= F.lit(before), s) if when is None else when.when(u * F.lit(whole) <= F.lit(before), s)
    return when.otherwise(F.lit(knots[-1][0]))


def source_targets(totals: DataFrame, share: float, most: float, schedules=SCHEDULES) -> DataFrame:
    """(source, source_size, weight, kind, target): water-filling of share x all sizes under a ceiling of most x size.

    totals holds one row per source (source, source_size). With t = level x weight below the ceiling, the level is the
    largest of the levels obtained when the sources of smallest ceiling to weight are held at theirs.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kinds = totals.withColumn("kind", (rank % len(schedules)).cast("int"))
    weight = reduce(lambda w, k: w.when(F.col("kind") == k, F.lit(float(integral(schedules[k])))), range(1, len(schedules)), F.when(F.col("kind") == 0, F.lit(float(integral(schedules[0])))))
    kinds = kinds.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    fewer = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("ceiling").over(fewer), F.lit(0.0))
    held_weight = F.coalesce(F.sum("weight").over(fewer), F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - held) / (F.sum("weight").over(every) - held_weight)
    return kinds.withColumn("level", level).withColumn("level", F.max("level").over(every)).select("source", "source_size", "kind", "weight", F.least(F.col("ceiling"), F.col("level") * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, schedules=SCHEDULES, rows_per_bucket: int = 4096, named: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, position, again.

    taken is the number of words the mix takes of the document, all passes together; the document at which a source's
    target is met is taken in part. position and again are the training times (0..1) of its first and second pass, null
    where that pass takes nothing. Within a source, documents come in the order of a hash of doc_id, so reruns agree.
    Null texts have size 0 and are taken 0 times; a null source is a source of its own; a null doc_id sorts first;
    repeated rows are mixed one by one. most is at most 2 (two passes). With named, _h is a hash of each row's text.
    """
    hashed = [F.xxhash64("text").alias("_h")] if named else []
    slim = checkpointed(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(0)).alias("_order"), *hashed)
    )
    bits = bits_for(slim.count(), rows_per_bucket)
    slim = slim.withColumn("_bucket", F.shiftright("_order", 60 - bits).cast("int"))
    targets = checkpointed(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, schedules))
    placed = running_totals(slim, ["source"], ["_bucket"], [F.col("_order"), F.col("doc_id").asc_nulls_first(), F.col("size")], {"_before": "size"})
    joined = placed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor("target").cast("long")
    first = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("_before")))
    second = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("source_size") - F.col("_before")))

    def moment(taken: str, offset: Column) -> Column:
        u = (offset + F.col(taken) / F.lit(2.0)) / F.col("target")
        time = reduce(lambda w, k: w.when(F.col("kind") == k, demand_time(u, schedules[k])), range(1, len(schedules)), F.when(F.col("kind") == 0, demand_time(u, schedules[0])))
        return F.when(F.col(taken) > 0, time)

    return (
        joined.withColumns({"_first": first, "_second": second})
        .withColumns({"position": moment("_first", F.col("_before")), "again": moment("_second", F.col("_before") + F.col("source_size"))})
        .select("doc_id", "source", "size", "source_size", "target", (F.col("_first") + F.col("_second")).alias("taken"), "position", "again", *(["_h"] if named else []))
    )


def mix_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, schedules=SCHEDULES) -> DataFrame:
    """The mixed corpus with docs' columns, range-sorted by training position.

    A document comes once for each pass that takes at least half of it, so documents stay whole; those of which no pass
    does are beyond their source's target. Documents without words take nothing from any target: each comes once, before the others. Rows
    that share a doc_id are planned one by one; where they have equal text and source too, each gets one of their plans.
    """
    named = lambda df: df.withColumns({"_h": F.xxhash64("text"), "_source": F.col("source"), "_id": F.col("doc_id")})
    keys, own = ["_id", "_source", "_h"], ["_pid", "_psource", "_ph"]
    plan = plan_mix(docs, share, most, schedules, named=True)
    n = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + F.lit(0.5)).cast("int"))
    plan = plan.select(F.col("doc_id").alias("_pid"), F.col("source").alias("_psource"), F.col("_h").alias("_ph"), F.struct(n.alias("n"), "position", F.coalesce("again", "position").alias("again")).alias("_p"))
    same = lambda: reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(keys, own)])
    grouped = checkpointed(plan.groupBy(*own).agg(F.count("*").alias("_m"), F.min("_p").alias("_p")))
    once = named(docs).join(grouped.filter("_m = 1").drop("_m"), same())
    if not grouped.filter("_m > 1").isEmpty():
        repeated = grouped.filter("_m > 1").select(*own)
        nth = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
        plans = plan.join(repeated.select(*[F.col(c).alias(f"{c}2") for c in own]), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in own]), "left_semi").withColumn("_k", nth(own, "_p"))
        rows = named(docs).join(repeated, same(), "left_semi").withColumn("_j", nth(keys, F.xxhash64(*docs.columns)))
        once = once.unionByName(rows.join(plans, same() & (F.col("_j") == F.col("_k"))).select(*once.columns))
    twice = once.withColumn("_at", F.explode(F.slice(F.array("_p.position", "_p.again"), F.lit(1), F.col("_p.n"))))
    return twice.sort(F.col("_at").asc_nulls_first(), "_id", "_h").select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position").sort(F.col("position").asc_nulls_last(), "doc_id")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, 0) AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS kind FROM s),
w AS (SELECT *, CASE kind WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS ceiling FROM k),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
         - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER ()
         - coalesce(sum(weight) OVER (ORDER BY ceiling / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM w),
t AS (SELECT source, source_size, kind, least(ceiling, max(lv) OVER () * weight) AS target FROM l),
b AS (SELECT d.doc_id, d.size, t.source_size, t.kind, t.target, floor(t.target)::BIGINT AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id NULLS FIRST, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, greatest(0, least(size, whole - before)) AS p1, greatest(0, least(size, whole - source_size - before)) AS p2 FROM b),
u AS (SELECT *, (before + p1 / 2.0::DOUBLE) / target AS u FROM f)
SELECT doc_id, size, source_size, target, (p1 + p2)::BIGINT AS taken,
       CASE WHEN p1 > 0 THEN CASE kind
         WHEN 0 THEN 0.0::DOUBLE + ((u * 3.0::DOUBLE - 0.0::DOUBLE) * 2.0::DOUBLE) / (4.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 20.25::DOUBLE + -6.0::DOUBLE * (u * 3.0::DOUBLE - 0.0::DOUBLE))))
         WHEN 1 THEN 0.0::DOUBLE + ((u * 1.0::DOUBLE - 0.0::DOUBLE) * 2.0::DOUBLE) / (0.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2.0::DOUBLE * (u * 1.0::DOUBLE - 0.0::DOUBLE))))
         ELSE 0.0::DOUBLE + ((u * 2.0::DOUBLE - 0.0::DOUBLE) * 2.0::DOUBLE) / (2.0::DOUBLE + sqrt(greatest(0.0::DOUBLE, 4.0::DOUBLE + 0.0::DOUBLE * (u * 2.0::DOUBLE - 0.0::DOUBLE)))) END END AS position
FROM u
"""
