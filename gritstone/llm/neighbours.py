"""Exact nearest neighbours by score, as a join of Voronoi groups.

Data go to the cell of their nearest pivot, queries to the group of theirs, of fewer pivots. Of a cell of data the summary is the distance of its rows to the pivot: the
smallest few and the largest; of a group of queries, the range of their products with every pivot and their largest length. By
the triangle inequality a row at distance d from its pivot c scores between q.c - |q| d and q.c + |q| d. So the summaries alone give each
group a score that enough rows must reach, and, for every cell, the least distance to its pivot from which a row can reach
it: only those rows are sent to the group. Groups are solved block by block in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed, releasing, table
from .integers import integer_vectors, matrix, one_per_id

TOP, EVERY, FACTOR = 20, 20, 64
#: Rows of a cell aimed at; most pivots; rows, by hash, that pivots are fitted on; rows of a block of data; queries of a group.
CELL, PIVOTS, SAMPLE, BLOCK, GROUP = 2048, 512, 20_000, 4096, 1024
#: Outward rounding of what is computed from distances, per unit of size.
SLACK = 1e-9


def pivots(rows: DataFrame, n: int, cell: int = CELL, rounds: int = 6) -> np.ndarray:
    """Centres of ceil(n / cell) cells, at most PIVOTS, fitted on a sample of SAMPLE rows or so by hash in one task."""
    k = max(1, min(PIVOTS, -(-n // cell)))
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / n).withColumn("one", F.lit(0))

    def fit(group):
        x = matrix(group.column("v"), np.float64)[np.argsort(group.column("vec_id").to_numpy())]
        middle = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
        for _ in range(rounds):
            near = ((middle * middle).sum(axis=1) - 2 * (x @ middle.T)).argmin(axis=1)
            sums = np.zeros_like(middle)
            np.add.at(sums, near, x)
            count = np.bincount(near, minlength=len(middle))[:, None]
            middle = np.where(count > 0, sums / np.maximum(count, 1), middle)
        return pa.table({"centre": pa.array(middle.tolist(), pa.list_(pa.float64()))})

    found = sample.groupBy("one").applyInArrow(fit, "centre array<double>").collect()  # at most PIVOTS rows
    if not found:  # no row of a small table came into the sample
        found = rows.orderBy("vec_id").select("v").limit(1).collect()
    return np.array(sorted(r[0] for r in found), np.float64)


def in_cells(rows: DataFrame, middle: np.ndarray) -> DataFrame:
    """(vec_id, cell, d, v): the nearest pivot and the distance to it, rounded up."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), np.float64)
            if not len(x):
                continue
            cell = ((middle * middle).sum(axis=1) - 2 * (x @ middle.T)).argmin(axis=1)
            apart = x - middle[cell]
            d = np.sqrt((apart * apart).sum(axis=1)) * (1 + SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(d), batch.column(1)], ["vec_id", "cell", "d", "v"])

    return rows.select("vec_id", "v").mapInArrow(releasing(run), "vec_id long, cell int, d double, v array<long>")


def query_ranges(queries: DataFrame, middle: np.ndarray) -> DataFrame:
    """(grp, part, cell, low, high, length): of each group's queries, the range of products with the cell's pivot, and the largest length."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(2), np.float64)
            if not len(x):
                continue
            code = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy().astype(np.int64)
            near, size = x @ middle.T, np.sqrt((x * x).sum(axis=1))
            for one in np.unique(code).tolist():
                at = code == one
                k = len(middle)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, one >> 32, np.int32)), pa.array(np.full(k, one & 0xFFFFFFFF, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(near[at].min(axis=0)), pa.array(near[at].max(axis=0)), pa.array(np.full(k, size[at].max()))],
                    ["grp", "part", "cell", "low", "high", "length"],
                )

    sent = queries.select("grp", "part", "q").mapInArrow(releasing(run), "grp int, part int, cell int, low double, high double, length double")
    return sent.groupBy("grp", "part", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("length").alias("length"))


def solve(top: int):
    """For one group of queries and one block of rows: (query_id, vec_id, score) of each query's `top` best rows there."""

    def run(left, right):
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("vec_id").to_numpy())
            ids, x = right.column("vec_id").to_numpy()[order], matrix(right.column("v"), np.float64)[order]
            asked, q = left.column("query_id").to_numpy(), matrix(left.column("q"), np.float64)
            for at in range(0, len(q), 256):
                score = q[at : at + 256] @ x.T  # whole numbers below 2^53: exact
                who = asked[at : at + 256]
                place = np.minimum(np.searchsorted(ids, who), len(ids) - 1)
                own = np.flatnonzero(ids[place] == who)
                score[own, place[own]] = -np.inf
                k = min(top, score.shape[1])
                least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                best = np.lexsort((col, -score[row, col], row))  # columns are in order of vec_id
                row, col = row[best], col[best]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[nth < top], col[nth < top]
                out["query_id"].append(who[row])
                out["vec_id"].append(ids[col])
                out["score"].append(score[row, col].astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(a) if a else np.zeros(0, np.int64), pa.int64()) for n, a in out.items()})

    return run


def _same_length(rows: DataFrame, top: int, every: int, cell: int, block: int, group: int) -> DataFrame:
    spark, n = rows.sparkSession, rows.count()
    middle = pivots(rows, n, cell)
    placed = checkpointed(in_cells(rows, middle))

    def small(sizes: DataFrame) -> DataFrame:
        """Sizes by cell, at most PIVOTS rows."""
        return F.broadcast(spark.createDataFrame(sizes.collect(), sizes.schema))

    sizes = small(placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max("d").alias("most")))
    data = placed.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "d", "v")
    # queries are few, so they have wider cells of their own: rows are sent once for each group, not once for each cell
    asking = checkpointed(in_cells(rows.filter(F.col("vec_id") % every == 0), pivots(rows, n, group * every)))
    parts = small(asking.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias("parts")))
    queries = asking.join(parts, "cell").select(F.col("cell").alias("grp"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    ranges = checkpointed(query_ranges(queries, middle))
    # a group of queries may have one of its own among the nearest of a cell, so one row more is asked for
    nearest = data.select("cell", "block", "d", "vec_id")
    for keys in (["cell", "block"], ["cell"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("d", "vec_id"))
        nearest = nearest.withColumn("nth", nth).filter(F.col("nth") <= top + 1).drop("nth")
    nearest = nearest.select("cell", "d")
    slack = F.lit(SLACK) * (F.abs(F.col("low")) + F.abs(F.col("high")) + F.col("length") * F.col("d")) + F.lit(1e-6)
    sure = ranges.join(nearest, "cell").select("grp", "part", (F.col("low") - F.col("length") * F.col("d") - slack).alias("sure"))
    place = F.row_number().over(Window.partitionBy("grp", "part").orderBy(F.col("sure").desc()))
    floor = sure.withColumn("nth", place).filter(F.col("nth") <= top + 1).filter(F.col("nth") == top + 1).select("grp", "part", F.col("sure").alias("floor"))
    slack = F.lit(SLACK) * (F.abs(F.col("high")) + F.abs(F.col("floor")) + F.col("length") * F.col("most")) + F.lit(1e-6)
    reach = F.when(F.col("floor").isNull() | (F.col("length") == 0), 0.0).otherwise((F.col("floor") - F.col("high") - slack) / F.col("length"))
    needs = ranges.join(floor, ["grp", "part"], "left").join(sizes, "cell").withColumn("reach", reach).filter("most >= reach")
    needs = checkpointed(needs.select("grp", "part", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "reach"))

    asked = needs.groupBy("cell", "block").agg(F.collect_list(F.struct("grp", "part", "reach")).alias("by"))
    sent = data.join(asked, ["cell", "block"]).select("cell", "block", "vec_id", "v", F.explode(F.filter("by", lambda b: b["reach"] <= F.col("d"))).alias("to"))
    sent = sent.select("to.grp", "to.part", "cell", "block", "vec_id", "v")
    asking = queries.join(needs.select("grp", "part", "cell", "block"), ["grp", "part"])
    keys = ["grp", "part", "cell", "block"]
    return asking.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve(top), "query_id long, vec_id long, score long")


def top_scores(vectors: DataFrame, top: int = TOP, every: int = EVERY, factor: int = FACTOR, cell: int = CELL, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `top` rows of highest score (all, if fewer), ties to the smaller vec_id.

    Queries are the rows of vectors (vec_id, embedding) whose vec_id is divisible by `every`; every row but the query's own is a candidate; the
    score is the product of the vectors with components floor(factor * x). Rows that cannot be compared (integers.py) and rows without
    vec_id take no part; of rows with one vec_id the smallest vector counts; vectors of different lengths do not meet.
    """
    rows = checkpointed(one_per_id(integer_vectors(vectors, factor)))
    found = None
    for size in sorted(r[0] for r in rows.select(F.size("v").alias("d")).distinct().collect()):
        part = _same_length(rows.filter(F.size("v") == size), top, every, cell, block, group)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= top)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores(table(spark, sf_dir, "embeddings"))


OP12_SQL = """WITH kept AS MATERIALIZED (SELECT vec_id, [floor(CAST(x AS DOUBLE) * 64) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM kept q JOIN kept x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""
