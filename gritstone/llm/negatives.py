"""Hard negatives, by partial products in rotated coordinates.

An orthogonal rotation to the principal axes keeps all products and puts most of each vector's length first. Products with an anchor are
added up over the leading axes; what the other axes can add is at most the product of the residual lengths, and a slack covers rounding.
Rows that can no longer be among an anchor's best are discarded after each quarter of the axes. The rows that are left are scored in
whole numbers, and only those scores decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed, releasing, table
from .integers import integer_vectors, matrix, one_per_id

FACTOR, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative scores between LOW and HIGH hundredths of the positive.
LOW, HIGH = 30, 90
#: Rows of a block, anchors of a group, anchors at a time, share of open pairs below which they are worked off one by one.
BLOCK, GROUP, AT_ONCE, SPARSE = 4096, 1024, 128, 0.1
#: Rounding of sums over rotated components, per unit of the two lengths.
SLACK = 1e-9


def principal_axes(rows: DataFrame, size: int) -> np.ndarray:
    """An orthogonal matrix of the principal axes, largest first, of all rows (v) of `size` components; tasks add up their own rows."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), np.float64)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(size), size)), pa.array(np.tile(np.arange(size), size)), pa.array(total.ravel())], ["i", "j", "x"])

    moments = np.zeros((size, size))
    for r in rows.select("v").mapInArrow(releasing(run), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # size * size rows
        moments[r["i"], r["j"]] = r["x"]
    return np.ascontiguousarray(np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1])


def survivors(q: np.ndarray, x: np.ndarray, axes: np.ndarray, still):
    """(row of q, row of x, score) of the pairs that `still` leaves to the end, scores in whole numbers.

    still(low, high, open) gives the pairs that stay open, from bounds of their scores.
    """
    size = q.shape[1]
    a, b = q @ axes, x @ axes
    slack = SLACK * np.outer(np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))) + 1e-6
    open_ = np.ones((len(q), len(x)), bool)
    score = np.zeros(open_.shape)
    cuts = np.unique(np.linspace(0, size, 5).astype(int))
    for start, stop in zip(cuts[:-1], cuts[1:]):
        if open_.mean() > SPARSE:
            score += a[:, start:stop] @ b[:, start:stop].T
        else:
            i, j = np.nonzero(open_)
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                score[i[part], j[part]] += np.einsum("ij,ij->i", a[i[part], start:stop], b[j[part], start:stop])
        rest = np.outer(np.sqrt((a[:, stop:] ** 2).sum(axis=1)), np.sqrt((b[:, stop:] ** 2).sum(axis=1))) + slack
        open_ = still(score - rest, score + rest, open_)
    i, j = np.nonzero(open_)
    exact = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = np.einsum("ij,ij->i", q[i[part]], x[j[part]]).astype(np.int64)  # whole numbers below 2^53: exact
    return i, j, exact


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (higher score, then smaller id) of each group."""
    order = np.lexsort((ids, -score, group))
    nth = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return order[nth < k]


def _table(columns: dict[str, list[np.ndarray]]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(a) if a else np.zeros(0, np.int64), pa.int64()) for n, a in columns.items()})


def best_positives(axes: np.ndarray, k: int):
    """For anchors and a block of rows of one label: (anchor_id, positive_id, positive_score) of each anchor's k best there."""

    def run(left, right):
        out = {"anchor_id": [], "positive_id": [], "positive_score": []}
        if left.num_rows and right.num_rows:
            ids, x = right.column("vec_id").to_numpy(), matrix(right.column("v"), np.float64)
            anchors, every = left.column("anchor_id").to_numpy(), matrix(left.column("q"), np.float64)
            for at in range(0, len(every), AT_ONCE):
                who, q = anchors[at : at + AT_ONCE], every[at : at + AT_ONCE]
                other = who[:, None] != ids[None, :]

                def still(low, high, open_):
                    open_ = open_ & other
                    return open_ & (high >= kth_largest(np.where(open_, low, -np.inf), k)[:, None])

                i, j, score = survivors(q, x, axes, still)
                best = first_of_each(i, score, ids[j], k)
                out["anchor_id"].append(who[i[best]])
                out["positive_id"].append(ids[j[best]])
                out["positive_score"].append(score[best])
        return _table(out)

    return run


def best_negatives(axes: np.ndarray, k: int, low_share: int, high_share: int):
    """For anchors with their positives and a block of rows: the k best of another label inside each positive's window."""

    def run(left, right):
        out = {n: [] for n in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        if left.num_rows and right.num_rows:
            ids, x = right.column("vec_id").to_numpy(), matrix(right.column("v"), np.float64)
            names = {name: n for n, name in enumerate(sorted(set(right.column("label").to_pylist()) | set(left.column("mine").to_pylist())))}
            label = np.array([names[n] for n in right.column("label").to_pylist()])
            anchors, own = left.column("anchor_id").to_numpy(), np.array([names[n] for n in left.column("mine").to_pylist()])
            every, positives = matrix(left.column("q"), np.float64), left.column("positives").to_pylist()
            for at in range(0, len(every), AT_ONCE):
                who, q, mine = anchors[at : at + AT_ONCE], every[at : at + AT_ONCE], positives[at : at + AT_ONCE]
                other = own[at : at + AT_ONCE][:, None] != label[None, :]
                deep = max(len(p) for p in mine)
                # windows in whole numbers; an anchor with fewer positives has empty ones
                low = np.array([[-(-low_share * p["positive_score"] // 100) for p in ps] + [1] * (deep - len(ps)) for ps in mine], np.int64)
                high = np.array([[high_share * p["positive_score"] // 100 for p in ps] + [0] * (deep - len(ps)) for ps in mine], np.int64)

                def still(least, most, open_):
                    keep = np.zeros(open_.shape, bool)
                    open_ = open_ & other
                    for d in range(deep):
                        bottom, ceiling = low[:, d, None], high[:, d, None]
                        sure = open_ & (least >= bottom) & (most <= ceiling)
                        enough = np.maximum(kth_largest(np.where(sure, least, -np.inf), k)[:, None], bottom)
                        keep |= open_ & (most >= enough) & (least <= ceiling) & (bottom <= ceiling)
                    return keep

                i, j, score = survivors(q, x, axes, still)
                for d in range(deep):
                    inside = np.flatnonzero((score >= low[i, d]) & (score <= high[i, d]))
                    best = inside[first_of_each(i[inside], score[inside], ids[j[inside]], k)]
                    out["anchor_id"].append(who[i[best]])
                    out["positive_id"].append(np.array([mine[n][d]["positive_id"] for n in i[best]], np.int64))
                    out["positive_score"].append(np.array([mine[n][d]["positive_score"] for n in i[best]], np.int64))
                    out["negative_id"].append(ids[j[best]])
                    out["negative_score"].append(score[best])
        return _table(out)

    return run


def _ranked(found: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), name)).alias("rank")
    return found.select("*", rank).filter(F.col("rank") <= k)


def _same_length(rows: DataFrame, size: int, every: int, positives: int, negatives: int, low: int, high: int, block: int, group: int) -> DataFrame:
    axes = principal_axes(rows, size)
    asks = F.col("vec_id") % every == 0
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    # positives: anchors meet the blocks of their own label; a label of many rows is dealt to many blocks
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if(asks) / group).cast("int").alias("groups")).filter("groups > 0")
    sizes = checkpointed(sizes)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(64)).cast("int"))
    dealt = salted.join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63)))), ["label", "salt"])
    keys = ["label", "block", "grp"]
    data = dealt.withColumn("block", spread(F.col("blocks"), 0)).select("label", "block", upto(F.col("groups")).alias("grp"), "vec_id", "v")
    anchors = dealt.filter(asks).withColumn("grp", spread(F.col("groups"), 1)).select(F.col("label").alias("of"), upto(F.col("blocks")).alias("block"), "grp", F.col("vec_id").alias("anchor_id"), F.col("v").alias("q"))
    near = anchors.groupBy("of", "block", "grp").cogroup(data.groupBy(*keys)).applyInArrow(best_positives(axes, positives), "anchor_id long, positive_id long, positive_score long")
    near = _ranked(near, ["anchor_id"], "positive_score", "positive_id", positives)
    mine = checkpointed(near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives")))

    # negatives: every group of anchors meets every block of rows
    told = rows.filter(asks).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("v").alias("q")).join(mine, "anchor_id")
    blocks, groups = max(1, -(-rows.count() // block)), max(1, -(-mine.count() // group))
    asking = told.select(F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int").alias("grp"), upto(F.lit(blocks)).alias("block"), "anchor_id", F.col("own").alias("mine"), "q", "positives")
    data = rows.select(upto(F.lit(groups)).alias("grp"), spread(F.lit(blocks), 0).alias("block"), "vec_id", "label", "v")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    return asking.groupBy("grp", "block").cogroup(data.groupBy("grp", "block")).applyInArrow(best_negatives(axes, negatives, low, high), schema)


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, factor: int = FACTOR, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`. An anchor's positives are its first rows of the same label, its negatives
    the first of another label that score between low and high hundredths of a positive; first is by higher score, then smaller vec_id,
    and scores are products of the vectors with components floor(factor * x). Rows without label or vec_id and those that cannot be compared
    (integers.py) take no part; of rows with one vec_id the smallest (label, vector) counts; vectors of different lengths do not meet.
    A positive with no row in its window gives no row.
    """
    rows = checkpointed(one_per_id(integer_vectors(vectors.filter("label IS NOT NULL"), factor, ("label",)), ("label",)))
    found = None
    for size in sorted(r[0] for r in rows.select(F.size("v").alias("d")).distinct().collect()):
        part = _same_length(rows.filter(F.size("v") == size), size, every, positives, negatives, low, high, block, group)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


OP13_SQL = """WITH kept AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(CAST(x AS DOUBLE) * 256) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score
  FROM kept a JOIN kept x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10"""
