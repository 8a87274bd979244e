"""Vectors compressed to codes of 16 parts, by Lloyd's rounds with Elkan's bounds.

Each vector is cut into equal parts; each part position has a codebook. From round to round a vector keeps, for every part, an upper bound
of the distance to its entry and a lower bound of the distance to each entry of the codebook. An entry is left out only
when a bound shows that it is strictly farther than the part's own; all others, and so all ties, are decided on squared distances in whole
numbers. When entries move, the bounds move by as much. Bounds are rounded outwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, releasing, table
from .integers import integer_vectors, matrix, removed, written
from .simhash import attach

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: Lower bounds are kept in 16 bits, in steps of 1/STEPS, rounded down; an upper bound in a float, rounded up.
STEPS = 16
#: Outward rounding of square roots.
DOWN, UP = 1 - 1e-12, 1 + 1e-12
#: Vectors that a task holds in whole numbers at a time; share of open pairs from which on all are computed at once.
SLICE, DENSE = 4096, 0.25

STATE = "vec_id long, label string, v array<int>, code binary, upper array<float>, lower binary"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers of broadcast rows x and c, component by component."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], c.shape[:-1]), np.int64)
    for j in range(x.shape[-1]):
        apart = x[..., j] - c[..., j]
        total += apart * apart
    return total


def shrunk(lower: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Lower bounds (16-bit steps) after entries moved by so much."""
    steps = np.minimum(np.ceil(moved * STEPS * UP), 65535).astype(np.uint16)
    return np.where(lower > steps, lower - steps, 0).astype(np.uint16)


def assign(x: np.ndarray, book: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(own, error, upper, lower, pairs) of parts x under the codebook: the nearest entry, ties to the lower index.

    own, upper and lower are what the last round left, already moved; error is the squared distance to the new own entry, pairs the number
    of distances that were computed.
    """
    n, k = len(x), len(book)
    half = np.sqrt(squared(book[:, None, :], book[None, :, :]).astype(np.float64)) * 0.5 * DOWN
    error = squared(x, book[own])
    tight = np.sqrt(error.astype(np.float64)) * UP
    reach = np.minimum(upper.astype(np.float64), tight)
    open_ = (reach[:, None] >= lower / STEPS) & (reach[:, None] >= half[own])
    open_[np.arange(n), own] = False
    pairs = n + int(open_.sum())
    lower = lower.copy()
    if open_.mean() > DENSE:
        far = squared(x[:, None, :], book[None, :, :])
        lower[:] = np.minimum(np.floor(np.sqrt(far.astype(np.float64)) * STEPS * DOWN), 65535).astype(np.uint16)
        best = far.argmin(axis=1)  # the first of equals
        own, error = best, far[np.arange(n), best]
    else:
        row, entry = np.nonzero(open_)
        far = squared(x[row], book[entry])
        lower[row, entry] = np.minimum(np.floor(np.sqrt(far.astype(np.float64)) * STEPS * DOWN), 65535).astype(np.uint16)
        lower[np.arange(n), own] = np.minimum(np.floor(tight * (DOWN / UP) * STEPS * DOWN), 65535).astype(np.uint16)
        every_row, every_entry, every_far = np.concatenate((np.arange(n), row)), np.concatenate((own, entry)), np.concatenate((error, far))
        order = np.lexsort((every_entry, every_far, every_row))
        first = order[np.searchsorted(every_row[order], np.arange(n))]
        own, error = every_entry[first], every_far[first]
    upper = np.nextafter((np.sqrt(error.astype(np.float64)) * UP).astype(np.float32), np.float32(np.inf))
    return own, error, upper, lower, pairs


def rounds_of(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """One assignment of every row. moved: how far each part's entries went since the round that rows come from; None for the first.

    Rows of the last round are (vec_id, label, code, error, pairs), else STATE with the new bounds.
    """
    parts, k, width = books.shape
    names = ["vec_id", "label", "code", "error", "pairs"] if last else ["vec_id", "label", "v", "code", "upper", "lower"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                n = piece.num_rows
                x = matrix(piece.column(2)).reshape(n, parts, width)
                code, error, pairs = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
                new_upper, new_lower = np.zeros((n, parts), np.float32), np.zeros((n, parts, k), np.uint16)
                if moved is None:
                    upper, lower = np.full((n, parts), np.inf, np.float32), new_lower
                else:
                    code[:] = np.frombuffer(b"".join(piece.column(3).to_pylist()), np.uint8).reshape(n, parts)
                    upper = matrix(piece.column(4), np.float32)
                    lower = np.frombuffer(b"".join(piece.column(5).to_pylist()), np.uint16).reshape(n, parts, k)
                for p in range(parts):
                    own, high, low = code[:, p].astype(np.int64), upper[:, p].astype(np.float64), lower[:, p]
                    if moved is not None:
                        high, low = high * UP + moved[p][own] * UP, shrunk(low, moved[p])
                    own, far, new_upper[:, p], new_lower[:, p], met = assign(np.ascontiguousarray(x[:, p]), books[p], own, high, low)
                    code[:, p] = own
                    error += far
                    pairs[:1] += met
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                if last:
                    yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), codes, pa.array(error), pa.array(pairs)], names)
                else:
                    upper_list = pa.ListArray.from_arrays(pa.array(np.arange(0, n * parts + 1, parts), pa.int32()), pa.array(new_upper.ravel()))
                    yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), piece.column(2), codes, upper_list, pa.array([b.tobytes() for b in new_lower], pa.binary())], names)

    return rows.mapInArrow(releasing(run), "vec_id long, label string, code binary, error long, pairs long" if last else STATE)


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor of the mean of each entry's parts; entries without parts stay.

    Each task adds up its own rows, so what is shuffled and what the driver gets is as large as the codebooks.
    """
    parts, k, width = books.shape

    def run(batches):
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0)).reshape(-1, parts, width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=k)
        p, e = np.nonzero(count)
        place = np.arange(width)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, width)), pa.array(np.repeat(e, width)), pa.array(np.tile(place, len(p))), pa.array(np.repeat(count[p, e], width)), pa.array(total[p, e].ravel())], ["p", "e", "j", "n", "total"])

    sums = state.select("v", "code").mapInArrow(releasing(run), "p long, e long, j long, n long, total long").groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.copy()
    for r in sums.collect():  # as many rows as the codebooks have components
        out[r["p"], r["e"], r["j"]] = r["total"] // r["n"]
    return out


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, pairs), codebooks) of vectors (vec_id, embedding, label); entries is at most 256.

    Rows whose vector is null, empty or holds a null or non-finite component are left out; so are vectors of another length than
    the first one's, in order of vec_id (nulls last) and vector, whose length `parts` divides. Repeated rows, and rows without vec_id or label, are
    coded like any other. With fewer rows than entries, the codebooks have as many entries as there are rows. pairs, summed over
    all rows, is the number of distances that the last assignment computed.
    """
    spark = vectors.sparkSession
    rows = checkpointed(integer_vectors(vectors, factor, ("label",)).select("vec_id", F.col("label").cast("string").alias("label"), F.col("v").cast("array<int>").alias("v")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.filter(F.size("v") % parts == 0).orderBy(*order).select("v").first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, label string, code binary, error long, pairs long"), np.zeros((parts, 0, 0), np.int64)
    rows = rows.filter(F.size("v") == len(first[0]))
    seeds = np.array([r[0] for r in rows.orderBy(*order).select("v").limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).swapaxes(0, 1))
    state, path, moved = rows, None, None
    for _ in range(rounds):
        new, new_path = written(rounds_of(state, books, moved, False))
        if path is not None:
            removed(spark, path)
        state, path = new, new_path
        after = updated(state, books)
        moved, books = np.sqrt(squared(books, after).astype(np.float64)) * UP, after
    out = checkpointed(rounds_of(state, books, moved, True))
    if path is not None:
        removed(spark, path)
    return out, books


def op11_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(table(spark, sf_dir, "embeddings"))
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")))
    sums = checkpointed(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    out = attach(keyed, sums, "key")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


#: The same by plain products; the codebooks go from round to round in long form.
_KEPT = """kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // w AS p, (i - 1) % w AS j, v[i] AS x FROM (SELECT vec_id, v, len(v) // 16 AS w, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id))"""


def _assigned(k: int) -> str:
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
  SELECT vec_id, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{k} USING (p, j) GROUP BY vec_id, p, e) GROUP BY vec_id, p)"""


def _moved(k: int) -> str:
    return f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
  SELECT p, e, j, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS c FROM x JOIN a{k} USING (vec_id, p) GROUP BY p, e, j) m USING (p, e, j))"""


OP11_SQL = f"""WITH {_KEPT}, {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM b2) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"""
