"""Near copies by SimHash and pigeonring at a set similarity, for stages that keep one document of each group.

The fingerprint is a SimHash of 256 bits over the distinct five-word shingles. At a similarity of 0.8 two of them differ in some 39 bits,
so no segment need be equal: texts meet through bands of minhashes. Pairs that met must keep a chain on the ring of eight
segments within the proportional budgets of BUDGET bits, then pass the full Hamming check; the whole shingle sets decide.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpointed, releasing
from .components import components
from .simhash import attach

SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits in a fingerprint, segments on its ring, and the bits two similar texts may differ in: 38 + 4.4 standard errors.
LANES, PARTS, BUDGET = 4, 8, 64
#: (minhashes in a band, bands); two texts of similarity 0.8 share some band with 99.6 %.
BANDS = (5, 14)
#: Texts, and shingles, in a cell: a bucket is dealt to as many cells as it needs, and each cell meets each.
CELL, CELL_SHINGLES = 500, 1 << 20
#: Pairs of one text that a task takes when stars are verified.
SPREAD = 1000
_RNG = np.random.default_rng(0)
_A = _RNG.integers(1, 2**63, (BANDS[0] * BANDS[1], 1), dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, (BANDS[0] * BANDS[1], 1), dtype=np.uint64)
_PRINT = [f"f{i}" for i in range(LANES)]
_BAND = [f"b{i}" for i in range(BANDS[1])]


def _shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending; none without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist())), np.uint64, n))


def _print(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint's words: a bit is 1 if set in over half of the shingles' hashes, each widened to 256 bits."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)]
        wide = np.empty((len(part), LANES), np.uint64)
        for i in range(LANES):
            z = part + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wide[:, i] = z ^ (z >> np.uint64(31))
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def _band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, different from band to band, from the least values of all the hashes; equal ones without any."""
    width, bands = BANDS
    mixed = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    if len(hashes):
        low = np.full(width * bands, 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), 256):
            np.minimum(low, (hashes[None, at : at + 256] * _A + _B).min(axis=1), out=low)
        low = low.reshape(bands, width)
        for j in range(width):
            mixed = (mixed ^ low[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return mixed


def _name(hashes: np.ndarray) -> tuple[int, int]:
    digest = hashlib.md5(hashes.tobytes()).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, id, id2, size, f0.., b0..) of docs (doc_id, text): the shingle set's name, its size, fingerprint and band keys."""
    columns = ["doc_id", "id", "id2", "size", *_PRINT, *_BAND]

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, 3 + LANES + BANDS[1]), np.int64)
            for i, text in enumerate(batch.column(1)):
                hashes = _shingles(text.as_py())
                out[i, :2], out[i, 2] = _name(hashes), len(hashes)
                out[i, 3:] = np.concatenate((_print(hashes), _band_keys(hashes))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, j]) for j in range(out.shape[1])]], columns)

    return docs.mapInArrow(releasing(run), ", ".join(f"{c} long" for c in columns))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(id, id2, least, n, size, f0.., b0..): one row for each shingle set in docs (doc_id, text)."""
    first = [F.first(c).alias(c) for c in ["size", *_PRINT, *_BAND]]
    return sketched(docs).groupBy("id", "id2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *first)


def in_chain(x: list[Column], y: list[Column]) -> Column:
    """Whether some chain of consecutive segments keeps within the proportional budgets, at every length up to the whole ring."""
    per, width = PARTS // LANES, 64 * LANES // PARTS
    mask = F.lit((1 << width) - 1)
    d = F.array(*[F.bit_count(F.shiftrightunsigned(x[i // per].bitwiseXOR(y[i // per]), i % per * width).bitwiseAND(mask)) for i in range(PARTS)])
    ends = F.array(*[F.lit(i) for i in range(2 * PARTS)])
    # one running total over the ring gone round twice; a chain from s is total[s + length] - total[s]
    totals = F.aggregate(ends, F.array(F.lit(0)), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.get(d, i % PARTS))))
    starts, lengths = F.array(*[F.lit(i) for i in range(PARTS)]), F.array(*[F.lit(i + 1) for i in range(PARTS)])
    return F.exists(F.transform(F.array(totals), lambda t: F.exists(starts, lambda s: F.forall(lengths, lambda k: (F.get(t, s + k) - F.get(t, s)) * PARTS <= k * BUDGET))), lambda found: found)


def chains(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """in_chain for every row of x against every row of y (fingerprints as rows of words), as a matrix; ends with the full Hamming check."""
    d = np.bitwise_count(x.view("<u4")[:, None, :] ^ y.view("<u4")[None, :, :]).astype(np.int16)
    totals = np.concatenate((np.zeros((*d.shape[:2], 1), np.int16), np.cumsum(np.concatenate((d, d), axis=2), axis=2, dtype=np.int16)), axis=2)
    some = np.zeros(d.shape[:2], bool)
    for start in range(PARTS):
        within = ~some
        for length in range(1, PARTS + 1):
            within &= (totals[:, :, start + length] - totals[:, :, start]) * PARTS <= BUDGET * length
        some |= within
    return some & (totals[:, :, PARTS] <= BUDGET)


def shingle_sets(docs: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hashes): the whole sets of the texts named in ids (id), from docs (doc_id, text); 32 bits of every hash, ascending.

    Two shingles of one pair share 32 bits with n * m / 2^32: some 0.00003 shingles for two texts of 330 words.
    """
    wanted = checkpointed(texts.join(ids.distinct(), "id", "left_semi").select("least", "id"))
    rows = docs.select("doc_id", "text").join(wanted.filter("least IS NOT NULL").select(F.col("least").alias("_w")).distinct(), F.col("doc_id") == F.col("_w"), "left_semi").select("text")
    if not wanted.filter("least IS NULL").isEmpty():
        rows = rows.union(docs.filter("doc_id IS NULL").select("text"))

    def run(batches):
        for batch in batches:
            ids, sets = [], []
            for text in batch.column(0):
                hashes = _shingles(text.as_py())
                ids.append(_name(hashes)[0])
                sets.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "hashes"])

    # rows may share a doc_id, or have none: each is read once, and the set's name says which are wanted
    found = rows.mapInArrow(releasing(run), "id long, hashes binary").join(wanted.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")
    return found.groupBy("id").agg(F.first("hashes").alias("hashes"))


def _similar(u: np.ndarray, v: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(u, v, assume_unique=True))
    return shared >= similarity * (len(u) + len(v) - shared)


def _stars(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's first text and each other, once, that pass sizes, chains and the Hamming check."""
    pairs = checkpointed(rows.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    prints = texts.select("id", "size", *_PRINT)
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    centres = many.join(prints.withColumnRenamed("id", "a"), "a").select("a", "n", F.col("size").alias("_size"), *[F.col(c).alias(f"_{c}") for c in _PRINT])
    met = attach(pairs, centres, "a").join(prints.withColumnRenamed("id", "b"), "b")
    met = met.filter((F.least("size", "_size") >= SIMILARITY * F.greatest("size", "_size")) & in_chain([F.col(c) for c in _PRINT], [F.col(f"_{c}") for c in _PRINT]))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in _PRINT[1:]), F.bit_count(F.col(_PRINT[0]).bitwiseXOR(F.col(f"_{_PRINT[0]}"))))
    return met.filter(apart <= BUDGET).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar as asked for. A text in many pairs as a is dealt over tasks by a salt."""
    pairs = checkpointed(pairs)
    many = checkpointed(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / SPREAD).cast("int")))
    salted = attach(pairs, many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    x = sets.join(many, sets["id"] == many["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hashes").alias("x"))
    both = salted.join(x, ["a", "salt"]).select("a", "b", "x").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def decide(batches):
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(releasing(decide), "a long, b long")


def block_links(ids: list[int], roots: np.ndarray, left: np.ndarray, right: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between texts of different roots, left rows against right rows.

    Sizes, chains and the Hamming check choose the pairs; whole sets decide them, one pair at a time where they are few, else
    by a product of the texts' membership rows.
    """
    sizes = np.array([len(s) for s in sets])
    near = chains(prints[left], prints[right]) & (roots[left][:, None] != roots[right][None, :])
    near &= np.minimum(sizes[left][:, None], sizes[right][None, :]) >= similarity * np.maximum(sizes[left][:, None], sizes[right][None, :])
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    once = i != j
    i, j = i[once], j[once]
    if len(i) > 4 * len(ids):
        used = np.unique(np.concatenate((i, j)))
        place = np.zeros(len(ids), np.int64)
        place[used] = np.arange(len(used))
        owner = np.repeat(np.arange(len(used)), sizes[used])
        held, column, often = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        again = often > 1
        renamed = np.cumsum(again) - 1
        owner, column = owner[again[column]], renamed[column[again[column]]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(used), len(used)), np.float32)
        step = max(256, (8 << 20) // len(used))
        for first in range(0, int(again.sum()), step):
            lo, hi = np.searchsorted(column, (first, first + step))
            rows = np.zeros((len(used), step), np.float32)
            rows[owner[lo:hi], column[lo:hi] - first] = 1
            shared += rows @ rows.T
        both = shared[place[i], place[j]]
        sure = both >= similarity * (sizes[i] + sizes[j] - both)
    else:
        sure = np.fromiter((_similar(sets[a], sets[b], similarity) for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
    parent: dict = {}

    def find(v):
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    links = []
    for a, b in zip(i[sure].tolist(), j[sure].tolist()):
        p, q = find(roots[a]), find(roots[b])
        if p != q:
            parent[q] = p
            links.append((ids[a], ids[b]))
    return links


def _blocks(rows: DataFrame, texts: DataFrame, sets: DataFrame, similarity: float, cell: int, cell_shingles: int) -> DataFrame:
    """Links within buckets whose texts (rows: key, id, n, root) have different roots: every pair of such texts is looked at.

    A bucket is dealt to cells, and each pair of cells is one block, compared in one task; the work grows with the square of a
    bucket, its memory does not. A block gives at most one link for each of its texts.
    """
    sized = rows.join(texts.select("id", "size", *_PRINT), "id")
    mixed = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("_size"), F.min("root").alias("_r"), F.max("root").alias("_s")).filter("_r <> _s")
    mixed = checkpointed(mixed.select("key", "n", F.ceil(F.greatest(F.col("n") / cell, F.col("_size") / cell_shingles)).cast("int").alias("cells")))
    members = attach(rows.select("key", "id", "root"), mixed, "key").join(texts.select("id", *_PRINT), "id").join(sets, "id")
    members = members.withColumn("cell", F.pmod(F.xxhash64("id", "key"), F.col("cells")).cast("int"))
    other = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    blocks = other.select("key", F.least("cell", "other").alias("c"), F.greatest("cell", "other").alias("d"), "cell", "id", "root", *_PRINT, "hashes")

    def compare(batches):
        def rows():
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in range(batch.num_columns - 1)]
                for k, values in enumerate(zip(*columns)):
                    yield values, np.frombuffer(batch.column(batch.num_columns - 1)[k].as_buffer(), "<u4")

        for (_, c, d), block in itertools.groupby(rows(), key=lambda r: r[0][:3]):
            block = list(block)
            cells = np.array([r[0][3] for r in block])
            prints = np.array([r[0][6:] for r in block], np.int64).view(np.uint64)
            left, right = np.flatnonzero(cells == c), np.flatnonzero(cells == d)
            links = block_links([r[0][4] for r in block], np.array([r[0][5] for r in block]), left, right, prints, [r[1] for r in block], similarity)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return blocks.repartition("key", "c", "d").sortWithinPartitions("key", "c", "d").mapInArrow(releasing(compare), "a long, b long")


def similar_roots(docs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, cell: int = CELL, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """(node, root) of every text of `texts` that is linked; docs (doc_id, text) has the texts.

    Every text of a bucket is compared with the bucket's first; of a bucket whose texts are not all in one group by then, all
    texts of different groups are. So the groups are those that all pairs of all buckets would make.
    """
    keys = texts.select("id", F.explode(F.array(*_BAND)).alias("key"))
    buckets = checkpointed(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").withColumn("many", F.col("n")))
    rows = checkpointed(attach(keys, buckets, "key"))
    sets = checkpointed(shingle_sets(docs, texts, rows.select("id")))
    stars = components(_verified(_stars(rows, texts), sets, similarity))
    rooted = rows.filter("many > 2").join(stars, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    rooted = checkpointed(rooted)
    links = _blocks(rooted, texts, sets, similarity, cell, cell_shingles)
    return components(stars.select(F.col("root").alias("a"), F.col("node").alias("b")).union(links))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """docs without near copies: of each group linked by the similarity one row with its smallest doc_id stays.

    Texts with the same shingle set are copies. Null texts and texts without words count as equal. Rows that share a
    doc_id but not a group each stand for their own; rows without doc_id stay, nothing names them.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = checkpointed(distinct_texts(plain))
    roots = similar_roots(plain, texts, similarity, cell)
    named = checkpointed(texts.select("id", "least").join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root")))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    # a group's row is among the copies of a text whose smallest doc_id is the group's
    firsts = checkpointed(attach(named, checkpointed(groups), "root").filter("least = component_id").select(F.col("least").alias("_id"), F.col("root").alias("_group"), F.col("id").alias("_text")))
    nameless = docs.filter("doc_id IS NULL")
    rows = docs.join(firsts.select("_id").distinct(), docs["doc_id"] == F.col("_id"), "left_semi")
    repeated = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows")).filter("_rows > 1")
    odd = checkpointed(repeated.select("_id").join(firsts.select("_id"), "_id", "left_semi"))
    if odd.isEmpty():
        return rows.unionByName(nameless)
    once = rows.join(odd, rows["doc_id"] == odd["_id"], "left_anti")
    # of rows that share a doc_id, one for each group that it stands for
    names, schema = [*docs.columns, "_text"], StructType([*docs.schema.fields, StructField("_text", LongType())])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_name(_shingles(t.as_py()))[0] for t in batch.column(at)], pa.int64())], names)

    again = rows.join(odd, rows["doc_id"] == odd["_id"], "left_semi").select(*docs.columns).mapInArrow(releasing(run), schema)
    again = again.join(firsts.withColumnRenamed("_text", "_of"), (F.col("_text") == F.col("_of")) & (F.col("doc_id") == F.col("_id"))).dropDuplicates(["doc_id", "_group"])
    return once.unionByName(again.select(*docs.columns)).unionByName(nameless)
