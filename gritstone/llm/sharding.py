"""Sharding by minimax contiguous partition of atomic groups (equal texts)."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_for, checkpointed, running_totals, table

#: Most positions that the driver looks at in one round of narrowing.
ROUND = 1 << 15


class _Edges:
    """What is known of the group ends along the byte line: cells with their first and last end and how many lie between."""

    def __init__(self):
        self.cells: list[tuple[int, int, int]] = []

    def put(self, cells):
        self.cells = sorted(cells)
        self.firsts = [c[0] for c in self.cells]

    def last_end(self, x: int) -> tuple[int, int]:
        """Bounds of the largest group end <= x (0 if none); equal where it is known."""
        i = bisect_right(self.firsts, x) - 1
        if i < 0:
            return 0, 0
        first, last, inside = self.cells[i]
        if x >= last:
            return last, last
        return (first, first) if inside == 0 else (first, min(x, last - 1))

    def reach(self, start: int, x: int):
        """Cells with unknown ends that a search between start and x can meet."""
        lo = max(0, bisect_right(self.firsts, start) - 1)
        return [i for i in range(lo, bisect_right(self.firsts, x)) if self.cells[i][2] > 0]


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """(capacity, cuts): the smallest capacity into which `shards` contiguous runs fit, and near-equal cuts under it.

    ends has one row per atomic group with its end on the byte line (column `_end`). The driver binary-searches the
    capacity, checking each by the greedy fill; it sees cells of the line, and asks for finer cells only where a
    cut can lie, so what it holds is bounded whatever the number of groups, and the answer is exact.
    """
    edges = _Edges()

    def cells(df: DataFrame, width: int):
        cell = F.expr(f"(_end - 1) div {width}")
        got = df.groupBy(cell.cast("long").alias("c")).agg(F.min("_end").alias("a"), F.max("_end").alias("b"), F.count("*").alias("n")).collect()
        return [(r["a"], r["b"], max(0, r["n"] - 2)) if r["a"] != r["b"] else (r["a"], r["a"], 0) for r in got]

    width = 1 << max(0, (total // ROUND).bit_length())  # powers of two, so finer cells nest in coarser ones
    edges.put(cells(ends, width))

    def fill(capacity: int, bound: int) -> tuple[list[int], bool]:
        """Greedy cuts with capacity, taking the lower (0) or upper (1) bound of each last end; whether all fits."""
        at, cuts = 0, []
        for _ in range(shards):
            at = total if at + capacity >= total else edges.last_end(at + capacity)[bound]
            cuts.append(at)
        return cuts, at >= total

    def search(bound: int, lo: int) -> int:
        hi = total
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if fill(mid, bound)[1] else (mid + 1, hi)
        return lo

    floor = max(largest, -(-total // shards), 1)
    while True:
        low = search(1, floor)
        high = search(0, low)
        lows, highs = fill(low, 0)[0], fill(high, 1)[0]
        wanted = sorted({i for a, b, start_a, start_b in zip([0, *lows], [0, *highs], lows, highs) for i in edges.reach(min(a + low, start_a), min(total, b + high))} | {i for k in range(1, shards) for i in edges.reach(k * total // shards, k * total // shards)} | _back(edges, total, low, high, shards))
        if not wanted:
            break
        spans = []
        for i in wanted:
            a, b, _ = edges.cells[i]
            if spans and spans[-1][2] == i - 1:
                spans[-1] = (spans[-1][0], b, i)
            else:
                spans.append((a, b, i))
        inside = ends.filter(" OR ".join(f"_end BETWEEN {a} AND {b}" for a, b, _ in spans))
        width = min(width >> 1, 1 << (sum(b - a + 1 for a, b, _ in spans) // ROUND).bit_length())
        kept = [c for i, c in enumerate(edges.cells) if i not in set(wanted)]
        edges.put(kept + cells(inside, width))
    capacity = low
    forth = fill(capacity, 0)[0]
    back = [total]
    for _ in range(shards - 1):
        back.append(edges_next(edges, back[-1] - capacity))
    back = back[::-1]
    cuts, at = [], 0
    for k in range(shards - 1):
        ideal = (k + 1) * total // shards
        near = edges.last_end(ideal)[0]
        at = min(forth[k], max(back[k], near, at))
        if at > (cuts[-1] if cuts else 0) + capacity:
            at = edges.last_end((cuts[-1] if cuts else 0) + capacity)[0]
        cuts.append(at)
    return capacity, [*cuts, total]


def edges_next(edges: _Edges, x: int) -> int:
    """The smallest known group end >= x; 0 for x <= 0."""
    if x <= 0:
        return 0
    i = bisect_right(edges.firsts, x) - 1
    if i >= 0:
        first, last, _ = edges.cells[i]
        if first == x:
            return x
        if x <= last:
            return last
    return edges.firsts[i + 1]


def _back(edges: _Edges, total: int, low: int, high: int, shards: int) -> set[int]:
    """Cells that the fill from the far end can meet under either capacity."""
    wanted, a, b = set(), total, total
    for _ in range(shards - 1):
        wanted.update(edges.reach(a - high, b - low))
        a, b = max(0, edges.last_end(max(0, a - high))[0]), edges_next(edges, b - low)
    return wanted


def shard_documents(docs: DataFrame, shards: int = 16, rows_per_bucket: int = 4096) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs.

    size is the text's UTF-8 bytes plus 1 (null text: 1). Equal texts, null and empty ones together, form one atomic
    group. Groups lie in the order of their MD5, so shards are even samples of the corpus; groups that hold over a
    500th of the rows come last within their bucket of the order. slot counts from 0 without gaps in each shard.
    An empty table gives no rows; repeated rows get slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = checkpointed(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_key")))
    groups = checkpointed(rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")))
    n, total, largest, many = groups.agg(F.sum("_rows"), F.sum("_bytes"), F.max("_bytes"), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bits = bits_for(n, rows_per_bucket)
    lead = F.shiftright(F.conv(F.hex(F.substring("_key", 1, 3)), 16, 10).cast("long"), 24 - bits).cast("int")
    # at most 500 groups hold a 500th of the rows each, so this side of the join has a known bound
    hot = groups.filter(F.col("_rows") >= max(1000, n // 500)).select(F.col("_key").alias("_big"))

    def ordered(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), F.col("_key") == F.col("_big"), "left").withColumn("_lead", lead)

    placed = running_totals(ordered(groups), [], ["_lead", "_big"], [F.col("_key")], {"_before": "_bytes"})
    placed = checkpointed(placed.select("_rows", (F.col("_before") + F.col("_bytes")).alias("_end")))
    _, cuts = smallest_capacity(placed.select("_end"), total, largest, shards)
    shard = F.lit(0)
    for cut in cuts[:-1]:
        shard = shard + F.when(F.col("_end") > cut, 1).otherwise(0)
    held = {r["s"]: r["n"] for r in placed.groupBy(shard.alias("s")).agg(F.sum("_rows").alias("n")).collect()}
    starts = [sum(held.get(j, 0) for j in range(k)) for k in range(shards)]
    spread = ordered(rows).withColumn("_sub", F.when(F.col("_big").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // rows_per_bucket)))).otherwise(F.lit(0))).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(spread, [], ["_lead", "_big", "_sub"], [F.col("_key"), F.col("doc_id").asc_nulls_first()], {"_rank": "_one"})
    at, first = F.lit(0), F.lit(0).cast("long")
    for k in range(1, shards):
        if held.get(k):
            at = F.when(F.col("_rank") >= starts[k], F.lit(k)).otherwise(at)
            first = F.when(F.col("_rank") >= starts[k], F.lit(starts[k]).cast("long")).otherwise(first)
    return ranked.select("doc_id", "size", "text_crc32", at.cast("int").alias("shard"), (F.col("_rank") - first).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
