"""Call graphs: bounded traversal, components, bottom-up levels, orders, cycles and request planning.

Iterative operators run one small DataFrame round per step and checkpoint it in the session's shared folder, so lineage stays
short and a lost executor costs one round.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType


# What can be chosen when a run would send too many requests.
BUDGET_OPTIONS = ("continue_anyway", "reduce_scope", "switch_to_best_effort_bottom_up", "cancel")


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local session names none (tests), a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gritstone-"))
    return context.getCheckpointDir().rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Computed once, as a checkpoint in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shared_folder(spark: SparkSession):
    """A new folder's path in the shared folder; it goes when the block ends."""
    folder = f"{_folder(spark)}/rounds-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame) -> DataFrame:
    """df, whose joins deal out both sides by their key: nodes and edges are never collected in the driver to be broadcast, round after round."""
    return df.hint("merge")


@contextmanager
def rounds(spark: SparkSession):
    """A function that computes a DataFrame once, as a table in the shared folder; the tables go when the block ends.

    Rounds join their own results with themselves. A checkpoint would carry the estimate of its size on, squared by every such join;
    a table has the size of its files. Joins of these tables are `dealt`.
    """
    number = itertools.count()
    with shared_folder(spark) as folder:

        def keep(df: DataFrame) -> DataFrame:
            path = f"{folder}/{next(number)}"
            df.write.parquet(path)
            return dealt(spark.read.schema(df.schema).parquet(path))

        yield keep


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with `name`: 1, 2, ... in order. Rows are range-partitioned; only one count for each partition passes through one task."""
    dealt = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col("_part").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rows = dealt.withColumn("_k", inside).join(F.broadcast(starts), F.col("_part") == F.col("_q"))  # one row for each partition
    return rows.select(*df.columns, (F.col("_start") + F.col("_k")).cast("long").alias(name))


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (caller, callee) with both ends among nodes (ea), no self-calls."""
    a, b = nodes.select(F.col("ea").alias("_a")).distinct(), nodes.select(F.col("ea").alias("_b")).distinct()
    kept = edges.filter(F.col("caller") != F.col("callee")).select("caller", "callee").distinct()
    return kept.join(dealt(a), F.col("caller") == F.col("_a"), "left_semi").join(dealt(b), F.col("callee") == F.col("_b"), "left_semi")


def candidate_edges(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """edges_within the candidates, unless one of them brings `callee_eas` (addresses) of its own: then those lists alone are the graph.

    A list of nulls, and an empty or null one, bring nothing.
    """
    if "callee_eas" not in candidates.columns:
        return edges_within(edges, candidates)
    own = candidates.select(F.col("ea").alias("caller"), F.explode("callee_eas").alias("callee")).filter("callee IS NOT NULL")
    has = own.select(F.lit(1).alias("_x")).limit(1)
    return edges_within(own.unionByName(edges.select("caller", "callee").join(has, F.lit(True), "left_anti")), candidates)


def neighbours(edges: DataFrame) -> DataFrame:
    """(ea, callers, callees): distinct, sorted, without the function itself."""
    e = edges.filter(F.col("caller") != F.col("callee"))
    both = e.select(F.col("caller").alias("ea"), F.col("callee").alias("out"), F.lit(None).cast("long").alias("in")).union(e.select("callee", F.lit(None).cast("long"), "caller"))
    return both.groupBy("ea").agg(F.sort_array(F.collect_set("in")).alias("callers"), F.sort_array(F.collect_set("out")).alias("callees"))


def reach(edges: DataFrame, roots: DataFrame, nodes: DataFrame, max_depth: int = 5, max_nodes: int = 300) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Breadth-first traversal from roots (ea): (nodes, edges, skipped).

    nodes (ea, depth, pos): the first max_nodes functions in queue order, library functions and thunks (nodes.is_library) not
    entered; edges (caller, callee) from accepted functions to any other but those; skipped (reason, n): edges to
    library functions, and functions left for the node limit. Order within a round: the parent's place, then address.
    """
    e = edges.filter(F.col("caller") != F.col("callee")).select("caller", "callee").distinct()
    library = nodes.filter("is_library").select(F.col("ea").alias("_lib"))
    open_edges = saved(e.join(library, F.col("callee") == F.col("_lib"), "left_anti"))
    start = roots.select("ea").distinct().join(library, F.col("ea") == F.col("_lib"), "left_anti")
    front = saved(start.select("ea", F.lit(0).alias("depth"), F.row_number().over(Window.orderBy("ea")).cast("long").alias("pos")))
    seen, total = front, front.count()
    for depth in range(1, max_depth + 1):
        if total >= max_nodes:
            break
        found = front.join(open_edges, front["ea"] == open_edges["caller"]).groupBy("callee").agg(F.min("pos").alias("parent"))
        fresh = found.join(seen.select(F.col("ea").alias("_seen")), F.col("callee") == F.col("_seen"), "left_anti")
        # the frontier is cut at the node limit before it is numbered, so this order is over at most max_nodes rows
        fresh = fresh.sort("parent", "callee").limit(max_nodes)
        front = saved(fresh.select(F.col("callee").alias("ea"), F.lit(depth).alias("depth"), (F.row_number().over(Window.orderBy("parent", "callee")) + total).cast("long").alias("pos")))
        size = front.count()
        if not size:
            break
        seen, total = saved(seen.union(front)), total + size
    kept = saved(seen.filter(F.col("pos") <= max_nodes))
    inner = open_edges.join(kept.select(F.col("ea").alias("_k")), F.col("caller") == F.col("_k"), "left_semi")
    barred = e.join(kept.select(F.col("ea").alias("_k")), F.col("caller") == F.col("_k"), "left_semi").join(library, F.col("callee") == F.col("_lib"), "left_semi")
    skipped = barred.agg(F.lit("library_or_thunk").alias("reason"), F.count("*").alias("n")).union(seen.agg(F.lit("max_functions"), F.count_if(F.col("pos") > max_nodes)))
    return kept, inner, skipped.filter("n > 0")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with neither end among nodes."""
    a, b = nodes.select(F.col("ea").alias("_a")), nodes.select(F.col("ea").alias("_b"))
    return edges.join(dealt(a), F.col("caller") == F.col("_a"), "left_anti").join(dealt(b), F.col("callee") == F.col("_b"), "left_anti")


def _busy_ranks(edges: DataFrame) -> DataFrame:
    """(n, rank) of the nodes on edges: a number for each, larger for nodes on more ways, ties by hash."""
    ends = edges.select(F.col("caller").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("callee", F.lit(0), F.lit(1)))
    ways = ends.groupBy("n").agg((F.sum("o") * F.sum("i")).alias("ways"))
    return numbered(ways, [F.col("ways"), F.xxhash64("n"), F.col("n")], "rank").select("n", "rank")


def _trimmed(edges: DataFrame, keep) -> DataFrame:
    """edges (a, b) without those that cannot lie on a cycle because an end is not called or calls nothing, as long as each round drops a tenth."""

    def once(e: DataFrame) -> DataFrame:
        called, calling = e.select(F.col("b").alias("_t")).distinct(), e.select(F.col("a").alias("_s")).distinct()
        return e.join(dealt(called), F.col("a") == F.col("_t"), "left_semi").join(dealt(calling), F.col("b") == F.col("_s"), "left_semi")

    n = edges.count()
    while n:
        edges = keep(once(once(edges)))
        before, n = n, edges.count()
        if n > 0.9 * before:
            break
    return edges


def _without_chains(edges: DataFrame, keep) -> tuple[DataFrame, DataFrame | None]:
    """(edges, links): nodes with one caller and one callee are bypassed by pointer doubling.

    edges (a, b) then join the ends of each chain; links (v, l, r, ring) names the ends of every node that was bypassed, and for those on a ring
    of such nodes alone the ring's smallest. None where hardly any node is of that kind.
    """
    into = edges.groupBy("b").agg(F.count("*").alias("i"), F.first("a").alias("l"))
    out = edges.groupBy("a").agg(F.count("*").alias("o"), F.first("b").alias("r"))
    links = into.filter("i = 1").join(out.filter("o = 1"), F.col("b") == F.col("a")).filter("l <> b").select(F.col("b").alias("v"), "l", "r", F.col("b").alias("least"), F.lit(False).alias("ended"))
    links = keep(links)
    many = links.count()
    if many * 10 < edges.count():
        return edges, None
    for _ in range(many.bit_length() + 1):
        right = links.select(F.col("v").alias("_rv"), F.col("r").alias("_r"), F.col("least").alias("_m"))
        left = links.select(F.col("v").alias("_lv"), F.col("l").alias("_l"))
        moved = links.join(right, F.col("r") == F.col("_rv"), "left").join(left, F.col("l") == F.col("_lv"), "left")
        links = keep(moved.select("v", F.coalesce("_l", "l").alias("l"), F.coalesce("_r", "r").alias("r"), F.least("least", F.coalesce("_m", "least")).alias("least"), (F.col("_rv").isNull() & F.col("_lv").isNull()).alias("ended")))
        if links.filter("NOT ended").isEmpty():
            break
    inner = links.select(F.col("v").alias("_v"))
    rest = edges.join(inner, F.col("a") == F.col("_v"), "left_anti").join(inner, F.col("b") == F.col("_v"), "left_anti")
    across = links.filter("ended AND l <> r").select(F.col("l").alias("a"), F.col("r").alias("b"))
    return keep(rest.union(across).distinct()), links.select("v", "l", "r", F.when(~F.col("ended"), F.col("least")).alias("ring"))


def _furthest(edges: DataFrame, keep) -> DataFrame:
    """(n, c): the largest node from which n can be reached, itself included, over edges (a, b).

    Each round takes the best of the callers' and what the best so far has found itself, so what is found travels ever farther.
    """
    best = keep(edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct().withColumn("c", F.col("n")))
    while True:
        pushed = edges.join(best, F.col("a") == F.col("n")).groupBy(F.col("b").alias("_to")).agg(F.max("c").alias("_p"))
        known = best.select(F.col("n").alias("_n"), F.col("c").alias("_c"))
        step = best.join(pushed, F.col("n") == F.col("_to"), "left").select("n", F.col("c").alias("_old"), F.greatest("c", F.coalesce("_p", "c")).alias("_g"))
        new = keep(step.join(known, F.col("_g") == F.col("_n")).select("n", F.greatest("_g", "_c").alias("c"), "_old"))
        same = new.filter("c <> _old").isEmpty()
        best = new.select("n", "c")
        if same:
            return best


def _coloured(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """edges (a, b) whose ends have the same colour, and that colour, c."""
    x, y = colour.select(F.col("n").alias("_a"), F.col("c").alias("_ca")), colour.select(F.col("n").alias("_b"), F.col("c").alias("_cb"))
    return edges.join(dealt(x), F.col("a") == F.col("_a")).join(dealt(y), F.col("b") == F.col("_b")).filter("_ca = _cb").select("a", "b", F.col("_ca").alias("c"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(ea, component): the smallest node of the node's strongly connected component, for nodes on edges (caller, callee) of any one type.

    Nodes on no cycle are trimmed and chains bypassed. The rest is coloured by the largest node that reaches it, and inside each
    colour by the largest that it reaches: where both agree, a component is found, one in each colour and round; edges between
    colours lie in no component. Nodes are numbered so that the busiest are the largest, which find large components first.
    """
    with rounds(edges.sparkSession) as keep:
        return saved(_components(edges, keep))


def _components(edges: DataFrame, keep) -> DataFrame:
    every = edges.select(F.col("caller").alias("ea")).union(edges.select("callee")).distinct()
    plain = edges.filter(F.col("caller") != F.col("callee")).select("caller", "callee").distinct()
    ranks = keep(_busy_ranks(plain))
    x, y = ranks.select(F.col("n").alias("_x"), F.col("rank").alias("a")), ranks.select(F.col("n").alias("_y"), F.col("rank").alias("b"))
    rest = _trimmed(keep(plain.join(x, F.col("caller") == F.col("_x")).join(y, F.col("callee") == F.col("_y")).select("a", "b")), keep)
    rest, links = _without_chains(rest, keep)
    rest = rest if links is None else _trimmed(rest, keep)
    done = None
    while not rest.isEmpty():
        to = _furthest(rest, keep)
        inside = keep(_coloured(rest, to))
        back = _furthest(inside.select(F.col("b").alias("a"), F.col("a").alias("b")), keep)
        found = back.withColumnRenamed("c", "own").join(to.select(F.col("n").alias("_n"), "c"), F.col("n") == F.col("_n")).filter("own = c").select("n", "c")
        found = keep(found)
        done = found if done is None else done.union(found)
        gone = found.select(F.col("n").alias("_g"))
        rest = _trimmed(_coloured(inside.drop("c").join(gone, F.col("a") == F.col("_g"), "left_anti"), back).select("a", "b"), keep)
    if links is not None:
        label = links.select(F.col("v").alias("n"), F.col("ring").alias("c")).filter("c IS NOT NULL")
        open_ = links.filter("ring IS NULL")
        if done is not None:
            p, q = done.select(F.col("n").alias("_p"), F.col("c").alias("_pc")), done.select(F.col("n").alias("_q"), F.col("c").alias("_qc"))
            open_ = open_.join(dealt(p), F.col("l") == F.col("_p"), "left").join(dealt(q), F.col("r") == F.col("_q"), "left").withColumns({"l": F.coalesce("_pc", "l"), "r": F.coalesce("_qc", "r")})
        label = label.union(open_.filter("l = r").select("v", F.col("l")))
        done = label if done is None else done.union(label)
    if done is None:
        return every.select("ea", F.col("ea").alias("component"))
    named = ranks.join(done.withColumnRenamed("n", "_d"), F.col("rank") == F.col("_d"), "left").select("n", F.coalesce("c", "rank").alias("c"))
    named = keep(named)
    least = named.groupBy("c").agg(F.min("n").alias("component"))
    members = named.join(least, "c").select(F.col("n").alias("_m"), "component")
    return every.join(dealt(members), F.col("ea") == F.col("_m"), "left").select("ea", F.coalesce("component", "ea").alias("component"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(ea, group_id): nodes in components of two or more, or that call themselves; group_id is the smallest member."""
    found = saved(strong_components(edges))
    several = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    own = edges.filter(F.col("caller") == F.col("callee")).select(F.col("caller").alias("_s")).distinct()
    return found.join(dealt(several), "component", "left_semi").unionByName(found.join(dealt(own), F.col("ea") == F.col("_s"), "left_semi")).select("ea", F.col("component").alias("group_id")).distinct()


def _longest_chains(edges: DataFrame, most: int, keep) -> DataFrame | None:
    """(n, m): calls on the longest chain below n, for nodes on acyclic edges (a, b), by pointer doubling; 0 where n is not listed.

    Round k joins the pairs that a chain of 2^k calls connects with themselves, and takes a node's longest chain of under 2^(k+1) calls from
    those of under 2^k. So the rounds are the logarithm of the depth. None as soon as a round would make over `most` pairs.
    """
    pairs, longest = edges, None
    step = 1
    while not pairs.isEmpty():
        if longest is None:
            longest = pairs.groupBy(F.col("a").alias("n")).agg(F.lit(1).alias("m"))
        else:
            below = longest.select(F.col("n").alias("_n"), "m")
            far = pairs.join(below, F.col("b") == F.col("_n"), "left").groupBy(F.col("a").alias("_a")).agg((F.max(F.coalesce("m", F.lit(0))) + step).alias("far"))
            longest = longest.join(far, F.col("n") == F.col("_a"), "left").select("n", F.coalesce("far", "m").cast("int").alias("m"))
        longest = keep(longest)
        ways = pairs.groupBy(F.col("b").alias("_v")).agg(F.count("*").alias("i")).join(pairs.groupBy("a").agg(F.count("*").alias("o")), F.col("_v") == F.col("a")).agg(F.sum(F.col("i") * F.col("o"))).first()[0]
        if (ways or 0) > most:
            return None
        on = pairs.select(F.col("a").alias("_m"), F.col("b").alias("c"))
        pairs = keep(pairs.join(on, F.col("b") == F.col("_m")).select("a", F.col("c").alias("b")).distinct())
        step *= 2
    return edges.select(F.col("a").alias("n"), F.lit(0).alias("m")) if longest is None else longest


#: Pairs that a round of doubling may make, for each edge; beyond it leaves are peeled off first.
GROWTH = 8


def bottom_up_levels(nodes: DataFrame, edges: DataFrame, growth: int = GROWTH) -> DataFrame:
    """(ea, level, is_cycle, group_id) for nodes (ea) under edges (caller, callee) among them.

    Cyclic nodes have no level and come in groups; edges to them do not count. The others' level is the length of the longest
    chain of calls below them, found by doubling. Where chains branch so much that a round would make over `growth` pairs for each edge,
    1, 2, 4, ... levels of functions whose callees are all done are peeled off before it is tried again.
    """
    with rounds(nodes.sparkSession) as keep:
        return saved(_levels(nodes, edges, growth, keep))


def _levels(nodes: DataFrame, edges: DataFrame, growth: int, keep) -> DataFrame:
    cyclic = saved(cyclic_nodes(edges))
    gone = cyclic.select(F.col("ea").alias("_g"))
    rest = keep(_without(edges.filter(F.col("caller") != F.col("callee")).select("caller", "callee").distinct(), cyclic))
    left = keep(nodes.select("ea").distinct().join(dealt(gone), F.col("ea") == F.col("_g"), "left_anti"))
    levels, level, burst = None, 0, 1
    while True:
        longest = _longest_chains(rest.select(F.col("caller").alias("a"), F.col("callee").alias("b")), growth * rest.count(), keep)
        if longest is not None:
            last = left.join(longest, F.col("ea") == F.col("n"), "left").select("ea", (F.coalesce("m", F.lit(0)) + level).cast("int").alias("level"))
            levels = last if levels is None else levels.union(last)
            break
        for _ in range(burst):
            waiting = rest.select(F.col("caller").alias("_w")).distinct()
            ready = keep(left.join(waiting, F.col("ea") == F.col("_w"), "left_anti"))
            now = ready.withColumn("level", F.lit(level))
            levels = keep(now if levels is None else levels.union(now))
            done = ready.select(F.col("ea").alias("_d"))
            left = keep(left.join(done, F.col("ea") == F.col("_d"), "left_anti"))
            rest = keep(rest.join(done, F.col("callee") == F.col("_d"), "left_anti"))
            level += 1
        burst *= 2
    loops = cyclic.join(dealt(nodes.select(F.col("ea").alias("_n")).distinct()), F.col("ea") == F.col("_n"), "left_semi").select("ea", F.lit(None).cast("int").alias("level"), F.lit(True).alias("is_cycle"), "group_id")
    return levels.select("ea", "level", F.lit(False).alias("is_cycle"), F.lit(None).cast(dict(cyclic.dtypes)["group_id"]).alias("group_id")).unionByName(loops)


def callees_first_with_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ea, component, height, ord): an order in which every function comes after all its callees but those of its own cycle.

    Components are contracted; height is the longest chain of calls between components below the function's own. Within
    a height, components come by their smallest address and their members by address.
    """
    inner = saved(edges_within(edges, nodes))
    found = strong_components(inner)
    placed = nodes.select("ea").distinct().join(dealt(found.withColumnRenamed("ea", "_e")), F.col("ea") == F.col("_e"), "left").select("ea", F.coalesce("component", "ea").alias("component"))
    placed = saved(placed)
    x, y = placed.select(F.col("ea").alias("_x"), F.col("component").alias("_cx")), placed.select(F.col("ea").alias("_y"), F.col("component").alias("_cy"))
    between = inner.join(dealt(x), F.col("caller") == F.col("_x")).join(dealt(y), F.col("callee") == F.col("_y")).filter("_cx <> _cy").select(F.col("_cx").alias("caller"), F.col("_cy").alias("callee")).distinct()
    heights = bottom_up_levels(placed.select(F.col("component").alias("ea")).distinct(), saved(between)).select(F.col("ea").alias("_c"), F.col("level").alias("height"))
    rows = placed.join(dealt(heights), F.col("component") == F.col("_c")).drop("_c")
    return numbered(rows, [F.col("height"), F.col("component"), F.col("ea")], "ord")


def callees_first(levels: DataFrame) -> DataFrame:
    """(ea, ord): a callee-first order of the levels, cyclic functions last."""
    order = [F.col("level").asc_nulls_last(), F.col("group_id").asc_nulls_first(), F.col("ea")]
    return numbered(levels, order, "ord").select("ea", "ord")


def level_members(levels: DataFrame, index: int) -> DataFrame:
    """(ea): the functions of one level, by its index; none where there is no such level."""
    return levels.filter(F.col("level") == index).select("ea")


def back_edges(edges: DataFrame, program: str = "program_id") -> DataFrame:
    """(program, caller, callee, path): one cycle for each back edge of a depth-first walk, program by program.

    Every cycle lies in one strongly connected component, so components are found first, by rounds; each is walked by itself, from its
    smallest address, callees in address order. Functions on no cycle never reach the walk. A walk is sequential by nature: one component is
    one group, and a path is at most as long as its component. A function that calls itself is a cycle of its own.
    """
    import numpy as np

    kind = edges.schema[program].dataType
    rows = saved(edges.select(F.col(program).alias("p"), F.col("caller").cast("long").alias("x"), F.col("callee").cast("long").alias("y")).distinct())
    node = lambda c: F.struct(F.col("p").alias("p"), F.col(c).alias("ea"))
    found = strong_components(rows.select(node("x").alias("caller"), node("y").alias("callee")))
    home = saved(found.select(F.col("ea.p").alias("_p"), F.col("ea.ea").alias("_e"), F.col("component.ea").alias("c")))
    at = rows.join(home, F.col("p").eqNullSafe(F.col("_p")) & (F.col("x") == F.col("_e"))).select("p", "x", "y", "c")
    inside = at.join(home.select(F.col("_p").alias("_q"), F.col("_e").alias("_f"), F.col("c").alias("_d")), F.col("p").eqNullSafe(F.col("_q")) & (F.col("y") == F.col("_f")) & (F.col("c") == F.col("_d"))).select("p", "c", "x", "y")

    def walk(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("y").to_numpy(), group.column("x").to_numpy()))
        group = group.take(pa.array(order))
        out: dict[int, list[int]] = {}
        for a, b in zip(group.column("x").to_pylist(), group.column("y").to_pylist()):
            out.setdefault(a, []).append(b)
        root = group.column("c")[0].as_py()
        path, depth, left, cycles = [root], {root: 0}, [iter(out.get(root, ()))], []
        finished = set()
        while path:
            nxt = next(left[-1], None)
            if nxt is None:
                node = path.pop()
                left.pop()
                finished.add(node)
                del depth[node]
            elif nxt in depth:
                cycles.append((path[-1], nxt, [*path[depth[nxt] :], nxt]))
            elif nxt not in finished:
                depth[nxt] = len(path)
                path.append(nxt)
                left.append(iter(out.get(nxt, ())))
        p = group.column("p")[0].as_py()
        return pa.table({program: pa.array([p] * len(cycles), group.schema.field("p").type), "caller": pa.array([c[0] for c in cycles], pa.int64()), "callee": pa.array([c[1] for c in cycles], pa.int64()), "path": pa.array([c[2] for c in cycles], pa.list_(pa.int64()))})

    return inside.groupBy("p", "c").applyInArrow(walk, StructType([StructField(program, kind), StructField("caller", LongType()), StructField("callee", LongType()), StructField("path", ArrayType(LongType()))]))


def level_batches(levels: DataFrame, size: int) -> DataFrame:
    """(ea, group_no, is_cycle, batch): levels, then cycle groups, each cut into batches of `size` in address order.

    Rows are numbered over all groups, and a group's first number is taken off, so that a large level is no task of its own.
    """
    key = [F.col("level").asc_nulls_last(), F.col("group_id").asc_nulls_first()]
    placed = saved(numbered(levels.select("ea", "level", "is_cycle", "group_id"), [*key, F.col("ea")]))
    heads = numbered(placed.groupBy("level", "group_id").agg(F.min("place").alias("first")), key, "nth").select(F.col("level").alias("_l"), F.col("group_id").alias("_g"), "first", (F.col("nth") - 1).cast("int").alias("group_no"))
    rows = placed.join(heads, F.col("level").eqNullSafe(F.col("_l")) & F.col("group_id").eqNullSafe(F.col("_g")))
    return rows.select("ea", "group_no", "is_cycle", F.floor((F.col("place") - F.col("first")) / size).cast("int").alias("batch"))


def request_estimate(levels: DataFrame, cached: DataFrame, size: int, max_requests: int = 25, warn_above: int = 25) -> DataFrame:
    """One row: requests, cached and uncached functions, levels, cycle_groups, exceeded, recommendation.

    levels (ea, level, is_cycle, group_id); cached (ea): functions whose results are known and cost nothing.
    """
    marked = levels.join(cached.select(F.col("ea").alias("_c")).distinct(), F.col("ea") == F.col("_c"), "left")
    by = marked.groupBy("level", "group_id").agg(F.count_if(F.col("_c").isNull()).alias("open"), F.count_if(F.col("_c").isNotNull()).alias("known"))
    out = by.agg(F.sum(F.ceil(F.col("open") / size)).cast("long").alias("requests"), F.sum("known").alias("cached"), F.sum("open").alias("uncached"), F.count("level").alias("levels"), F.count("group_id").alias("cycle_groups"))
    out = out.na.fill(0).withColumn("exceeded", F.col("requests") > min(max_requests, warn_above))
    return out.withColumn("recommendation", F.when(F.col("exceeded"), "over budget: take fewer functions, more cached answers, or best_effort_bottom_up").otherwise("fits the budget"))


def reduced_scope(candidates: DataFrame, edges: DataFrame, limit: int = 250) -> DataFrame:
    """The candidates (ea, pre_tags, apis, strings) to keep when there are more than `limit`: leaves first, then the most telling."""
    inner = edges.select(F.col("caller").alias("_c")).distinct()
    none = F.array().cast("array<string>")
    size = lambda c: F.size(F.coalesce(F.col(c), none))
    ranked = candidates.join(inner, F.col("ea") == F.col("_c"), "left").withColumns({"leaf": F.col("_c").isNull(), "weight": size("pre_tags") * 10 + size("apis") + size("strings")})
    return ranked.sort(F.col("leaf").desc(), F.col("weight").desc(), "ea").limit(limit).drop("_c")


def retry_batches(missing: DataFrame, dynamic: int, shrink: int = 2, most: int = 5) -> DataFrame:
    """(ea, batch) of items (ea, ord) to ask for again, in smaller batches; what exceeds the number of requests is left."""
    size = max(1, dynamic // max(1, shrink))
    first = missing.sort("ord").limit(size * most)
    return first.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("ord")) - 1) / size).cast("int")).select("ea", "batch")


def dynamic_batch(mode: str, target: int = 40, most: int = 60, least: int = 8, strict: int = 40, proposal: int = 50, plain: int | None = None) -> int:
    base = {"strict_bottom_up": strict, "proposal_aware_bottom_up": proposal}.get(mode, plain or target)
    return max(1, min(max(base, target, least), most))


def _dealt(df: DataFrame, order: list[Column], keep) -> DataFrame:
    """df in range partitions, computed once, with `_part`, the partition's number."""
    return keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _carried(dealt: DataFrame, group: str, order: list[Column], functions: dict[str, tuple]) -> DataFrame:
    """dealt (in range partitions by group and order) with running aggregates within group, the row included: name: (function, column).

    Each partition's part of a group is aggregated once; what earlier parts have is one row for each partition and group.
    """
    parts = dealt.groupBy("_part", group).agg(*[f(c).alias(f"_t_{n}") for n, (f, c) in functions.items()])
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select(F.col("_part").alias("_q"), F.col(group).alias("_h"), *[f(f"_t_{n}").over(before).alias(f"_b_{n}") for n, (f, _) in functions.items()])
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({f"_i_{n}": f(c).over(inside) for n, (f, c) in functions.items()})
    rows = rows.join(heads, (F.col("_part") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_h")))
    joined = {n: F.coalesce(F.col(f"_i_{n}") + F.col(f"_b_{n}"), f"_i_{n}", f"_b_{n}") if f is F.sum else F.greatest(f"_i_{n}", f"_b_{n}") for n, (f, _) in functions.items()}
    return rows.select(*dealt.columns, *[c.alias(n) for n, c in joined.items()])


def packed_batches(items: DataFrame, slot: int, most: int = 0, group: str | None = None) -> DataFrame:
    """(group, ord, batch): items (ord, chars, optional group) in order, a batch closed when the next would pass slot characters or `most` items.

    An item larger than the slot is a batch by itself; null chars count as 0; ord is unique within a group. From running sums and a lookup by
    range each item gets the place where the next batch would start if one starts at it. A block (the part of a group in one range
    partition) follows these pointers to where they leave it; pointer doubling over blocks finds where each is entered and how many
    batches come before. So a long group is dealt over many tasks, and the rounds are the logarithm of its number of blocks.
    """
    with rounds(items.sparkSession) as keep:
        return saved(_packed(items, slot, most, group, keep))


def _packed(items: DataFrame, slot: int, most: int, group: str | None, keep) -> DataFrame:
    rows = items.select((F.col(group) if group else F.lit(0)).alias("g"), F.col("ord").alias("ord"), F.coalesce(F.col("chars").cast("long"), F.lit(0)).alias("chars"))
    kinds = rows.schema
    placed = keep(_carried(_dealt(rows.withColumn("one", F.lit(1).cast("long")), [F.col("g"), F.col("ord")], keep), "g", [F.col("ord")], {"place": (F.sum, "one"), "upto": (F.sum, "chars")}).drop("one"))

    # the last item that still fits into a batch that starts at `place`: ends and limits in one order
    ends = placed.select("g", F.col("upto").alias("x"), F.lit(0).alias("k"), "place", F.col("place").alias("end"))
    limits = placed.select("g", (F.col("upto") - F.col("chars") + slot).alias("x"), F.lit(1).alias("k"), "place", F.lit(None).cast("long").alias("end"))
    merged = _dealt(ends.union(limits), [F.col(c) for c in ("g", "x", "k", "place")], keep)
    fits = _carried(merged, "g", [F.col("x"), F.col("k"), F.col("place")], {"last": (F.max, "end")}).filter("k = 1")
    after = F.greatest(F.col("place") + 1, F.coalesce(F.col("last"), F.lit(0)) + 1)
    after = F.least(after, F.col("place") + most) if most > 0 else after
    nexts = fits.select(F.col("g").alias("_g"), F.col("place").alias("_p"), after.alias("next"))
    linked = keep(placed.join(nexts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("place") == F.col("_p"))).select("_part", "g", "ord", "place", "next"))

    def leave(block: pa.Table) -> pa.Table:
        """For every place of a block: the first place behind the block that its pointers lead to, and the batches on the way."""
        block = block.sort_by("place")
        place, nxt = block.column("place").to_pylist(), block.column("next").to_pylist()
        first, n = place[0], len(place)
        out, hops = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            j = nxt[i] - first
            out[i], hops[i] = (nxt[i], 1) if j >= n else (out[j], hops[j] + 1)
        return pa.table({"_part": block.column("_part"), "g": block.column("g"), "place": block.column("place"), "out": pa.array(out, pa.int64()), "hops": pa.array(hops, pa.int64())})

    g_kind, ord_kind = kinds["g"].dataType, kinds["ord"].dataType
    leaves = StructType([StructField("_part", IntegerType()), StructField("g", g_kind), StructField("place", LongType()), StructField("out", LongType()), StructField("hops", LongType())])
    left = keep(linked.groupBy("_part", "g").applyInArrow(leave, leaves))
    entries = left.select(F.col("g").alias("_g"), F.col("out").alias("_p")).distinct()
    firsts = left.filter("place = 1")
    jumps = keep(left.filter("place > 1").join(entries, F.col("g").eqNullSafe(F.col("_g")) & (F.col("place") == F.col("_p")), "left_semi").unionByName(firsts))
    blocks, reached = jumps, firsts.select("g", "place", F.lit(0).cast("long").alias("batch"))
    while not jumps.isEmpty():
        hop = jumps.select(F.col("g").alias("_g"), F.col("place").alias("_p"), "out", "hops")
        on = lambda g, p: F.col(g).eqNullSafe(F.col("_g")) & (F.col(p) == F.col("_p"))
        reached = keep(reached.union(reached.join(hop, on("g", "place")).select("g", F.col("out").alias("place"), (F.col("batch") + F.col("hops")).alias("batch"))))
        longer = jumps.select("g", "place", F.col("out").alias("via"), F.col("hops").alias("so_far"))
        jumps = keep(longer.join(hop, on("g", "via")).select("g", "place", "out", (F.col("so_far") + F.col("hops")).alias("hops")))
    # where each block is entered; a block inside one batch is entered nowhere and goes on with the last batch before it
    entered = blocks.join(reached.select(F.col("g").alias("_g"), F.col("place").alias("_p"), "batch"), F.col("g").eqNullSafe(F.col("_g")) & (F.col("place") == F.col("_p"))).select("_part", "g", F.col("place").alias("entry"), "batch", "hops")
    known = linked.select("_part", "g").distinct().join(entered.select(F.col("_part").alias("_q"), F.col("g").alias("_h"), "entry", "batch", "hops"), (F.col("_part") == F.col("_q")) & F.col("g").eqNullSafe(F.col("_h")), "left")
    past = F.last(F.col("batch") + F.col("hops"), ignorenulls=True).over(Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = known.select(F.col("_part").alias("part"), F.col("g").alias("of"), "entry", F.coalesce("batch", past).alias("batch"))

    def number(block: pa.Table, start: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        place, nxt = block.column("place").to_pylist(), block.column("next").to_pylist()
        entry, batch = start.column("entry")[0].as_py(), start.column("batch")[0].as_py() - 1
        out, due = [], entry
        for p, n in zip(place, nxt):
            if p == due:
                batch, due = batch + 1, n
            out.append(batch)
        return pa.table({"g": block.column("g"), "ord": block.column("ord"), "batch": pa.array(out, pa.int32())})

    schema = StructType([StructField("g", g_kind), StructField("ord", ord_kind), StructField("batch", IntegerType())])
    out = linked.groupBy("_part", "g").cogroup(starts.groupBy("part", "of")).applyInArrow(number, schema)
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def child_context(edges: DataFrame, virtual: DataFrame) -> DataFrame:
    """(ea, context, children, least_confidence): pending names of a function's callees, in address order.

    virtual (ea, idb_name, suggested_name, confidence, status, evidence); children already applied under their own name are left out.
    """
    v = virtual.filter((F.coalesce("suggested_name", F.lit("")) != "") & ~((F.col("status") == "applied") & (F.col("suggested_name") == F.col("idb_name")))).select(F.col("ea").alias("child"), "idb_name", "suggested_name", "confidence", "status", F.slice("evidence", 1, 5).alias("evidence"))
    rows = edges.select("caller", "callee").distinct().join(v, F.col("callee") == F.col("child"))
    head = F.concat(F.lit("0x"), F.hex("child"), F.lit(" "), F.col("idb_name"), F.lit(" -> "), F.col("suggested_name"), F.lit(" ("), F.format_string("%.2f", F.col("confidence")), F.lit(", "), F.col("status"), F.lit(")"))
    text = F.concat(head, F.when(F.size("evidence") > 0, F.concat(F.lit(" because "), F.array_join(F.slice("evidence", 1, 3), "; "))).otherwise(""))
    packed = rows.groupBy(F.col("caller").alias("ea")).agg(F.sort_array(F.collect_list(F.struct("child", text.alias("text")))).alias("c"), F.min("confidence").alias("least_confidence"))
    return packed.select("ea", F.concat(F.lit("// Callees may get these names, nobody has confirmed them yet:\n"), F.array_join("c.text", "\n")).alias("context"), F.col("c.child").alias("children"), "least_confidence")


def budget_plan(estimate: DataFrame, max_requests: int = 25) -> DataFrame:
    """(exceeded, message, options) for a request estimate."""
    over = F.col("requests") > max_requests
    message = F.concat(F.lit("This run would send "), F.col("requests"), F.lit(f" requests; {max_requests} are allowed."))
    options = F.array(*[F.lit(o) for o in BUDGET_OPTIONS])
    return estimate.select(over.alias("exceeded"), message.alias("message"), options.alias("options"))
