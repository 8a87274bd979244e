"""Embedding near-dedup with robust-pruned graphs.

Distinct vectors are dealt to regions around centres fitted on samples; every vector has one home region and visits the nearest others. Inside
a region, overlapping cluster shards each give robust-pruned adjacency lists; their union is one flat graph, searched from the
shards' medoids by a beam that keeps expanding while it finds vectors in range. Pairs found are verified in double precision and
counted once, in the one region that both vectors' homes and visits name. An audit measures recall against brute force; below
the level asked for, the regions' overlap is widened, and at last every block is compared by plain products, which is exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import checkpointed, releasing, table
from .components import components
from .simhash import attach

COSINE, RECALL = 0.9, 0.95
#: Home vectors of a region aimed at; vectors (homes and visitors) in a part: a region beyond that is dealt to parts, each meeting each.
REGION, PART = 2000, 8192
#: Vectors, by hash, that the centres of one region's split are fitted on; most centres of one split; rows that a task assigns.
SAMPLE, SPLIT, CHUNK = 20_000, 500, 20_000
#: Queries and vectors of a block of the recall audit; a table of up to EXACT vectors without a link to measure by is compared whole.
ASKED, HELD, EXACT = 1024, 8192, 16_384
#: Vectors of a cluster shard inside a region, shards of a vector, graph degree, candidates for pruning, its slack, beam, queries at a time.
SHARD, SHARDS, DEGREE, CANDIDATES, ALPHA, BEAM, ASK = 400, 2, 16, 32, 1.2, 16, 512


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, id, id2, embedding): id and id2 name equal vectors; null for vectors that link with nothing. Floats stay floats, all else is double."""
    inner = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    kind, dtype = ("float", np.float32) if isinstance(inner, FloatType) else ("double", np.float64)

    def run(batches):
        for batch in batches:
            ids = [[], []]
            for v in batch.column(1):
                x = v.as_py()
                x = None if x is None or None in x else np.array(x, dtype) + dtype(0)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                digest = hashlib.md5(x.tobytes()).digest() if good else None
                for k in (0, 1):
                    ids[k].append(int.from_bytes(digest[8 * k : 8 * k + 8], "little", signed=True) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), batch.column(1)], ["vec_id", "id", "id2", "embedding"])

    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return chosen.mapInArrow(releasing(run), f"vec_id long, id long, id2 long, embedding array<{kind}>")


def _plain(column) -> np.ndarray:
    """Rows in double precision of a list column without nulls, each divided by its largest component so that no square overflows."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows, from evenly spaced ones."""
    middle = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        middle = np.where(length > 0, sums / np.where(length > 0, length, 1), middle)
    return middle


def _nearest(near: np.ndarray, overlap: int, margin: float) -> np.ndarray:
    """Marks, per row of similarities, of the `overlap` largest and of all within margin of the largest."""
    top = -np.sort(-near, axis=1)
    return near >= np.minimum(top[:, 0] - margin, top[:, min(overlap, near.shape[1]) - 1])[:, None]


def pruned_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) edges of a robust-pruned graph over unit rows, reverse edges included."""
    n = len(x)
    if n == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    k = min(CANDIDATES, n - 1)
    picked = np.argpartition(-near, k - 1, axis=1)[:, :k]
    picked = np.take_along_axis(picked, np.argsort(-np.take_along_axis(near, picked, axis=1), axis=1, kind="stable"), axis=1)
    far = 1 - np.take_along_axis(near, picked, axis=1)
    alive, degree, edges = np.ones((n, k), bool), np.zeros(n, np.int64), np.zeros((n, k), bool)
    for j in range(k):
        take = alive[:, j] & (degree < DEGREE)
        edges[take, j] = True
        degree += take
        between = 1 - near[picked[:, j][:, None], picked]
        alive &= ~(take[:, None] & (ALPHA * between <= far))
    a, j = np.nonzero(edges)
    b = picked[a, j]
    return np.concatenate((a, b)), np.concatenate((b, a))


def flat_graph(x: np.ndarray) -> dict:
    """One graph over unit rows x: the union of the pruned lists of overlapping cluster shards, with the shards' medoids as entries.

    The medoids are joined in a chain, and every row that the first one does not reach gets an edge from it.
    """
    n = len(x)
    middle = centres(x, max(1, -(-n // SHARD)), 4)
    mine = _nearest(x @ middle.T, SHARDS, 0.0)
    sources, targets, medoids = [], [], []
    for s in range(len(middle)):
        members = np.flatnonzero(mine[:, s])
        if len(members):
            medoids.append(int(members[(x[members] @ x[members].mean(axis=0)).argmax()]))
            # a crowded shard is cut into runs of nearby rows, neighbours along the centre's similarity, so products stay small
            members = members[np.argsort(-(x[members] @ middle[s]), kind="stable")]
            for at in range(0, len(members), 4 * SHARD):
                part = members[max(0, at - SHARD) : at + 4 * SHARD]
                a, b = pruned_lists(x[part])
                sources.append(part[a])
                targets.append(part[b])
    medoids = np.unique(medoids)
    sources += [medoids[:-1], medoids[1:]]
    targets += [medoids[1:], medoids[:-1]]

    def lists(a, b):
        code = np.unique(a * n + b)
        return np.searchsorted(code // n, np.arange(n + 1)), code % n

    a, b = np.concatenate(sources).astype(np.int64), np.concatenate(targets).astype(np.int64)
    starts, flat = lists(a, b)
    seen, front = np.zeros(n, bool), medoids[:1]
    seen[front] = True
    lost = np.zeros(0, np.int64)
    while True:
        while len(front):
            front = np.unique(_spread(starts, flat, front)[1])
            front = front[~seen[front]]
            seen[front] = True
        if seen.all():
            break
        front = np.flatnonzero(~seen)[:1]
        seen[front] = True
        lost = np.append(lost, front)
    if len(lost):
        starts, flat = lists(np.append(a, np.full(len(lost), medoids[0])), np.append(b, lost))
    return {"starts": starts, "flat": flat, "medoids": medoids}


def _spread(starts: np.ndarray, flat: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in nodes, neighbour) of all neighbours of nodes."""
    sizes = starts[nodes + 1] - starts[nodes]
    who = np.repeat(np.arange(len(nodes)), sizes)
    return who, flat[np.repeat(starts[nodes], sizes) + np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]


def range_search(graph: dict, x: np.ndarray, queries: np.ndarray, cosine: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs in range, found greedily from the three medoids nearest to each query, all queries at once.

    Each round a query expands the best unexpanded rows of its beam, and every row in range not yet expanded; it ends when
    neither is left. Only the beams and the rows met are held, and marks of one bit's worth for the rows met.
    """
    n, q, least = len(x), len(queries), np.float32(cosine - 1e-5)
    starts, flat, medoids = graph["starts"], graph["flat"], graph["medoids"]
    entry = queries @ x[medoids].T
    first = np.argsort(-entry, axis=1, kind="stable")[:, :3]
    seen = np.zeros((q, n), bool)
    rows, places = np.full((q, beam), -1), np.full((q, beam), -2.0, np.float32)
    rows[:, : first.shape[1]], places[:, : first.shape[1]] = medoids[first], np.take_along_axis(entry, first, axis=1)
    np.put_along_axis(seen, medoids[first], True, axis=1)
    done = rows < 0
    hit = np.nonzero(places >= least)
    found = [(hit[0], rows[hit])]
    fresh_q, fresh_v = hit[0], rows[hit]  # in range and met in the last round
    while True:
        # the best two unexpanded rows of each beam; rows in range are expanded by their own list, whether still in the beam or not
        open_ = ~done
        rank = np.cumsum(open_, axis=1)
        who, at = np.nonzero(open_ & (rank <= 2))
        done[who, at] = True
        near = places[who, at] < least
        ask, node = np.concatenate((who[near], fresh_q)), np.concatenate((rows[who, at][near], fresh_v))
        if not len(ask):
            if not (~done).any():
                break
            fresh_q, fresh_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        new_q, new_v, new_s = [], [], []
        for cut in range(0, len(ask), 1 << 15):
            k, to = _spread(starts, flat, node[cut : cut + (1 << 15)])
            code = np.unique(ask[cut : cut + (1 << 15)][k] * n + to)
            code = code[~seen.ravel()[code]]
            seen.ravel()[code] = True
            for part in np.array_split(code, max(1, len(code) >> 16)):
                a, b = part // n, part % n
                new_q.append(a)
                new_v.append(b)
                new_s.append(np.einsum("ij,ij->i", queries[a], x[b]))
        a, b, s = np.concatenate(new_q), np.concatenate(new_v), np.concatenate(new_s)
        close = s >= least
        fresh_q, fresh_v = a[close], b[close]
        found.append((fresh_q, fresh_v))
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        kept = nth < beam
        a, b, s, nth = a[kept], b[kept], s[kept], nth[kept]
        changed, place = np.unique(a, return_inverse=True)
        if len(changed):
            more_v, more_s = np.full((len(changed), beam), -1), np.full((len(changed), beam), -2.0, np.float32)
            more_v[place, nth], more_s[place, nth] = b, s
            all_v, all_s = np.concatenate((rows[changed], more_v), axis=1), np.concatenate((places[changed], more_s), axis=1)
            all_d = np.concatenate((done[changed], more_v < 0), axis=1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            rows[changed], places[changed], done[changed] = (np.take_along_axis(m, best, axis=1) for m in (all_v, all_s, all_d))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def block_links(raw: np.ndarray, held: np.ndarray, asking: np.ndarray, cosine: float, exact: bool) -> np.ndarray:
    """Verified marks, held x asking, of the pairs of rows of raw with at least the cosine; found on the graph, or with exact by product."""
    unit = _unit(raw)
    near = np.zeros((len(held), len(asking)), bool)
    x = unit[held].astype(np.float32)
    graph = None if exact else flat_graph(x)
    for at in range(0, len(asking), ASK):
        q = unit[asking[at : at + ASK]].astype(np.float32)
        if exact:
            near[:, at : at + ASK] = x @ q.T >= np.float32(cosine - 1e-5)
        else:
            who, row = range_search(graph, x, q, cosine)
            near[row, at + who] = True
    if len(held) == len(asking) and (held == asking).all():
        near |= near.T
    a, b = np.nonzero(near)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        near[i, j] = np.einsum("ij,ij->i", unit[held[i]], unit[asking[j]]) >= cosine
    return near


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number reachable from each of n nodes over the links a, b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def regions(distinct: DataFrame, n: int, overlap: int, margin: float, region: int = REGION) -> DataFrame:
    """(region, home, id, embedding): every vector once with home true, and once for each other region that it visits.

    Starts from one region of all and splits those with over twice `region` homes, each by centres fitted on a bounded sample of its
    own, until none is left or a round makes no more of them. Tasks hold CHUNK rows and one region's centres.
    """
    kind = distinct.schema["embedding"].dataType.simpleString()
    members = distinct.select(F.lit(0).cast("long").alias("region"), F.lit(True).alias("home"), "id", "embedding")
    largest, schema = float("inf"), f"region long, home boolean, id long, embedding {kind}"
    for level in range(4):
        sizes = checkpointed(members.groupBy("region").agg(F.count_if("home").alias("n"), F.count("*").alias("rows")).filter(F.col("n") > 2 * region))
        most = sizes.agg(F.max("n")).first()[0]
        if most is None or most > 0.9 * largest:
            break
        largest = most
        sizes = sizes.withColumns({"salts": F.ceil(F.col("rows") / CHUNK).cast("int"), "parts": F.least(F.lit(SPLIT), F.ceil(F.col("n") / region)).cast("int")})
        rows = attach(members, sizes, "region") if level else members.crossJoin(F.broadcast(sizes.select("rows", "salts", "parts")))  # one row
        sample = rows.filter(F.col("home") & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("rows")))

        def fit(group):
            order = np.argsort(group.column("id").to_numpy())
            middle = centres(_unit(_plain(group.column("embedding")))[order], int(group.column("parts")[0].as_py()))
            return pa.table({"region": pa.array([group.column("region")[0].as_py()] * len(middle), pa.int64()), "centre": pa.array(middle.tolist(), pa.list_(pa.float64())), "salts": pa.array([group.column("salts")[0].as_py()] * len(middle), pa.int32())})

        middles = checkpointed(sample.select("region", "id", "embedding", "parts", "salts").groupBy("region").applyInArrow(fit, "region long, centre array<double>, salts int"))
        given = middles.select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "centre")
        salted = rows.select("region", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "home", "id", "embedding")

        def assign(left, right):
            if not left.num_rows or not right.num_rows:
                return left.select(["region", "home", "id", "embedding"])
            middle = np.array(right.column("centre").to_pylist())
            middle = middle[np.lexsort(middle.T[::-1])]
            near = _unit(_plain(left.column("embedding"))) @ middle.T
            row, at = np.nonzero(_nearest(near, overlap if level == 0 else 2, margin))
            home = left.column("home").to_numpy()[row] & (near.argmax(axis=1)[row] == at)
            base = left.column("region")[0].as_py() * (SPLIT + 1) + 1
            taken = left.take(pa.array(row))
            return pa.table({"region": pa.array(base + at, pa.int64()), "home": pa.array(home), "id": taken.column("id"), "embedding": taken.column("embedding")})

        dealt = salted.groupBy("region", "salt").cogroup(given.groupBy("region", "salt")).applyInArrow(assign, schema)
        rest = members.join(sizes.select("region"), "region", "left_anti") if level else None
        members = checkpointed(dealt if rest is None else dealt.unionByName(rest.select(*dealt.columns)))
    # a vector may come to a region by two ways
    return members.groupBy("region", "id").agg(F.max("home").alias("home"), F.first("embedding").alias("embedding"))


def found_links(distinct: DataFrame, n: int, cosine: float, overlap: int, margin: float, region: int = REGION, part: int = PART, exact: bool = False) -> DataFrame:
    """(id, n, root) rows: how many vectors (copies counted) a block links to id, and the least id that id is joined to in that block.

    A pair of homes A and B is counted in A if B's vector visits A, else in B; in the smaller of both if both visit. Pairs of visitors are
    left to others. So every link is counted in one block, and blocks give rows for vectors, not for links.
    """
    if exact:
        members = distinct.select(F.lit(0).cast("long").alias("region"), F.lit(True).alias("home"), "id", "embedding")
    else:
        members = regions(distinct, n, overlap, margin, region)
    members = checkpointed(members.join(distinct.select("id", F.col("n").alias("mass")), "id"))
    stays = members.groupBy("id").agg(F.max(F.when(F.col("home"), F.col("region"))).alias("home_region"), F.sort_array(F.collect_list("region")).alias("visits"))
    sizes = checkpointed(members.groupBy("region").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part).cast("int")))
    placed = attach(members, sizes, "region").join(stays, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "home", "home_region", "visits", "mass", "embedding")

    def search(key, group):
        here, i, j = (k.as_py() for k in key)
        group = group.take(pa.array(np.argsort(group.column("id").to_numpy(), kind="stable")))
        own, home, ids = (group.column(c).to_numpy() for c in ("own", "home", "id"))
        held = np.flatnonzero(own == i)
        # visitors of one part need not ask: what they link with among the homes, the homes find
        asking = held[home[held]] if i == j else np.flatnonzero(own == j)
        none = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(held) or not len(asking):
            return none
        near = block_links(_plain(group.column("embedding")), held, asking, cosine, exact)
        if i == j:
            near, half = np.zeros((len(held), len(held)), bool), near
            near[:, np.searchsorted(held, asking)] = half
            near = np.triu(near | near.T, 1)
            asking = held
        # a pair of a home and a visitor whose home B comes before this region is B's, if the first visits B
        x, y = np.nonzero(near)
        a, b = held[x], asking[y]
        mine = home[a] & home[b]
        abroad = np.flatnonzero(home[a] != home[b])
        if len(abroad):
            visits, homes = group.column("visits").to_pylist(), group.column("home_region").to_numpy()
            local, guest = np.where(home[a[abroad]], a[abroad], b[abroad]), np.where(home[a[abroad]], b[abroad], a[abroad])
            mine[abroad] = [homes[g] > here or homes[g] not in visits[v] for v, g in zip(local.tolist(), guest.tolist())]
        a, b = a[mine], b[mine]
        if not len(a):
            return none
        mass = group.column("mass").to_numpy()
        total = np.bincount(a, mass[b], len(ids)) + np.bincount(b, mass[a], len(ids))
        root = _forest(len(ids), a, b)
        some = np.flatnonzero(total > 0)
        return pa.table({"id": pa.array(ids[some]), "n": pa.array(total[some].astype(np.int64)), "root": pa.array(ids[root[some]])})

    return spread.groupBy("region", "i", "j").applyInArrow(search, "id long, n long, root long")


def audit(distinct: DataFrame, n: int, found: DataFrame, cosine: float, rests: tuple[int, ...] = (0,)) -> float | None:
    """Share of the true links of the audit's queries that found (id, links) holds, by brute force against all n vectors; None without any.

    The queries are all vectors with a vec_id that leaves one of `rests` when divided by 50. They meet all vectors block by block.
    """
    asked = distinct.filter(F.arrays_overlap("rests", F.array(*[F.lit(r) for r in rests])))
    groups, blocks = max(1, -(-asked.count() // ASKED)), max(1, -(-n // HELD))
    spread = lambda k: F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(k)).cast("int")
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.select(spread(groups).alias("i"), upto(blocks).alias("j"), F.col("id").alias("q"), F.col("embedding").alias("e"))
    right = distinct.select(upto(groups).alias("i"), spread(blocks).alias("j"), "n", "embedding")

    def run(queries, held):
        total = np.zeros(queries.num_rows)
        if queries.num_rows and held.num_rows:
            x, mass = _unit(_plain(queries.column("e"))), held.column("n").to_numpy()
            y = _unit(_plain(held.column("embedding")))
            for at in range(0, len(y), ASKED):
                total += mass[at : at + ASKED] @ (y[at : at + ASKED] @ x.T >= cosine)
        return pa.table({"q": queries.column("q"), "m": pa.array(total.astype(np.int64))})

    true = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "q long, m long").groupBy("q").agg(F.sum("m").alias("m"))
    held = true.join(found.select("id", "links"), F.col("q") == F.col("id"), "left").join(distinct.select(F.col("id").alias("_d"), "n"), F.col("q") == F.col("_d"))
    got = held.agg(F.sum(F.coalesce("links", F.lit(0))).alias("found"), F.sum(F.col("m") - F.col("n")).alias("true")).first()
    return got["found"] / got["true"] if got["true"] else None


def vector_classes(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, region: int = REGION, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for every row of vectors (vec_id, embedding).

    Equal vectors form one class, link with one another and are searched once. Vectors of different lengths never
    link; null, zero, empty and non-finite ones, or ones with a null component, link with nothing and are their own component.
    kept is vec_id = component_id (false without vec_id). Repeated rows count as further vectors. recall is what the audit measured for the
    vector's length. Where its queries have no links to find, those of seven more remainders of vec_id are asked; where they have none
    either, up to EXACT vectors are compared whole (recall 1), and for more recall is null: of an eighth of all rows none has a link.
    """
    rows = checkpointed(keyed(vectors))
    asked = F.collect_set((F.col("vec_id") % 50).cast("int")).alias("rests")
    distinct = checkpointed(rows.filter("id IS NOT NULL").groupBy("id", "id2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), asked, F.first("embedding").alias("embedding")))
    every = None
    for size in sorted(r[0] for r in distinct.select(F.size("embedding").alias("d")).distinct().collect()):
        same = distinct.filter(F.size("embedding") == size)
        n, overlap, margin = same.count(), 3, 0.08
        while True:
            exact = overlap > 12
            found = checkpointed(found_links(same, n, cosine, overlap, margin, region, part, exact))
            links = found.groupBy("id").agg(F.sum("n").alias("links"))
            measured = 1.0 if exact else audit(same, n, links, cosine)
            if measured is None:
                measured = audit(same, n, links, cosine, tuple(range(1, 8)))
            if measured is None and n <= EXACT:
                overlap = 13  # the next turn is exact
                continue
            if exact or measured is None or measured >= recall:
                break
            overlap, margin = overlap * 2, margin * 2
        found = found.withColumn("recall", F.lit(measured).cast("double"))
        sizes = same.select("id", F.lit(measured).cast("double").alias("recall"))
        every = (found, sizes) if every is None else (every[0].union(found), every[1].union(sizes))
    alone = rows.filter("id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    if every is not None:
        found, sizes = every
        links = found.groupBy("id").agg(F.sum("n").alias("links"))
        roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        named = distinct.select("id", "least", "n").join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left").join(sizes, "id")
        named = checkpointed(named.select("id", "least", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"), "recall"))
        least = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
        classes = attach(named.select("id", F.col("n").alias("copies"), "n_links", "recall", "root"), least, "root").select("id", F.col("copies").alias("n"), "n_links", "component_id", "recall")
        alone = attach(rows.filter("id IS NOT NULL").select("vec_id", "id"), checkpointed(classes), "id").select("vec_id", "n_links", "component_id", "recall").unionByName(alone)
    return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).select("vec_id", "n_links", "component_id", "kept", "recall")


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_classes(table(spark, sf_dir, "embeddings"))
