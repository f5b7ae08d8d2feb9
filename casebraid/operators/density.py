"""Density clustering of vectors within groups (CLU-07, CLU-08): HDBSCAN as joins over blocks, edges and chains.

All groups go through the same steps at once; nothing is done group by group, and no group meets in one task.

1. Points are dealt to blocks of about `block` points near one pivot. Blocks meet in pairs, where their centres and radii
   leave a chance, for each point's k nearest neighbours: the last is its core distance. A matrix product in single
   precision tells, within its error, what may be near; only that is measured. A task holds a team of blocks while others
   stream past it, so that a block travels once to a team and not once to a block.
2. The forest of the edges to denser neighbours is nearly the minimum spanning tree of mutual reachability. Its merge tree
   puts the points in an order in which the heaviest edge on the way between two points is the heaviest of the gaps between
   them. Blocks of that order meet in pairs, where their gaps leave a chance, and yield the edges that are lighter than
   that (first, where the forest is several trees, edges between them). By the cycle property the tree of the whole group
   is among these edges and the forest's. A group of up to two blocks' points has its tree at once.
3. Boruvka rounds over the edges contract the tree level by level. An edge that is contracted into a node below the
   node's lightest outgoing edge belongs to that node's chain of the merge tree; one that is not rises to the next level.
   Sorted by weight the chains are the whole merge tree, and cluster sizes are running sums along them.
4. Edges with two large sides cut the chains into the clusters of the condensed tree. Stabilities are sums over edges;
   the choice of the clusters with most excess of mass takes rounds in the logarithm of their number.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .working import Working, numbered, roots

NOISE = -1
#: Points of a block, about; two blocks' distances are what a task holds.
BLOCK = 1024
#: Pivots of all groups together, about; twice as many are never exceeded, which bounds what is broadcast.
PIVOTS = 4096
#: Teams of blocks, about, and the most blocks of a team: till there what travels grows as the points do.
TEAMS = 32
TEAM = 64
#: Edges that a task holds before it keeps their forest alone.
HELD = 1 << 20
#: Smaller distances count as this one, so that repeated points have a finite density.
LEAST_DISTANCE = 1e-12
#: Edges of a chain that are summed in one window.
RUN = 1 << 16

_BLOCK = "b long, grp long, nodes array<long>, data binary, near binary, ids binary, k int, center array<double>, radius double, kth double"
#: Blocks in the order of the merge tree. gap: the heaviest edges between a point and the one before it, own: their
#: largest weight behind the first point, and top: the heaviest of all.
_LEAVES = "b long, grp long, nodes array<long>, data binary, core binary, tree binary, gap binary, center array<double>, radius double, own double, trees int, top struct<r: long, w: double, u: long, v: long>"
_EDGE = "u long, v long, w double"
_GAP = np.dtype([("r", np.int64), ("w", np.float64), ("u", np.int64), ("v", np.int64)])


@contextmanager
def _few_rows(spark: SparkSession, rows: int = 32):
    """Arrow batches of few rows, for rows that hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width) if width else np.zeros((0, 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product; where that cancels, from the differences."""
    middle = x.mean(axis=0)
    x, y = x - middle, y - middle
    xx, yy = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :]
    square = np.maximum(xx + yy - 2 * (x @ y.T), 0)
    a, b = np.nonzero(square <= 1e-6 * (xx + yy))
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        square[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(square)


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, in single precision where the numbers allow it, and for each x how far
    they can be from the exact ones.
    """
    middle = x.mean(axis=0)
    x, y = x - middle, y - middle
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    kind = np.float32 if 1e-25 < xx.max() + yy.max() < 1e30 else np.float64
    left, right = np.ones((len(x), x.shape[1] + 2), kind), np.ones((y.shape[1] + 2, len(y)), kind)
    left[:, :-2], left[:, -2] = x, xx
    right[:-2], right[-1] = -2 * y.T, yy
    return left @ right, (2 * x.shape[1] + 32) * np.finfo(kind).eps * (xx + yy.max())


def _measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j) from the differences."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = np.sqrt(((x[i[part]] - y[j[part]]) ** 2).sum(axis=1))
    return out


def _places(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where far is not true, row by row; rows that are true throughout, which are most, cost little."""
    rows = np.flatnonzero(~far.all(axis=1))
    i, j = np.divmod(np.flatnonzero(~far[rows]), far.shape[1])
    return rows[i], j


def _nearest(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of each x to the others, ascending and from the differences, and whose they are; inf and -1 where there are fewer."""
    d = _distances(x, x)
    np.fill_diagonal(d, np.inf)
    out, whose = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
    few = min(k, len(x) - 1)
    if few > 0:
        at = np.argpartition(d, few - 1, axis=1)[:, :few]
        out[:, :few], whose[:, :few] = np.sqrt(((x[:, None, :] - x[at]) ** 2).sum(axis=2)), ids[at]
    order = np.argsort(out, axis=1)
    return np.take_along_axis(out, order, 1), np.take_along_axis(whose, order, 1)


def _nearer(x: np.ndarray, near: np.ndarray, whose: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
    """Puts those of y that are nearer into near and whose, as _nearest gives them."""
    kth = near[:, -1]
    with np.errstate(all="ignore"):
        square, off = _squares(x, y)
        # what is no number may be near
        far = square > np.where(kth > 0, kth * kth + off, -np.inf).astype(square.dtype)[:, None]
    i, j = _places(far)
    d = _measured(x, y, i, j)
    less = d < kth[i]
    i, j, d = i[less], j[less], d[less]
    if len(i):
        rows, first, counts = np.unique(i, return_index=True, return_counts=True)
        k = near.shape[1]
        every, names = np.full((len(rows), k + counts.max()), np.inf), np.full((len(rows), k + counts.max()), -1)
        every[:, :k], names[:, :k] = near[rows], whose[rows]
        row = np.repeat(np.arange(len(rows)), counts)
        at = k + np.arange(len(i)) - first[row]
        every[row, at], names[row, at] = d, ids[j]
        order = np.argsort(every, axis=1, kind="stable")[:, :k]
        near[rows], whose[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)


def _tree(nodes: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Edges (places) of the minimum spanning tree by Prim, equal weights in the order of the smaller and larger node."""
    n = len(nodes)
    best, source, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    found, at = [], 0
    out[0] = False
    for _ in range(n - 1):
        lo, hi = np.minimum(nodes, nodes[at]), np.maximum(nodes, nodes[at])
        new = weight[at]
        better = out & ((new < best) | ((new == best) & ((lo < low) | ((lo == low) & (hi < high)))))
        best[better], source[better], low[better], high[better] = new[better], at, lo[better], hi[better]
        least = best[out].min()
        tied = np.flatnonzero(out & (best == least))
        at = int(tied[np.lexsort((high[tied], low[tied]))[0]]) if len(tied) > 1 else int(tied[0])
        out[at] = False
        found.append((int(source[at]), at))
    return found


def _forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning forest of edges in the order of w, u, v, by rounds of Boruvka."""
    order = np.lexsort((v, u, w))
    u, v, w = u[order], v[order], w[order]
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    of, keep, left = np.arange(len(nodes)), np.zeros(len(u), bool), np.arange(len(u))
    while True:
        x, y = of[a[left]], of[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return u[keep], v[keep], w[keep]
        least = np.full(len(nodes), len(u))
        np.minimum.at(least, x, left)
        np.minimum.at(least, y, left)
        roots_ = np.flatnonzero(least < len(u))
        edge = least[roots_]
        keep[edge] = True
        to = np.arange(len(nodes))
        to[roots_] = of[a[edge]] + of[b[edge]] - roots_
        mutual = (to[to] == np.arange(len(nodes))) & (np.arange(len(nodes)) < to)
        to[mutual] = np.flatnonzero(mutual)
        while (to[to] != to).any():
            to = to[to]
        of = to[of]


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _edge_batch(u, v, w) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(u, v), np.maximum(u, v), w)], names=["u", "v", "w"])


def _blocks(live: DataFrame, width: int, block: int, working: Working) -> DataFrame:
    """Points (node, grp, n, k, vec) in blocks, each with its centre, radius and the distances within it."""
    total = live.select("grp", "n").distinct().agg(F.sum("n")).first()[0] or 1
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.least(F.ceil(F.col("n") / block), F.greatest(F.lit(2), F.floor(F.lit(float(PIVOTS)) * F.col("n") / total)))
    chosen = live.where(F.col("n") > 2 * block).where(place < wanted / F.col("n")).select("grp", "node", "vec", place.alias("place")).orderBy("place").limit(2 * PIVOTS).collect()
    pivots: dict[int, list] = {}
    for row in sorted(chosen, key=lambda r: r["node"]):
        pivots.setdefault(row["grp"], []).append(row["vec"])
    held = live.sparkSession.sparkContext.broadcast({g: np.array(p) for g, p in pivots.items()})

    def deal(batches):
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cell = np.zeros(len(grp), np.int32)
            for g in np.unique(grp).tolist():
                if g in held.value:
                    mine = grp == g
                    cell[mine] = _distances(x[mine], held.value[g]).argmin(axis=1)
            yield batch.append_column("cell", pa.array(cell))

    dealt = working.save(live.mapInArrow(deal, "node long, grp long, n long, k int, vec array<double>, cell int"), "dealt")
    # two blocks' points fit one: a group of so few has its tree at once
    sizes = dealt.groupBy("grp", "cell", "n").agg(F.count("*").alias("here")).select("grp", "cell", F.when(F.col("n") <= 2 * block, 1).otherwise(F.ceil(F.col("here") / block)).alias("parts"))
    parted = dealt.join(sizes, ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")))
    names = numbered(parted.select("grp", "cell", "part").distinct(), ["grp", "cell", "part"], "b", working)
    gathered = parted.join(names, ["grp", "cell", "part"]).groupBy("b", "grp", "k").agg(F.array_sort(F.collect_list(F.struct("node", "vec"))).alias("p"))

    def describe(batches):
        for row in _rows(batches):
            x, k = np.array([p["vec"] for p in row["p"]], np.float64).reshape(len(row["p"]), width), row["k"]
            center = x.mean(axis=0)
            nodes = [p["node"] for p in row["p"]]
            near, whose = _nearest(x, np.array(nodes), k)
            one = {"b": row["b"], "grp": row["grp"], "nodes": nodes, "data": x.tobytes(), "near": near.tobytes(), "ids": whose.tobytes(), "k": k}
            one |= {"center": center.tolist(), "radius": float(np.sqrt(((x - center) ** 2).sum(axis=1)).max()), "kth": float(near[:, -1].max())}
            yield pa.RecordBatch.from_pylist([one], schema=pa.schema([("b", pa.int64()), ("grp", pa.int64()), ("nodes", pa.list_(pa.int64())), ("data", pa.binary()), ("near", pa.binary()), ("ids", pa.binary()), ("k", pa.int32()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("kth", pa.float64())]))

    with _few_rows(live.sparkSession):
        return working.save(gathered.select("b", "grp", "k", "p").mapInArrow(describe, _BLOCK), "blocks")


def _gaps(blocks: DataFrame) -> DataFrame:
    """grp, a, b of the blocks of one group, a <> b: the least distance that their points can have."""
    seat = F.row_number().over(Window.partitionBy("grp").orderBy("b")) - 1
    small = blocks.select("b", "grp", "center", "radius", seat.alias("seat"))
    seats = small.groupBy("grp").agg(F.count("*").alias("seats")).where("seats > 1")
    asked = small.join(seats, "grp").select("grp", F.col("b").alias("a"), F.col("center").alias("c"), F.col("radius").alias("r"), F.col("seat").alias("own"), F.explode(F.sequence(F.lit(0), F.col("seats") - 1)).alias("seat"))
    both = asked.where("seat <> own").join(small, ["grp", "seat"])
    apart = F.sqrt(F.aggregate(F.zip_with("c", "center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    reach = F.col("r") + F.col("radius")
    # a little less, for rounding
    return both.select("grp", "a", "b", F.greatest(F.lit(0.0), apart - reach - 1e-9 * (apart + reach)).alias("least"))


def _streamed(blocks: DataFrame, pairs: DataFrame, columns: list[str], own: list[str], run, schema: str) -> DataFrame:
    """run over rows sorted by team: the team's own blocks b (hosts null) come first, with columns and own, then other
    blocks with columns and the hosts of the team that they meet. pairs: host, guest and what else hosts shall hold.
    """
    size = max(1, min(TEAM, -(-blocks.count() // TEAMS)))
    team = lambda c: F.floor(F.col(c) / size).alias("team")
    told = F.struct("host", *(c for c in pairs.columns if c not in ("host", "guest")))
    met = pairs.groupBy(team("host"), F.col("guest").alias("b")).agg(F.array_sort(F.collect_list(told)).alias("hosts"))
    hosts = blocks.select(team("b"), F.lit(None).cast(met.schema["hosts"].dataType).alias("hosts"), "b", *columns, *own)
    guests = met.join(blocks.select("b", *columns), "b")
    rows = hosts.unionByName(guests, allowMissingColumns=True).withColumn("later", F.col("hosts").isNotNull()).repartition("team")
    return rows.sortWithinPartitions("team", "later").mapInArrow(run, schema)


def _balanced(pairs: DataFrame, *more: str) -> DataFrame:
    """a, b to host, guest, so that each block is host of half of its pairs."""
    even = F.pmod(F.col("a") + F.col("b"), F.lit(2)) == 0
    return pairs.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("guest"), *more)


def _with_cores(blocks: DataFrame, gaps: DataFrame, width: int, working: Working) -> DataFrame:
    """Blocks with core, each point's distance to its k-th neighbour in the whole group, and the ids of these neighbours."""

    def told(held):
        for b, (_, near, whose) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([np.ascontiguousarray(near[:, -1]).tobytes()], pa.binary()), pa.array([whose.tobytes()], pa.binary())], names=["b", "core", "ids"])

    def run(batches):
        team, held = None, {}
        for row in _rows(batches):
            if row["hosts"] is None:
                if row["team"] != team:
                    yield from told(held)
                    team, held = row["team"], {}
                shape = -1, row["k"]
                held[row["b"]] = _matrix(row["data"], width), np.frombuffer(row["near"], np.float64).reshape(shape).copy(), np.frombuffer(row["ids"], np.int64).reshape(shape).copy()
            else:
                guest, ids = _matrix(row["data"], width), np.array(row["nodes"])
                for host in row["hosts"]:
                    _nearer(*held[host["host"]], guest, ids)
        yield from told(held)

    near = gaps.join(blocks.select(F.col("b").alias("a"), "kth"), "a").where("least <= kth")
    with _few_rows(blocks.sparkSession):
        cores = _streamed(blocks, near.select(F.col("a").alias("host"), F.col("b").alias("guest")), ["nodes", "data"], ["near", "ids", "k"], run, "b long, core binary, ids binary")
        return working.save(blocks.select("b", "grp", "k", "nodes", "data").join(cores, "b"), "cores")


def _own_tree(blocks: DataFrame, width: int) -> DataFrame:
    """u < v and w: the minimum spanning tree of each block."""

    def run(batches):
        for row in _rows(batches):
            nodes, x, core = np.array(row["nodes"]), _matrix(row["data"], width), np.frombuffer(row["core"], np.float64)
            found = _tree(nodes, np.maximum(np.maximum(core[:, None], core[None, :]), _distances(x, x)))
            if found:
                a, b = np.array(found).T
                yield _edge_batch(nodes[a], nodes[b], np.maximum(np.maximum(core[a], core[b]), _measured(x, x, a, b)))

    return blocks.mapInArrow(run, _EDGE)


def _points(blocks: DataFrame, width: int) -> DataFrame:
    """node, grp, core, vec of the points of blocks."""

    def run(batches):
        for row in _rows(batches):
            n = len(row["nodes"])
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(np.frombuffer(row["data"], np.float64)))
            yield pa.RecordBatch.from_arrays([pa.array(row["nodes"]), pa.array(np.full(n, row["grp"])), pa.array(np.frombuffer(row["core"], np.float64)), vec], names=["node", "grp", "core", "vec"])

    return blocks.mapInArrow(run, "node long, grp long, core double, vec array<double>")


def _to_denser(blocks: DataFrame, points: DataFrame) -> DataFrame:
    """u < v and w: edges of points to those of their neighbours that are denser; they weigh the point's core distance."""

    def run(batches):
        for row in _rows(batches):
            k, core, q = row["k"], np.frombuffer(row["core"], np.float64), np.frombuffer(row["ids"], np.int64)
            p, w, there = np.repeat(np.array(row["nodes"]), k), np.repeat(core, k), q >= 0
            yield pa.RecordBatch.from_arrays([pa.array(c[there]) for c in (p, q, w)], names=["p", "q", "w"])

    met = blocks.mapInArrow(run, "p long, q long, w double").join(points.select(F.col("node").alias("q"), "core"), "q")
    return met.where("core < w or (core = w and q < p)").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), "w")


def _copies(points: DataFrame) -> DataFrame:
    """node, of: points with at least as many others at their place as count for the core distance, and the first one
    there. That edge of weight 0 is in the tree, and the first one's other edges come before theirs.
    """
    here = points.where("core = 0").select("node", "grp", F.transform("vec", lambda x: x + 0.0).alias("at"))
    return here.join(here.groupBy("grp", "at").agg(F.min("node").alias("of")), ["grp", "at"]).where("node <> of").select("node", "of")


def _leaves(points: DataFrame, edges: DataFrame, chains: DataFrame, first: DataFrame, width: int, block: int, working: Working) -> DataFrame:
    """Points in blocks in the order of the merge tree, with the heaviest edge between each point and the one before it.

    A point's path names, from the root, a chain, the edge of it where the next chain hangs, that chain and so on, at last
    the point. Two paths part at a chain's edges, of which the later one joins them, or behind an edge that both hang on.
    """
    tops = chains.select("c", "top").distinct().join(chains.select(F.col("r").alias("top"), F.col("c").alias("up")), "top", "left")
    now, step = working.save(tops.select("c", "up", F.when(F.col("top").isNull(), F.array("c")).otherwise(F.array("top", "c")).alias("path")), "paths0"), 0
    while not now.where("up is not null").isEmpty():
        step += 1
        above = now.select(F.col("c").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        longer = F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path"))
        now = working.save(now.join(above, "up", "left").select("c", F.col("next").alias("up"), longer.alias("path")), f"paths{step}")
    hung = first.join(chains.select(F.col("r").alias("f"), "c"), "f").join(now.select("c", "path"), "c")
    hung = hung.select(F.col("s").alias("node"), F.concat("path", F.array(F.col("f"), -1 - F.col("s"))).alias("path"))
    placed = points.join(hung, "node", "left").withColumn("path", F.coalesce("path", F.array(-1 - F.col("node"))))
    ordered = numbered(placed, ["grp", "path"], "pos", working)

    before = ordered.select((F.col("pos") + 1).alias("pos"), F.col("path").alias("before"))
    at = F.array_position(F.zip_with("path", "before", lambda x, y: x.eqNullSafe(y)), False).cast("int")
    parted = ordered.join(before, "pos", "left").withColumn("at", at)
    edge = F.when(F.col("at") % 2 == 0, F.greatest(F.get("path", F.col("at") - 1), F.get("before", F.col("at") - 1))).when(F.col("at") > 1, F.get("path", F.col("at") - 2))
    parted = parted.select("grp", "pos", "node", "core", "vec", F.get("path", F.lit(0)).alias("tree"), edge.alias("r")).join(edges.select("r", "w", "u", "v"), "r", "left")
    parted = parted.join(ordered.groupBy("grp").agg(F.min("pos").alias("begin")), "grp").withColumn("part", F.floor((F.col("pos") - F.col("begin")) / block))
    names = numbered(parted.select("grp", "part").distinct(), ["grp", "part"], "b", working)
    gathered = parted.join(names, ["grp", "part"]).groupBy("b", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "core", "tree", "r", "w", "u", "v", "vec"))).alias("p"))

    def describe(batches):
        for row in _rows(batches):
            p = row["p"]
            x = np.array([q["vec"] for q in p], np.float64).reshape(len(p), width)
            # before the first point of a tree: heavier than all
            gap = np.array([(np.iinfo(np.int64).max, np.inf, 0, 0) if q["r"] is None else (q["r"], q["w"], q["u"], q["v"]) for q in p], _GAP)
            center, top = x.mean(axis=0), gap[gap["r"].argmax()]
            one = {"b": row["b"], "grp": row["grp"], "nodes": [q["node"] for q in p], "data": x.tobytes(), "core": np.array([q["core"] for q in p]).tobytes(), "tree": np.array([q["tree"] for q in p]).tobytes(), "gap": gap.tobytes()}
            one |= {"center": center.tolist(), "radius": float(np.sqrt(((x - center) ** 2).sum(axis=1)).max()), "own": float(gap["w"][1:].max(initial=0)), "trees": int(np.isinf(gap["w"]).sum()), "top": dict(zip(_GAP.names, top.tolist(), strict=True))}
            yield pa.RecordBatch.from_pylist([one], schema=pa.schema([("b", pa.int64()), ("grp", pa.int64()), ("nodes", pa.list_(pa.int64())), ("data", pa.binary()), ("core", pa.binary()), ("tree", pa.binary()), ("gap", pa.binary()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("own", pa.float64()), ("trees", pa.int32()), ("top", pa.struct([("r", pa.int64()), ("w", pa.float64()), ("u", pa.int64()), ("v", pa.int64())]))]))

    with _few_rows(points.sparkSession):
        return working.save(gathered.mapInArrow(describe, _LEAVES), "leaves")


def _over_leaves(leaves: DataFrame, pairs: DataFrame, width: int, own, met) -> DataFrame:
    """The forests of the edges u, v, w that own(block) and met(earlier, later, host) give, a task's in one."""

    def least(found):
        return _forest(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def run(batches):
        team, held, found = None, {}, []
        for row in _rows(batches):
            one = row["b"], np.array(row["nodes"]), _matrix(row["data"], width), np.frombuffer(row["core"], np.float64), np.frombuffer(row["tree"], np.int64), np.frombuffer(row["gap"], _GAP)
            if row["hosts"] is None:
                if row["team"] != team:
                    if found:
                        yield _edge_batch(*least(found))
                    team, held, found = row["team"], {}, []
                held[row["b"]] = one
                more = [own(one)]
            else:
                more = [met(*sorted((held[host["host"]], one), key=lambda block: block[0]), host) for host in row["hosts"]]
            found += [edges for edges in more if len(edges[0])]
            if sum(len(edges[0]) for edges in found) > HELD + (len(found[0][0]) if found else 0):
                found = [least(found)]
        if found:
            yield _edge_batch(*least(found))

    return _streamed(leaves, pairs, ["nodes", "data", "core", "tree", "gap"], [], run, _EDGE)


def _weighed(a, b, i, j):
    """u < v and w of the edges of the points i of block a with the points j of block b."""
    u, v = a[1][i], b[1][j]
    return np.minimum(u, v), np.maximum(u, v), np.maximum(np.maximum(a[3][i], b[3][j]), _measured(a[2], b[2], i, j))


def _between_trees(a, b, host=None):
    """Edges of two blocks, one for each pair of trees and about the lightest."""
    starts = [np.flatnonzero(np.concatenate([[True], block[4][1:] != block[4][:-1]])) for block in (a, b)]
    with np.errstate(all="ignore"):
        square = np.nan_to_num(_squares(a[2], b[2])[0], copy=False, nan=np.inf, posinf=np.inf)
        weight = np.maximum(np.maximum(square, (a[3] ** 2).astype(square.dtype)[:, None]), (b[3] ** 2).astype(square.dtype)[None, :])
    least = np.minimum.reduceat(np.minimum.reduceat(weight, starts[0], axis=0), starts[1], axis=1)
    least[a[4][starts[0]][:, None] == b[4][starts[1]][None, :]] = -np.inf
    s, t = (np.searchsorted(start, np.arange(len(block[1])), side="right") - 1 for start, block in zip(starts, (a, b), strict=True))
    i, j = _places(weight > least[s][:, t])
    _, one = np.unique(s[i] * len(starts[1]) + t[j], return_index=True)
    return _weighed(a, b, i[one], j[one])


def _lighter(a, b, i, j, bound):
    """Edges of the pairs (i, j) that come before the edges bound."""
    u, v, w = _weighed(a, b, i, j)
    less = (w < bound["w"]) | ((w == bound["w"]) & ((u < bound["u"]) | ((u == bound["u"]) & (v < bound["v"]))))
    return u[less], v[less], w[less]


def _lighter_within(a):
    """Edges between points of a block that are lighter than the heaviest gap between them."""
    gap, core, n = a[5], a[3], len(a[1])
    later = np.arange(n)[:, None] < np.arange(n)[None, :]
    at = np.argsort(gap["r"])
    rank = np.empty(n, np.int64)
    rank[at] = np.arange(n)
    rank = np.maximum.accumulate(np.where(later, rank[None, :], -1), axis=1)
    w = np.where(later, gap["w"][at][rank], -np.inf)
    with np.errstate(all="ignore"):
        square, off = _squares(a[2], a[2])
        far = (square > np.where(later, w * w + off[:, None], -np.inf).astype(square.dtype)) | ~later | (np.maximum(core[:, None], core[None, :]) > w)
    i, j = _places(far)
    return _lighter(a, a, i, j, gap[at[rank[i, j]]])


def _lighter_between(a, b, host):
    """Edges between points of two blocks that are lighter than the heaviest gap between them: of those behind the first
    point, of whole blocks between (host) and of those up to the second point.
    """
    between = np.array([tuple(host[c] for c in _GAP.names)], _GAP)
    behind, upto = np.concatenate([a[5][1:], between])[::-1], b[5]

    def running(gap):
        order = np.maximum.accumulate(np.where(np.concatenate([[True], gap["r"][1:] > np.maximum.accumulate(gap["r"])[:-1]]), np.arange(len(gap)), 0))
        return gap[order]

    behind, upto = running(behind)[::-1], running(upto)
    with np.errstate(all="ignore"):
        square, off = _squares(a[2], b[2])
        limits = np.maximum((behind["w"] ** 2 + off).astype(square.dtype)[:, None], (upto["w"] ** 2 + off.max()).astype(square.dtype)[None, :])
        far = square > limits
    i, j = _places(far)
    chance = np.maximum(a[3][i], b[3][j]) <= np.maximum(behind["w"][i], upto["w"][j])
    i, j = i[chance], j[chance]
    return _lighter(a, b, i, j, np.where(behind["r"][i] > upto["r"][j], behind[i], upto[j]))


def _linked(leaves: DataFrame, width: int) -> DataFrame:
    """u < v and w: edges that join the trees of each group."""
    trees = leaves.select("b", "trees")
    pairs = _gaps(leaves).where("a < b").join(trees.select(F.col("b").alias("a"), F.col("trees").alias("more")), "a").join(trees, "b")
    # between blocks without the beginning of a tree are those of one tree
    begun = F.sum("trees").over(Window.partitionBy("a").orderBy("b"))
    return _over_leaves(leaves, _balanced(pairs.withColumn("begun", begun).where("begun > 0 or more > 0")), width, lambda one: _between_trees(one, one), _between_trees)


def _shorter(leaves: DataFrame, width: int) -> DataFrame:
    """u < v and w: edges that are lighter than the heaviest on the way between their ends in the tree of each group."""
    bounds = leaves.select("b", "own", "top")
    pairs = _gaps(leaves).where("a < b").join(bounds.select(F.col("b").alias("a"), "own"), "a").join(bounds.select("b", "top"), "b")
    over = F.max("top").over(Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    pairs = pairs.withColumn("over", F.coalesce(over, F.struct(F.lit(-1).cast("long").alias("r"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"))))
    pairs = pairs.where(F.col("least") <= F.greatest("own", "top.w", "over.w")).select("a", "b", "over.*")
    return _over_leaves(leaves, _balanced(pairs, *_GAP.names), width, _lighter_within, _lighter_between)


def _merge_tree(blocks: DataFrame, width: int, block: int, working: Working) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Edges (r, u, v, w) that hold the minimum spanning tree of every group, and _chains of them."""
    spark = working.spark

    def chained(edges, turn):
        # _chains uses its tables' names anew
        own = Working(spark, f"density-{turn}")
        edges = numbered(edges, ["w", "u", "v"], "r", own)
        return edges, *_chains(edges, own)

    many = blocks.groupBy("grp").agg(F.count("*").alias("blocks")).where("blocks > 1").select("grp")
    with _few_rows(spark):
        edges = working.save(_own_tree(blocks.join(many, "grp", "left_anti"), width), "own_edges")
        if many.isEmpty():
            return chained(edges, "own")
        parted = blocks.join(many, "grp", "left_semi")
        points = working.save(_points(parted, width), "points")
        edges = edges.unionByName(working.save(_to_denser(parted, points), "to_denser"))
    copies = working.save(_copies(points), "copies")
    if not copies.isEmpty():
        edges = edges.unionByName(copies.select(F.col("of").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("w")))
        points = points.join(copies, "node", "left_anti")
    edges, chains, first, levels = chained(edges.distinct(), "near")
    tree = lambda: edges.join(chains.select("r"), "r", "left_semi").select("u", "v", "w")
    leaves = _leaves(points, edges, chains, first, width, block, Working(spark, "density-near"))
    if leaves.agg(F.sum("trees")).first()[0] > many.count():
        with _few_rows(spark):
            linked = working.save(_linked(leaves, width), "links")
        edges, chains, first, levels = chained(tree().unionByName(linked), "linked")
        leaves = _leaves(points, edges, chains, first, width, block, Working(spark, "density-linked"))
    with _few_rows(spark):
        shorter = working.save(_shorter(leaves, width), "shorter")
    if not shorter.isEmpty():
        edges, chains, first, levels = chained(tree().unionByName(shorter), "whole")
    return edges, chains, first, levels


def _chains(edges: DataFrame, working: Working) -> tuple[DataFrame, DataFrame, int]:
    """Edges (r, u, v; r their order) to the chains of the merge tree: r, c, level, top; and each node's first edge f.

    c names a chain, top is the edge that its upper end hangs on (null at a root). level counts from 1.
    """
    now = edges.select("r", "u", "v")
    waiting, done, first, level = None, None, None, 0
    while True:
        ends = now.select(F.col("u").alias("s"), "r").unionByName(now.select(F.col("v").alias("s"), "r"))
        least = working.save(ends.groupBy("s").agg(F.min("r").alias("f")), f"least{level}")
        if level == 0:
            first = least
        else:
            met = working.save(waiting.join(least, "s", "left"), f"met{level}")
            here = F.col("f").isNull() | (F.col("f") > F.col("r"))
            settled = met.where(here).select("r", (F.col("s") * 64 + level).alias("c"), F.lit(level).alias("level"), F.col("f").alias("top"))
            done = settled if done is None else done.unionByName(settled)
            waiting = met.where(~here).select("r", "s")
        if least.isEmpty():
            return working.save(done, "chains") if done is not None else None, first, level
        chosen = working.save(now.join(least.select(F.col("f").alias("r")).distinct(), "r", "left_semi"), f"chosen{level}")
        hooks = working.save(least.join(chosen, least["f"] == chosen["r"]).select("s", (F.col("u") + F.col("v") - F.col("s")).alias("o")), f"hooks{level}")
        back = hooks.select(F.col("s").alias("o"), F.col("o").alias("back"))
        pointers = hooks.join(back, "o").select("s", F.when((F.col("back") == F.col("s")) & (F.col("s") < F.col("o")), F.col("s")).otherwise(F.col("o")).alias("p"))
        to = working.save(roots(pointers, f"to{level}_", working), f"to{level}")
        fresh = chosen.join(to, chosen["u"] == to["s"]).select("r", F.col("p").alias("s"))
        waiting = fresh if waiting is None else fresh.unionByName(waiting.join(to, "s").select("r", F.col("p").alias("s")))
        waiting = working.save(waiting, f"waiting{level}")
        moved = now.join(to.select(F.col("s").alias("u"), F.col("p").alias("x")), "u").join(to.select(F.col("s").alias("v"), F.col("p").alias("y")), "v").where("x <> y")
        now = working.save(moved.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("r").alias("r")).select("r", "u", "v"), f"edges{level}")
        level += 1


def _running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df (c, r) with the sum of value over the rows of c up to r, in runs of bounded length and sums of runs."""
    df = df.withColumn("_run", F.floor(F.col("r") / RUN)).withColumn("_v", value)
    runs = df.groupBy("c", "_run").agg(F.sum("_v").alias("_s"))
    before = runs.select("c", "_run", (F.sum("_s").over(Window.partitionBy("c").orderBy("_run")) - F.col("_s")).alias("_b"))
    inside = F.sum("_v").over(Window.partitionBy("c", "_run").orderBy("r"))
    return df.withColumn("_i", inside).join(before, ["c", "_run"]).withColumn(name, F.col("_i") + F.col("_b")).drop("_run", "_v", "_i", "_b")


def _merges(edges: DataFrame, chains: DataFrame, first: DataFrame, levels: int, least: int, working: Working) -> tuple[DataFrame, DataFrame]:
    """The merge tree: its edges with their sizes and cluster segments, and its chains with their sizes."""
    tree = chains.join(edges.select("r", "w"), "r")
    tree = tree.join(first.groupBy(F.col("f").alias("r")).agg(F.count("*").alias("alone")), "r", "left").fillna(0, ["alone"])
    tree = working.save(tree.withColumn("density", 1 / F.greatest(F.col("w"), F.lit(LEAST_DISTANCE))), "tree")
    sizes = None
    for level in range(1, levels + 1):  # chains hang on edges of chains of higher levels
        own = tree.where(F.col("level") == level).select("r", "c", "top", "alone")
        if sizes is not None:
            own = own.join(sizes.groupBy(F.col("top").alias("r")).agg(F.sum("total").alias("hung")), "r", "left")
        else:
            own = own.withColumn("hung", F.lit(0))
        here = working.save(own.groupBy("c", "top").agg(F.sum(F.col("alone") + F.coalesce("hung", F.lit(0))).alias("total")), f"sizes{level}")
        sizes = here if sizes is None else sizes.unionByName(here)
    sizes = working.save(sizes, "sizes")
    large = F.when(F.col("total") >= least, F.col("total"))
    hung = sizes.groupBy(F.col("top").alias("r")).agg(F.sum("total").alias("hung"), F.count(large).alias("hung_large"), F.coalesce(F.sum(large), F.lit(0)).alias("large"))
    tree = tree.join(hung, "r", "left").fillna(0, ["hung", "hung_large", "large"]).withColumn("side", F.col("alone") + F.col("hung"))
    tree = _running(tree, F.col("side"), "size").withColumn("below", F.col("size") - F.col("side"))
    grown = (F.col("below") >= least).cast("int")
    tree = tree.withColumn("split", F.col("hung_large") + grown == 2).withColumn("big", F.col("size") >= least)
    # the points that leave at an edge: all at a split or where a cluster begins, else those of the small side
    carried = F.when(F.col("split"), 0).when(grown == 1, F.col("below")).otherwise(F.col("large"))
    tree = tree.withColumn("fall", F.when(F.col("big"), F.col("size") - carried).otherwise(0))
    return working.save(_running(tree, F.col("split").cast("long"), "segment"), "merges"), sizes


def _clusters(merges: DataFrame, sizes: DataFrame, working: Working) -> tuple[DataFrame, DataFrame]:
    """The condensed tree: x, parent, stability, densest of each cluster; and the cluster x of each large edge r."""
    big = merges.where("big")
    parts = big.groupBy("c", "segment").agg(F.min("r").alias("x"), F.sum(F.col("fall") * F.col("density")).alias("mass"), F.sum("fall").alias("points"))
    parts = working.save(parts, "parts")
    at = big.join(parts.select("c", "segment", "x"), ["c", "segment"]).select("r", "x", "split", "density")
    at = working.save(at, "at")
    # upwards: the next segment of the chain, which begins with a split, or the edge that the chain hangs on
    following = F.lead("x").over(Window.partitionBy("c").orderBy("segment"))
    up = parts.withColumn("next", following).join(sizes.select("c", "top"), "c").withColumn("edge", F.coalesce("next", "top"))
    up = up.join(at.select(F.col("r").alias("edge"), F.col("x").alias("to"), "split", F.col("density").alias("birth")), "edge", "left")
    up = working.save(up.select("x", "mass", "points", "to", "split", "birth"), "up")
    same = roots(up.select(F.col("x").alias("s"), F.when(~F.col("split"), F.col("to")).otherwise(F.col("x")).alias("p")).fillna({"p": -1}).withColumn("p", F.when(F.col("p") < 0, F.col("s")).otherwise(F.col("p"))), "same", working)
    same = working.save(same.select(F.col("s").alias("x"), F.col("p").alias("whole")), "same")
    named = up.join(same, "x")
    sums = named.groupBy("whole").agg(F.sum("mass").alias("mass"), F.sum("points").alias("points"), F.min("x").alias("bottom"))
    tops = named.where("x = whole").select("whole", "birth", F.col("to").alias("x")).join(same.withColumnRenamed("whole", "parent"), "x", "left")
    clusters = sums.join(tops.select("whole", "birth", "parent"), "whole").join(at.select(F.col("r").alias("bottom"), F.col("density").alias("densest")), "bottom")
    stability = F.col("mass") - F.col("points") * F.coalesce("birth", F.lit(0.0))
    clusters = working.save(clusters.select(F.col("whole").alias("x"), "parent", stability.alias("stability"), "densest"), "clusters")
    return clusters, working.save(at.join(same, "x").select("r", F.col("whole").alias("x")), "of_edge")


def _selected(clusters: DataFrame, working: Working) -> DataFrame:
    """x, chosen: the cluster with most excess of mass that holds each cluster, null if there is none. A root is never chosen."""
    kids = clusters.groupBy(F.col("parent").alias("x")).agg(F.min("x").alias("l"), F.max("x").alias("r"))
    none = F.lit(None).cast("double")
    now = clusters.join(kids, "x", "left").select("x", "parent", "stability", "l", "r", F.when(F.col("l").isNull(), F.col("stability")).alias("value"), none.alias("a"), none.alias("b"), F.lit(None).cast("long").alias("next"))
    now, step = working.save(now, "values0"), 0
    # a cluster is worth max(stability, what both children are worth). With one child known that is max(a, b + the other's
    # worth), and such functions of functions are again of that form: so the rounds follow the tree's size, not its height
    while not now.where("value is null").isEmpty():
        step += 1
        look = lambda on: now.select(F.col("x").alias(on), *(F.col(c).alias(f"{on}_{c}") for c in ("value", "a", "b", "next")))  # noqa: B023, E731
        met = now.join(look("l"), "l", "left").join(look("r"), "r", "left").join(look("next"), "next", "left")
        c, unary = F.col, F.col("next").isNotNull()
        value = F.coalesce("value", F.when(unary, F.when(c("next_value").isNotNull(), F.greatest("a", c("b") + c("next_value")))).when(c("l_value").isNotNull() & c("r_value").isNotNull(), F.greatest("stability", c("l_value") + c("r_value"))))
        further = unary & c("next_next").isNotNull()
        half = ~unary & (c("l_value").isNotNull() | c("r_value").isNotNull())
        a = F.when(further, F.greatest("a", c("b") + c("next_a"))).when(unary, c("a")).when(half, c("stability"))
        b = F.when(further, c("b") + c("next_b")).when(unary, c("b")).when(half, F.coalesce("l_value", "r_value"))
        on = F.when(further, c("next_next")).when(unary, c("next")).when(half, F.when(c("l_value").isNull(), c("l")).otherwise(c("r")))
        now = working.save(met.select("x", "parent", "stability", "l", "r", value.alias("value"), a.alias("a"), b.alias("b"), on.alias("next")), f"values{step}")
    below = now.select(F.col("parent").alias("x"), "value").groupBy("x").agg(F.sum("value").alias("below"))
    found = now.select("x", "parent", "stability").join(below, "x", "left").withColumn("wins", F.col("stability") >= F.coalesce("below", F.col("stability")))
    now = working.save(found.select("x", F.col("parent").alias("p"), F.when(F.col("wins") & F.col("parent").isNotNull(), F.col("x")).alias("chosen")), "chosen0")
    step = 0
    while not now.where("p is not null").isEmpty():
        step += 1
        above = now.select(F.col("x").alias("p"), F.col("p").alias("q"), F.col("chosen").alias("higher"))
        now = working.save(now.join(above, "p", "left").select("x", F.col("q").alias("p"), F.coalesce("higher", "chosen").alias("chosen")), f"chosen_{step}")
    return now.select("x", "chosen")


def _exits(merges: DataFrame, sizes: DataFrame, working: Working) -> DataFrame:
    """c, out: the lightest large edge above every small edge of a chain."""
    large = merges.where("big").groupBy("c").agg(F.min("r").alias("out"))
    tops = merges.select(F.col("r").alias("top"), "big", F.col("c").alias("p"))
    now = sizes.join(large, "c", "left").join(tops, "top", "left")
    now = now.select("c", F.coalesce("out", F.when(F.col("big"), F.col("top"))).alias("out"), "p")
    now = working.save(now, "exits0")
    step = 0
    while not now.where("out is null").isEmpty():
        step += 1
        above = now.select(F.col("c").alias("p"), F.col("out").alias("higher"), F.col("p").alias("q"))
        now = working.save(now.join(above, "p", "left").select("c", F.coalesce("out", "higher").alias("out"), F.col("q").alias("p")), f"exits{step}")
    return now.select("c", "out")


def density_clusters(points: DataFrame, least: int, neighbours: int | None = None, block: int = BLOCK) -> DataFrame:
    """points (grp, id: long, vec: array<double>) to grp, id, label, strength: a row for each row.

    HDBSCAN of each group by itself: Euclidean distances, least points in a cluster, core distances to the
    neighbours-th neighbour (as many as least, if not given), the clusters with most excess of mass, never a whole group.
    label counts a group's clusters from 0 in the order of their smallest ids; -1 is noise, with strength 0. strength is
    the density at which a point leaves, against the densest place of its cluster. Of equal edges the one with the
    smaller ids goes first; distances below 1e-12 count as that. In a group of fewer than max(2, least) usable points
    all are noise. So are rows whose vector is null, holds a null or a number that is not finite, or is not of the
    commonest length (of equally common ones the longest). A null grp is a group of its own; a null id keeps its row.
    Rows that repeat an id are points of their own. Other columns are ignored; an empty table gives no rows.
    """
    spark = points.sparkSession
    working = Working(spark, "density")
    vec = F.col("vec")
    good = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = points.select(F.col("grp").cast("long").alias("key"), F.col("id").cast("long").alias("id"), vec.cast("array<double>").alias("vec"))
    # a null group needs a number that no other has
    base = base.withColumn("grp", F.when(F.col("key").isNull(), 0).otherwise(F.when(F.col("key") >= 0, F.col("key") + 1).otherwise(F.col("key"))))
    lengths = base.where(good).groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = lengths[0]["width"] if lengths else 0
    nodes = numbered(base.withColumn("usable", F.coalesce(good & (F.size("vec") == width), F.lit(False))), ["grp", "id", "vec"], "node", working)
    noise = nodes.select(F.col("key").alias("grp"), "id", F.lit(NOISE).alias("label"), F.lit(0.0).alias("strength"))
    groups = nodes.where("usable").groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, least))
    k = F.least(F.lit(neighbours or least), F.col("n") - 1).cast("int")
    live = nodes.where("usable").join(groups, "grp").select("node", "grp", "n", k.alias("k"), "vec")
    if not width or groups.isEmpty():
        return noise

    blocks = _blocks(live, width, block, working)
    blocks = _with_cores(blocks, _gaps(blocks), width, working)
    edges, chains, first, levels = _merge_tree(blocks, width, block, working)
    merges, sizes = _merges(edges, chains, first, levels, least, working)
    clusters, of_edge = _clusters(merges, sizes, working)
    chosen = working.save(_selected(clusters, working).join(clusters.select(F.col("x").alias("chosen"), "densest"), "chosen"), "chosen")

    start = first.select(F.col("s").alias("node"), F.col("f").alias("r")).join(merges.select("r", "c", "big"), "r").join(_exits(merges, sizes, working), "c")
    leaves = start.select("node", F.when(F.col("big"), F.col("r")).otherwise(F.col("out")).alias("r"))
    found = leaves.join(merges.select("r", "density"), "r").join(of_edge, "r").join(chosen, "x").select("node", "chosen", F.least(F.lit(1.0), F.col("density") / F.col("densest")).alias("strength"))
    found = working.save(nodes.select("node", "grp").join(found, "node"), "found")
    order = found.groupBy("grp", "chosen").agg(F.min("node").alias("least"))
    order = order.select("grp", "chosen", (F.row_number().over(Window.partitionBy("grp").orderBy("least")) - 1).alias("label"))
    labelled = found.join(order, ["grp", "chosen"]).select("node", "label", "strength")
    return nodes.join(labelled, "node", "left").select(F.col("key").alias("grp"), "id", F.coalesce("label", F.lit(NOISE)).alias("label"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def two_levels(points: DataFrame, macro: int = 20, micro: int = 5, block: int = BLOCK) -> DataFrame:
    """CLU-07 and CLU-08: points (id, vec) to id, macro_label, macro_strength, micro_label, micro_strength, reclassificada.

    Clusters of at least macro points, then those of at least micro points within each of them, and among the points
    that the first pass left out; those that the second pass takes up there are reclassificada. ids must not repeat.
    """
    once = density_clusters(points.select(F.lit(0).cast("long").alias("grp"), "id", "vec"), macro, block=block)
    once = Working(points.sparkSession, "levels").save(once.select("id", F.col("label").alias("macro_label"), F.col("strength").alias("macro_strength")), "macro")
    again = points.select("id", "vec").join(once, "id").select(F.col("macro_label").alias("grp"), "id", "vec")
    within = density_clusters(again, micro, block=block).select("id", F.col("label").alias("micro_label"), F.col("strength").alias("micro_strength"))
    return once.join(within, "id").withColumn("reclassificada", (F.col("macro_label") == NOISE) & (F.col("micro_label") != NOISE))
