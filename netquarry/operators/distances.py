"""Shortest-path distances from positions on a network.

Two strategies give equal rows. ``local``: edges up to ``LOCAL_EDGES`` (counted first) go to every
executor as arrays, and each query point is one search there. ``frame``: for graphs beyond that size,
rounds over blocks of edges (see blocks), each a search in arrays too; each round is checkpointed, and
a bound stops searches early. ``auto`` picks by the count.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.network import Network, adjacency, placed

#: Edges that one worker holds as arrays: 2 * 20 bytes each, so about 200 MB.
LOCAL_EDGES = 5_000_000
DISTANCES = "qset long, qi long, node long, d double"


def seeded(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """qset, qi, node, d: both ends of each query's edge. Raises on a query that is on no edge."""
    at = placed(queries, edges)
    ends = F.array(F.struct(F.col("ni").alias("node"), F.col("pos").alias("d")), F.struct(F.col("nj").alias("node"), (F.col("w") - F.col("pos")).alias("d")))
    return at.select(F.col("qset").cast("long").alias("qset"), F.col("qi").cast("long").alias("qi"), F.explode(ends).alias("e")).select("qset", "qi", "e.node", "e.d")


class Csr:
    """A graph as arrays: neighbours of node k (by rank among the sorted ids) at starts[k]:starts[k + 1]; 12 bytes for each direction of an edge."""

    def __init__(self, ni, nj, w):
        self.ids = np.unique(np.concatenate([ni, nj]))
        a, b = (np.searchsorted(self.ids, x).astype(np.int32) for x in (ni, nj))
        src = np.concatenate([a, b])
        order = np.argsort(src, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(self.ids)))]).astype(np.int64)
        del src
        self.to, self.w = np.concatenate([b, a])[order], np.concatenate([w, w])[order]
        self.step = max(float(w.min()), float(w.mean()) / 4) if len(w) else 1.0

    def rank(self, node) -> int | None:
        k = int(np.searchsorted(self.ids, node))
        return k if k < len(self.ids) and self.ids[k] == node else None

    def ranks(self, nodes) -> np.ndarray:
        """The ranks of many nodes, -1 for those without edges."""
        nodes = np.asarray(nodes, np.int64)
        if not len(self.ids):
            return np.full(len(nodes), -1, np.int64)
        k = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return np.where(self.ids[k] == nodes, k, -1)

    def near(self, k: int) -> tuple[list, list]:
        """The neighbours of a rank and their weights."""
        a, b = self.starts[k], self.starts[k + 1]
        return self.to[a:b].tolist(), self.w[a:b].tolist()

    def settle(self, d: np.ndarray, open_: np.ndarray, bound: float = float("inf"), label: np.ndarray | None = None, tally: list | None = None) -> np.ndarray:
        """Relax d in place from its open places until those left are over the bound; returns them. d holds one or more searches, each of as many places as there are ranks.

        All open places within a step of the nearest one go at once, so the work is in arrays; one that gets nearer afterwards goes again. label: with it, of equal distances
        the one of the lower label counts. tally: adds up places taken, and has the most that were open.
        """
        n, queued = len(self.ids), np.zeros(len(d), bool)
        queued[open_] = True
        open_ = np.flatnonzero(queued) if len(open_) * 8 > len(d) else np.unique(open_)
        while len(open_):
            far = d[open_]
            low = far.min()
            if low > bound:
                break
            now = far <= min(low + self.step, bound)
            if tally is not None:
                tally[0], tally[1] = tally[0] + int(now.sum()), max(tally[1], len(open_))
            places, open_ = open_[now], open_[~now]
            queued[places] = False
            ranks = places % n if len(d) > n else places
            first = self.starts[ranks]
            count = self.starts[ranks + 1] - first
            ends = np.cumsum(count)
            arcs = np.arange(ends[-1]) + np.repeat(first - ends + count, count)
            to = self.to[arcs] + np.repeat(places - ranks, count)
            new = self.w[arcs] + np.repeat(d[places], count)
            if label is None:
                better = new < d[to]
                to = to[better]
                np.minimum.at(d, to, new[better])
            else:
                mark = np.repeat(label[places], count)
                better = (new < d[to]) | ((new == d[to]) & (mark < label[to]))
                to, new, mark = to[better], new[better], mark[better]
                order = np.lexsort((mark, new))[::-1]  # of several the last one put stays
                to = to[order]
                d[to], label[to] = new[order], mark[order]
            fresh = np.unique(to[~queued[to]])
            queued[fresh] = True
            open_ = np.concatenate([open_, fresh])
        return open_

    def all_from(self, seeds, bound: float = float("inf")) -> np.ndarray:
        """The distance of each rank from seeds (rank, distance), inf if it is not reached or over the bound."""
        d = np.full(len(self.ids), np.inf)
        for k, x in seeds:
            d[k] = min(d[k], x)
        self.settle(d, np.array([k for k, _ in seeds], np.int64), bound)
        d[d > bound] = np.inf
        return d

    def search(self, seeds, bound=float("inf"), target=None, parents: dict | None = None, h=None) -> dict[int, float]:
        """Settled ranks and distances from seeds (rank, distance), up to a bound or until target is settled; h is an optional lower bound to the target."""
        done, heap = {}, []
        for k, d in seeds:
            heapq.heappush(heap, (d + (h[k] if h is not None else 0.0), d, k, -1))
        while heap:
            _, d, k, came = heapq.heappop(heap)
            if k in done or d > bound:
                continue
            done[k] = d
            if parents is not None:
                parents[k] = came
            if k == target:
                break
            for t, w in zip(*self.near(k), strict=True):
                if t not in done:
                    heapq.heappush(heap, (d + w + (h[t] if h is not None else 0.0), d + w, t, k))
        return done

    def cells(self, seeds) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of seeds (rank, seed id) of each rank and its distance, by one search from all of them; ties go to the lower id, unreached ranks have distance inf."""
        seed, d = np.full(len(self.ids), np.iinfo(np.int64).max), np.full(len(self.ids), np.inf)
        for k, s in seeds:
            d[k], seed[k] = 0.0, min(seed[k], s)
        self.settle(d, np.array([k for k, _ in seeds], np.int64), label=seed)
        return np.where(np.isfinite(d), seed, -1), d


#: Nodes whose distances are worked out as one matrix, and the most of a merged one (200 MB).
LEAF, MERGED = 96, 5_000


def among(ni: np.ndarray, nj: np.ndarray, w: np.ndarray, keep: np.ndarray, depth: int = 0) -> np.ndarray:
    """The matrix of distances among the nodes of keep (ascending), inf where there is no path.

    The graph is halved again and again; a half gives the distances among its kept nodes and the nodes of the cut, and paths over
    the latter join two halves. Where these are too many (no good cut), all kept nodes are searched from instead.
    """
    if not len(keep):
        return np.zeros((0, 0))
    nodes = np.unique(np.concatenate([ni, nj, keep]))
    a, b = np.searchsorted(nodes, ni), np.searchsorted(nodes, nj)
    if len(nodes) <= LEAF:
        m = np.full((len(nodes), len(nodes)), np.inf)
        np.fill_diagonal(m, 0.0)
        np.minimum.at(m, (a, b), w)
        np.minimum.at(m, (b, a), w)
        _over(m, np.arange(len(nodes)))
        at = np.searchsorted(nodes, keep)
        return m[np.ix_(at, at)]
    graph = Csr(ni, nj, w)
    if not len(ni) or depth > 40:  # very many components
        return _searched_among(graph, keep)
    for lean in (_by_number, _by_distance)[len(nodes) > 2000 :]:  # the first needs no searches, and often will do in a small graph
        side = lean(nodes, graph)
        cross = side[a] != side[b]
        cut = min((np.unique(np.where(side[a[cross]] == half, a[cross], b[cross])) for half in (False, True)), key=len)
        if len(cut) <= 2 * len(nodes) ** 0.5:
            break
    of = side[cut[0]] if len(cut) else False
    in_keep = side[np.searchsorted(nodes, keep)]
    # the ends of the cut on one side belong to both halves, and with them the crossing edges to the other one
    halves = [(side[a] == of) & ~cross, (side[a] != of) | cross]
    ends = [np.unique(np.concatenate([nodes[cut], keep[in_keep == (of if k == 0 else not of)]])) for k in (0, 1)]
    both = np.unique(np.concatenate(ends))
    if len(both) ** 2 > min(MERGED**2, 16 * len(nodes) * max(LEAF, len(keep))):
        return _searched_among(graph, keep)
    m = np.full((len(both), len(both)), np.inf)
    for within, some in zip(halves, ends, strict=True):
        at = np.ix_(*[np.searchsorted(both, some)] * 2)
        m[at] = np.minimum(m[at], among(ni[within], nj[within], w[within], some, depth + 1))
    _over(m, np.searchsorted(both, nodes[cut]))
    at = np.searchsorted(both, keep)
    return m[np.ix_(at, at)]


def _by_number(nodes: np.ndarray, graph: Csr) -> np.ndarray:
    return np.arange(len(nodes)) >= len(nodes) // 2


def _by_distance(nodes: np.ndarray, graph: Csr) -> np.ndarray:
    """Which nodes are nearer to one of two nodes far apart, or the first component if there are several; nodes without edges stay on one side."""
    side, at = np.zeros(len(nodes), bool), np.searchsorted(nodes, graph.ids)
    one = graph.all_from([(0, 0.0)])
    if not np.isfinite(one).all():
        side[at[np.isfinite(one)]] = True
        return side
    u = int(np.argmax(one))
    du = graph.all_from([(u, 0.0)])
    lean = du - graph.all_from([(int(np.argmax(du)), 0.0)])
    side[at[np.argsort(lean, kind="stable")[len(lean) // 2 :]]] = True
    return side


def _over(m: np.ndarray, through: np.ndarray) -> None:
    """Shorten a matrix of distances in place by the paths through some of its nodes."""
    by = np.empty_like(m)
    for k in through:
        np.add(m[:, k, None], m[k], out=by)
        np.minimum(m, by, out=m)


def _searched_among(graph: Csr, keep: np.ndarray) -> np.ndarray:
    out, ranks, n = np.full((len(keep), len(keep)), np.inf), graph.ranks(keep), len(graph.ids)
    np.fill_diagonal(out, 0.0)
    here = np.flatnonzero(ranks >= 0)
    for s in range(0, len(here), size := max(1, 2_000_000 // max(1, n))):
        some = here[s : s + size]
        d = np.full(len(some) * n, np.inf)
        at = np.arange(len(some)) * n + ranks[some]
        d[at] = 0.0
        graph.settle(d, at)
        out[np.ix_(some, here)] = d.reshape(len(some), n)[:, ranks[here]]
    return out


def frame(rows: DataFrame):
    """Counted rows on the driver, by Arrow whatever the session's setting: by way of Python objects they would take ten times the memory."""
    return rows.toArrow().to_pandas()


def gathered(edges: DataFrame) -> Csr:
    """The edges on the driver; call only after counting them."""
    got = frame(edges.select("ni", "nj", F.col("w").cast("double").alias("w")))
    return Csr(got.ni.to_numpy(np.int64), got.nj.to_numpy(np.int64), got.w.to_numpy(np.float64))


def fits_locally(edges: DataFrame, limit: int = LOCAL_EDGES) -> bool:
    return edges.limit(limit + 1).count() <= limit


def local_distances(queries: DataFrame, edges: DataFrame, bound: float | None = None) -> DataFrame:
    """One search of the broadcast graph for each query point, in parallel over them."""
    import pandas as pd

    seeds = seeded(queries, edges)
    graph = seeds.sparkSession.sparkContext.broadcast(gathered(edges))
    limit = float("inf") if bound is None else float(bound)

    def run(key, pdf):
        g = graph.value
        d = g.all_from([(g.rank(n), d) for n, d in zip(pdf.node, pdf.d, strict=True) if g.rank(n) is not None], limit)
        met = np.isfinite(d)
        return pd.DataFrame({"qset": key[0], "qi": key[1], "node": g.ids[met], "d": d[met]})

    return seeds.groupBy("qset", "qi").applyInPandas(run, DISTANCES)


def frame_distances(queries: DataFrame, edges: DataFrame, bound: float | None = None) -> DataFrame:
    """Rounds over blocks of edges (see blocks): a task holds one block, never the graph."""
    import pandas as pd

    from .blocks import Blocks, located

    net, rows = Blocks(Network(None, edges), points=False), located(queries, edges)

    def run(block, some, d):
        k, n = np.nonzero(np.isfinite(d) & block.own)
        return pd.DataFrame({"qset": some.qset.to_numpy()[k], "qi": some.qi.to_numpy()[k], "node": block.graph.ids[n], "d": d[k, n]})

    return net.each(rows, net.reach(rows, bound, "frame"), run, DISTANCES, bound)


def distances(queries: DataFrame, edges: DataFrame, bound: float | None = None, strategy: str = "auto") -> DataFrame:
    """qset, qi, node, d for every node that a query point reaches (within the bound)."""
    if strategy == "auto":
        strategy = "local" if fits_locally(edges) else "frame"
    how = {"local": local_distances, "frame": frame_distances}[strategy]
    return how(queries, edges, bound)


def shortest_path(edges: DataFrame, source: int, target: int, nodes: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """step, node, d along one shortest path between two nodes; no rows if there is none. With nodes, straight-line bounds guide the search (weights must allow them).

    local gathers the edges (counted; beyond LOCAL_EDGES it refuses) for one guided search; frame searches blocks of edges from the source as far as the target and follows each
    node's least predecessor back from the target in rounds that double their reach. It needs positive weights.
    """
    fits = fits_locally(edges)
    if strategy == "auto":
        strategy = "local" if fits else "frame"
    if strategy == "frame":
        return _frame_path(edges, source, target)
    if not fits:
        raise ValueError(f"over {LOCAL_EDGES} edges do not go to one worker; use the frame strategy")
    spark, graph = edges.sparkSession, gathered(edges)
    a, b = graph.rank(source), graph.rank(target)
    rows = []
    if source == target:
        rows = [(0, source, 0.0)]
    elif a is not None and b is not None:
        h = None
        if nodes is not None:
            wanted = nodes.join(edges.select(F.explode(F.array("ni", "nj")).alias("node_id")).distinct(), "node_id", "left_semi")  # as few as the edges allow
            got = wanted.select("node_id", "x", "y").toPandas().set_index("node_id").reindex(graph.ids)
            h = np.hypot(got.x - got.x.iloc[b], got.y - got.y.iloc[b]).to_numpy()
        parents: dict[int, int] = {}
        done = graph.search([(a, 0.0)], target=b, parents=parents, h=h)
        if b in done:
            path = [b]
            while parents[path[-1]] >= 0:
                path.append(parents[path[-1]])
            rows = [(k, int(graph.ids[r]), float(done[r])) for k, r in enumerate(reversed(path))]
    return spark.createDataFrame(rows, "step long, node long, d double")


def _frame_path(edges: DataFrame, source: int, target: int) -> DataFrame:
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0, int(source), 0.0)], "step long, node long, d double")
    at = edges.filter((F.col("ni") == int(source)) | (F.col("nj") == int(source))).select("ni", "nj", "w").first()
    if at is None:
        return spark.createDataFrame([], "step long, node long, d double")
    start = spark.createDataFrame([(0, 0, at.ni, at.nj, 0.0 if at.ni == source else float(at.w))], "qset long, qi long, ni long, nj long, pos double")
    size = edges.agg(F.avg("w").alias("mean"), F.sum("w").alias("all")).first()
    radius = 64 * size["mean"]
    while True:  # no path is longer than all edges
        dist = frame_distances(start, edges, radius).select("node", "d").checkpoint()
        end = dist.filter(F.col("node") == int(target)).first()
        if end is not None or radius > size["all"]:
            break
        radius *= 4
    if end is None:
        return spark.createDataFrame([], "step long, node long, d double")
    dist = dist.filter(F.col("d") <= end.d)
    far = adjacency(edges).join(dist.toDF("src", "ds"), "src").join(dist.toDF("dst", "dd"), "dst").filter(F.col("ds") + F.col("w") == F.col("dd"))
    up = far.groupBy("dst").agg(F.min("src").alias("up")).toDF("node", "up").checkpoint()
    path = dist.filter(F.col("node") == int(target)).select("node").checkpoint()
    while True:  # path: the last 1, 2, 4, ... nodes; up: the predecessor that many nodes before
        more = path.join(up, "node").select(F.col("up").alias("node")).join(path, "node", "left_anti").checkpoint()
        if more.isEmpty():
            break
        path = path.unionByName(more).checkpoint()
        up = up.toDF("node", "mid").join(up.toDF("mid", "up"), "mid").select("node", "up").checkpoint()
    on = path.join(dist, "node")
    return on.withColumn("step", F.row_number().over(Window.orderBy("d")) - 1).select(F.col("step").cast("long").alias("step"), "node", "d")  # over the nodes of one path


def nearest_seed(edges: DataFrame, seeds: DataFrame, strategy: str = "auto") -> DataFrame:
    """node, seed, d: the network Voronoi cells of seeds (node); ties go to the lower seed id."""
    start = seeds.select(F.lit(0).cast("long").alias("qset"), F.col("node").cast("long").alias("qi"), F.col("node").cast("long").alias("node"), F.lit(0.0).alias("d"))
    if strategy == "auto":
        strategy = "local" if fits_locally(edges) else "frame"
    if strategy == "local":  # one search from all seeds, in one task
        graph = edges.sparkSession.sparkContext.broadcast(gathered(edges))

        def run(batches):
            import pandas as pd

            g = graph.value
            ids = [int(x) for pdf in batches for x in pdf.node]
            seed, d = g.cells([(g.rank(x), x) for x in ids if g.rank(x) is not None])
            met = np.isfinite(d)
            alone = [x for x in ids if g.rank(x) is None]  # seeds without edges are their own cells
            yield pd.DataFrame({"node": np.append(g.ids[met], alone).astype("int64"), "seed": np.append(seed[met], alone).astype("int64"), "d": np.append(d[met], [0.0] * len(alone))})

        return start.select("node").distinct().coalesce(1).mapInPandas(run, "node long, seed long, d double")
    adj = adjacency(edges)
    best = start.select("node", F.struct("d", F.col("qi").alias("seed")).alias("m")).checkpoint()
    frontier = best
    while not frontier.isEmpty():
        step = frontier.join(adj, frontier.node == adj.src).select(F.col("dst").alias("node"), F.struct((F.col("m.d") + F.col("w")).alias("d"), F.col("m.seed").alias("seed")).alias("m"))
        low = step.groupBy("node").agg(F.min("m").alias("m"))
        old = best.withColumnRenamed("m", "old")
        frontier = low.join(old, "node", "left").filter("old is null or m < old").drop("old").checkpoint()
        best = best.unionByName(frontier).groupBy("node").agg(F.min("m").alias("m")).checkpoint()
    return best.select("node", F.col("m.seed").alias("seed"), F.col("m.d").alias("d"))


def component(edges: DataFrame, start: int) -> DataFrame:
    """node: all that ``start`` reaches, itself included."""
    adj = adjacency(edges).select("src", "dst")
    seen = edges.sparkSession.createDataFrame([(int(start),)], "node long").checkpoint()
    if fits_locally(edges):
        graph = gathered(edges)
        k = graph.rank(start)
        ids = [int(start)] if k is None else [int(graph.ids[r]) for r in graph.search([(k, 0.0)])]
        return edges.sparkSession.createDataFrame([(i,) for i in ids], "node long")
    frontier = seen
    while not frontier.isEmpty():
        step = frontier.join(adj, frontier.node == adj.src).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").checkpoint()
        seen = seen.unionByName(frontier).checkpoint()
    return seen
