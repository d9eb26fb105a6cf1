"""Graph preparation: building, cleaning, partitioning, boundaries and the two-level overlay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cell, euclid, projected, rescaled
from ..sources.network import Network, adjacency, canonical_edges, numbered, with_ends
from .distances import Csr, among, component, distances, fits_locally, gathered, nearest_seed


def from_segments(segments: DataFrame) -> Network:
    """Nodes at the distinct end places of segments (x1, y1, x2, y2), numbered by x, then y; edges weigh their straight length."""
    ends = segments.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    nodes = numbered(ends.select("p.x", "p.y").distinct(), "node_id", "x", "y").select("node_id", "x", "y").checkpoint()
    a = nodes.select(F.col("node_id").alias("ni"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("nj"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = segments.select("x1", "y1", "x2", "y2").join(a, ["x1", "y1"]).join(b, ["x2", "y2"])
    w = euclid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return Network(nodes, canonical_edges(both.select("ni", "nj", w.alias("w"))))


def relabelled(net: Network, keep: DataFrame, order: tuple[str, ...] = ("node_id",)) -> Network:
    """The part of a network on the nodes of ``keep`` (node), renumbered from 0; points off it go."""
    nodes = net.nodes.join(keep.select(F.col("node").alias("node_id")), "node_id", "left_semi")
    ids = numbered(nodes, "new_id", *order).checkpoint()
    old = ids.select(F.col("node_id").alias("old"), "new_id")

    def moved(df, *rest):
        left = df.join(old.withColumnsRenamed({"old": "ni", "new_id": "a"}), "ni").join(old.withColumnsRenamed({"old": "nj", "new_id": "b"}), "nj")
        return left, rest

    e, _ = moved(net.edges)
    edges = e.select(F.least("a", "b").alias("ni"), F.greatest("a", "b").alias("nj"), "w")
    points = None
    if net.points is not None:
        p, _ = moved(net.points.join(net.edges, ["ni", "nj"]))
        points = p.select("pt_id", F.least("a", "b").alias("ni"), F.greatest("a", "b").alias("nj"), F.when(F.col("a") < F.col("b"), F.col("pos")).otherwise(F.col("w") - F.col("pos")).alias("pos"))
    return Network(ids.select(F.col("new_id").alias("node_id"), "x", "y"), edges, points)


def connected(net: Network, start: int = 0, straight: bool = True) -> Network:
    """The component of ``start``, renumbered; weights become straight lengths unless straight is false."""
    got = relabelled(net, component(net.edges, start))
    return Network(got.nodes, straight_weights(got) if straight else got.edges, None if straight else got.points)


def straight_weights(net: Network) -> DataFrame:
    """edges with each weight replaced by the straight length."""
    return with_ends(net.edges, net.nodes).select("ni", "nj", euclid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("w"))


def first_nodes(net: Network, n: int) -> Network:
    """Nodes with ids below n and the edges and points among them."""
    inside = (F.col("ni") < n) & (F.col("nj") < n)
    return Network(net.nodes.filter(F.col("node_id") < n), net.edges.filter(inside), None if net.points is None else net.points.filter(inside))


def lengthened(edges: DataFrame, seed: int) -> DataFrame:
    """Each weight times a factor in [1, 2) that a seeded hash of its ends fixes."""
    factor = 1 + F.pmod(F.xxhash64(F.lit(seed), "ni", "nj"), F.lit(1 << 30)) / float(1 << 30)
    return edges.withColumn("w", F.col("w") * factor)


def normalised(nodes: DataFrame, to: float = 10000.0) -> DataFrame:
    """Coordinates scaled to [0, to] on each axis; the extents are one broadcast row."""
    ext = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    both = nodes.crossJoin(F.broadcast(ext))
    return both.select("node_id", rescaled(F.col("x"), F.col("x0"), F.col("x1"), to).alias("x"), rescaled(F.col("y"), F.col("y0"), F.col("y1"), to).alias("y"))


def grid_parts(nodes: DataFrame, n: int = 8) -> DataFrame:
    """node_id, part: an n x n grid over the extents."""
    ext = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    both = nodes.crossJoin(F.broadcast(ext))
    size = lambda a, b: F.when(F.col(b) > F.col(a), (F.col(b) - F.col(a)) / n).otherwise(1.0)
    return both.select("node_id", cell(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), size("x0", "x1"), size("y0", "y1"), n).alias("part"))


def voronoi_parts(net: Network, seeds: DataFrame, strategy: str = "auto") -> DataFrame:
    """node_id, part, d: the network Voronoi cell of the nearest seed (node_id); part is the seed's node id."""
    got = nearest_seed(net.edges, seeds.select(F.col("node_id").alias("node")), strategy)
    return got.select(F.col("node").alias("node_id"), F.col("seed").alias("part"), "d")


def labelled_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """edges with pi and pj, the parts of their ends."""
    a = parts.select(F.col("node_id").alias("ni"), F.col("part").alias("pi"))
    return edges.join(a, "ni").join(a.toDF("nj", "pj"), "nj").select("ni", "nj", "w", "pi", "pj")


def boundary(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node_id, part of the nodes with an edge into another part."""
    crossing = labelled_edges(edges, parts).filter("pi <> pj")
    ends = crossing.select(F.explode(F.array(F.struct(F.col("ni").alias("node_id"), F.col("pi").alias("part")), F.struct(F.col("nj").alias("node_id"), F.col("pj").alias("part")))).alias("e"))
    return ends.select("e.*").distinct()


def part_sizes(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """part, nodes, boundary_nodes, shortcuts (pairs of boundary nodes)."""
    edge = boundary(edges, parts).groupBy("part").agg(F.count("*").alias("boundary_nodes"))
    out = parts.groupBy("part").agg(F.count("*").alias("nodes")).join(edge, "part", "left").fillna(0, ["boundary_nodes"])
    return out.withColumn("shortcuts", (F.col("boundary_nodes") * (F.col("boundary_nodes") - 1) / 2).cast("long"))


def shortcuts(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """part, bi < bj, d: the distance between boundary nodes of a part over edges within it; parts are searched in parallel.

    A part is one task's group, so parts must be of bounded size: choose more seeds or cells on larger networks. See distances.among for the way within a part.
    """
    import numpy as np
    import pandas as pd

    inner = labelled_edges(edges, parts).filter("pi = pj").select(F.col("pi").alias("part"), "ni", "nj", "w")
    ends = boundary(edges, parts).select("part", F.col("node_id").alias("b"))

    def run(key, e, b):
        border = np.sort(b.b.to_numpy(np.int64))
        far = among(e.ni.to_numpy(np.int64), e.nj.to_numpy(np.int64), e.w.to_numpy(np.float64), border)
        i, j = np.nonzero(np.triu(np.isfinite(far), 1))
        return pd.DataFrame({"part": key[0] if key[0] is not None else key[-1], "bi": border[i], "bj": border[j], "d": far[i, j]}).astype({"part": "int64"})

    return inner.groupBy("part").cogroup(ends.groupBy("part")).applyInPandas(run, "part long, bi long, bj long, d double")


def overlay(edges: DataFrame, parts: DataFrame, open_parts: list[int] | DataFrame, short: DataFrame | None = None) -> DataFrame:
    """ni, nj, w of the two-level graph: shortcuts and crossing edges, and all edges within the open parts (those of the query and its destinations)."""
    spark = edges.sparkSession
    opened = open_parts if isinstance(open_parts, DataFrame) else spark.createDataFrame([(int(p),) for p in open_parts], "part long")
    short = shortcuts(edges, parts) if short is None else short
    lab = labelled_edges(edges, parts)
    within = lab.filter("pi = pj").join(opened, lab.pi == opened.part, "left_semi")
    closed = short.join(opened, "part", "left_anti").select(F.col("bi").alias("ni"), F.col("bj").alias("nj"), F.col("d").alias("w"))
    return canonical_edges(closed.unionByName(lab.filter("pi <> pj").select("ni", "nj", "w")).unionByName(within.select("ni", "nj", "w")))


def overlay_distances(net: Network, queries: DataFrame, parts: DataFrame, open_part: int, short: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """Distances from queries to the nodes of one part over the two-level graph; equal to those of the whole graph."""
    own = queries.select(F.explode(F.array("ni", "nj")).alias("node_id")).join(parts, "node_id").select("part").distinct()
    opened = own.unionByName(own.sparkSession.createDataFrame([(int(open_part),)], "part long")).distinct()
    # the query's own edge may cross parts or lie in an open one, so it is in the overlay; its weight is the original one
    graph = overlay(net.edges, parts, opened, short).unionByName(net.edges.join(queries.select("ni", "nj"), ["ni", "nj"], "left_semi"))
    got = distances(queries, canonical_edges(graph), strategy=strategy)
    return got.join(parts.filter(F.col("part") == open_part).select(F.col("node_id").alias("node")), "node", "left_semi").select("qset", "qi", "node", "d")


def overlay_distances_all(net: Network, queries: DataFrame, parts: DataFrame, short: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """overlay_distances to the nodes of every part; the shortcuts are computed once. A network that fits a worker is searched there, all parts at once."""
    from .search import overlay_search

    short = shortcuts(net.edges, parts).checkpoint() if short is None else short
    if strategy == "local" or (strategy == "auto" and fits_locally(net.edges)):
        return overlay_search(net, queries, parts, short)
    each = [overlay_distances(net, queries, parts, r.part, short, strategy).checkpoint() for r in parts.select("part").distinct().orderBy("part").collect()]
    return reduce(DataFrame.unionByName, each)


def snapped(places: DataFrame, net: Network, cell_size: float, key: str = "pid") -> DataFrame:
    """key, ni, nj, pos, gap: each place (key, x, y) on its nearest edge, by true projection; ties to the lower edge.

    Edges are dealt to the grid cells that their boxes touch; rounds double the cell until the nearest edge found is within the certain radius.
    """
    ends = with_ends(net.edges, net.nodes).checkpoint()
    open_, found, size = places.select(key, F.col("x").alias("px"), F.col("y").alias("py")), None, float(cell_size)
    if ends.isEmpty():
        raise ValueError("the network has no edges")
    while True:
        span = lambda a, b, s=size: F.explode(F.sequence(F.floor(F.least(a, b) / s), F.floor(F.greatest(a, b) / s)))
        grid = ends.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
        ring = F.sequence(F.lit(-1), F.lit(1))
        around = open_.withColumn("dx", F.explode(ring)).withColumn("dy", F.explode(ring))
        around = around.select(key, "px", "py", (F.floor(F.col("px") / size) + F.col("dx")).alias("cx"), (F.floor(F.col("py") / size) + F.col("dy")).alias("cy"))
        near = around.join(grid, ["cx", "cy"])
        pos = projected(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("w"))
        share = F.when(F.col("w") == 0, 0.0).otherwise(F.col("pos") / F.col("w"))
        gap = euclid(F.col("px"), F.col("py"), F.col("x1") + share * (F.col("x2") - F.col("x1")), F.col("y1") + share * (F.col("y2") - F.col("y1")))
        best = near.withColumn("pos", pos).withColumn("gap", gap).groupBy(key).agg(F.min(F.struct(F.round("gap", 9).alias("near"), "ni", "nj", "pos", "gap")).alias("m"))
        sure = best.select(key, "m.ni", "m.nj", "m.pos", "m.gap").filter(F.col("gap") <= size).checkpoint()
        found = sure if found is None else found.unionByName(sure)
        open_ = open_.join(sure.select(key), key, "left_anti").checkpoint()
        if open_.isEmpty():
            return found
        size *= 2


def component_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """root, size of each connected component, by least-label rounds on checkpointed labels."""
    adj = adjacency(edges).select("src", "dst")
    label = nodes.select(F.col("node_id").alias("node"), F.col("node_id").alias("root")).checkpoint()
    while True:
        low = adj.join(label, adj.dst == label.node).groupBy("src").agg(F.min("root").alias("low"))
        step = label.join(low, label.node == low.src, "left").select("node", F.least("root", "low").alias("near"))
        # jump to the label's own label, so that rounds follow the logarithm of long paths
        jump = label.select(F.col("node").alias("near"), F.col("root").alias("far"))
        after = step.join(jump, "near").select("node", F.least("near", "far").alias("root")).checkpoint()
        if after.join(label.withColumnRenamed("root", "old"), "node").filter("root <> old").isEmpty():
            return after.groupBy("root").agg(F.count("*").alias("size"))
        label = after


def page_order(net: Network, size: int, parts: DataFrame | None = None) -> DataFrame:
    """node_id, place, page: nodes in an order of locality, in groups of at most ``size``.

    Each group grows from the lowest node without one, by distance over the edges (with parts: within its part), until it is full or has no more to reach.
    One group follows another, so it is a task for networks that fit one worker (counted); larger ones are ordered by parts first, each on its own.
    """
    import heapq

    import numpy as np
    import pandas as pd

    if not fits_locally(net.edges):
        raise ValueError("this order walks the network in one worker; order larger ones by parts")
    graph = net.edges.sparkSession.sparkContext.broadcast(gathered(net.edges))
    listed = net.nodes.select("node_id") if parts is None else net.nodes.select("node_id").join(parts, "node_id")
    listed = listed if parts is not None else listed.withColumn("part", F.lit(0).cast("long"))

    def order(batches):
        g = graph.value
        label = {int(n): int(p) for pdf in batches for n, p in zip(pdf.node_id, pdf.part, strict=True)}
        done, rows, page = set(), [], 0
        for first in sorted(label):
            if first in done:
                continue
            heap, count = [(0.0, first)], 0
            while heap and count < size:
                d, node = heapq.heappop(heap)
                if node in done:
                    continue
                done.add(node)
                rows.append((node, len(rows), page))
                count += 1
                k = g.rank(node)
                for t, w in zip(*g.near(k), strict=True) if k is not None else ():
                    other = int(g.ids[t])
                    if other not in done and label.get(other) == label[first]:
                        heapq.heappush(heap, (d + w, other))
            page += 1
        yield pd.DataFrame(np.array(rows, "int64").reshape(-1, 3), columns=["node_id", "place", "page"])

    return listed.coalesce(1).mapInPandas(order, "node_id long, place long, page long")
