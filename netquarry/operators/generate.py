"""Seeded generators of data points and query groups. All randomness comes from hashes of keys, so results do not depend on partitioning."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.network import Network, adjacency, numbered
from .distances import Csr, distances, fits_locally, gathered
from .estimate import from_nodes

POINTS = "pt_id long, ni long, nj long, pos double"


def spaced_points(net: Network, step: float, phase: float = 0.0) -> DataFrame:
    """pt_id, ni, nj, pos: points every ``step`` along each edge, each edge's phase carried by a seeded hash; no traversal, so it scales."""
    h = F.pmod(F.xxhash64("ni", "nj"), F.lit(1 << 30)) / float(1 << 30)
    first = (h + phase) % 1.0 * step
    places = F.when(first <= F.col("w"), F.sequence(F.lit(0), F.floor((F.col("w") - first) / step).cast("int")))
    rows = net.edges.select("ni", "nj", F.explode(F.transform(places, lambda k: first + k * step)).alias("pos"))
    return numbered(rows, "pt_id", "ni", "nj", "pos").select("pt_id", "ni", "nj", "pos")


def carried_points(net: Network, step: float, start: int = 0) -> DataFrame:
    """Points every ``step`` of travelled length along an expansion from ``start``; what is left at an edge's end is carried to the next. Sequential, so it is a tool for networks that fit one worker."""
    _fitting(net)
    g = gathered(net.edges)
    done, heap, rows, seen = set(), [(0.0, g.rank(start), 0.0)], [], set()
    while heap and heap[0][1] is not None:
        d, k, left = heapq.heappop(heap)
        if k in done:
            continue
        done.add(k)
        for j in range(g.starts[k], g.starts[k + 1]):
            t, w = int(g.to[j]), float(g.w[j])
            if (min(k, t), max(k, t)) in seen:
                continue
            seen.add((min(k, t), max(k, t)))
            at, a, b = step - left, int(g.ids[k]), int(g.ids[t])
            while at <= w:
                rows.append((min(a, b), max(a, b), at if a < b else w - at))
                at += step
            heapq.heappush(heap, (d + w, t, w - (at - step)))
    rows.sort()
    return net.edges.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], POINTS)


def _fitting(net: Network) -> None:
    if not fits_locally(net.edges):
        raise ValueError("this generator walks the network in one worker; use spaced_points on larger ones")


def mean_step(net: Network, share: float = 1.0) -> float:
    """A step for the generators: a share of the mean edge length."""
    return share * (net.edges.agg(F.avg("w")).first()[0] or 0.0)


def _cluster(g: Csr, start: int, n: int, step: float, factor: float, rng) -> list[tuple[int, int, float]]:
    """n points around a node, the first at the node itself: steps grow evenly from ``step`` to ``factor`` times it over the cluster, each jittered by [0.5, 1.5); what is left at an edge's end goes on along each way from there."""
    done, heap, rows = set(), [(0.0, start, step)], []
    first = next(iter(g.near(start)[0]), None)
    if first is not None:
        rows.append((min(start, first), max(start, first), 0.0 if start < first else float(g.w[g.starts[start]])))
    while heap and len(rows) < n:
        d, k, wait = heapq.heappop(heap)
        if k in done:
            continue
        done.add(k)
        for t, w in zip(*g.near(k), strict=True):
            if t in done:
                continue
            at = wait
            while at <= w and len(rows) < n:
                rows.append((min(k, t), max(k, t), at if k < t else w - at))
                grown = step * (1 + (factor - 1) * len(rows) / n)
                at += grown * (0.5 + rng.random())
            heapq.heappush(heap, (d + w, t, at - w))
    if len(rows) < n:
        raise ValueError(f"the network around node {int(g.ids[start])} has room for {len(rows)} of {n} points of a cluster")
    return [(int(g.ids[a]), int(g.ids[b]), p) for a, b, p in rows]


def clusters(net: Network, n: int, size: int, step: float, factor: float = 1.0, seed: int = 1) -> DataFrame:
    """cluster, ni, nj, pos: n clusters of ``size`` points around seeded nodes with edges, grown in parallel, one task a cluster. Raises if one runs out of network."""
    import pandas as pd

    _fitting(net)
    graph = net.edges.sparkSession.sparkContext.broadcast(gathered(net.edges))
    able = net.nodes.join(net.edges.select(F.explode(F.array("ni", "nj")).alias("node_id")).distinct(), "node_id", "left_semi")
    picked = [r.node_id for r in able.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(n).collect()]
    starts = net.edges.sparkSession.createDataFrame(list(enumerate(picked, 1)), "cluster long, node_id long")

    def grow(pdf):
        g, c = graph.value, int(pdf.cluster.iloc[0])
        rows = _cluster(g, g.rank(pdf.node_id.iloc[0]), size, step, factor, np.random.default_rng((seed, c)))
        return pd.DataFrame([(c, *r) for r in rows], columns=["cluster", "ni", "nj", "pos"]).astype({"cluster": "int64", "ni": "int64", "nj": "int64", "pos": "float64"})

    return starts.groupBy("cluster").applyInPandas(grow, "cluster long, ni long, nj long, pos double")


def closest_nodes(net: Network, start: int, n: int, strategy: str = "auto") -> DataFrame:
    """node, d: the n nodes nearest to a node over the network, ties to lower ids."""
    one = net.nodes.filter(F.col("node_id") == start).select("node_id")
    dist = distances(from_nodes(net, one), net.edges, strategy=strategy)
    return dist.select("node", "d").orderBy("d", "node").limit(n)


def queries_within(net: Network, members: int, share: float, seed: int = 1, qset: int = 0, strategy: str = "auto") -> DataFrame:
    """qset, qi, ni, nj, pos, weight: a group of ``members`` query points among the nearest ``share`` (a fraction) of all nodes to a seeded node: every so-many-th node, a seeded edge of it, a seeded offset."""
    total = net.nodes.count()
    n = max(members, int(total * share))
    start = net.nodes.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").first()["node_id"]
    near = closest_nodes(net, start, n, strategy)
    every = max(1, min(n, total) // members)
    picked = numbered(near, "i", "d", "node").filter((F.col("i") % every == 0) & (F.col("i") < every * members))
    adj = adjacency(net.edges).join(picked.select(F.col("node").alias("src"), "i"), "src")
    chosen = adj.groupBy("src", "i").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "src", "dst").alias("h"), "dst", "w")).alias("m"))
    u = F.pmod(F.xxhash64(F.lit(seed + 1), "src", "m.dst"), F.lit(1 << 30)) / float(1 << 30)
    return chosen.select(F.lit(qset).cast("long").alias("qset"), F.expr(f"i div {every}").cast("long").alias("qi"), F.least("src", "m.dst").alias("ni"), F.greatest("src", "m.dst").alias("nj"), (u * F.col("m.w")).alias("pos"), F.lit(1.0).alias("weight"))
