"""Group searches that stop as soon as their answer is proven, one task a group, over a broadcast graph.

The network goes to the executors as arrays while its counted edges and points are within limits;
larger ones are searched by joins (:mod:`ann`). Four ways give equal rows:

* ``expand``: all members' searches grow to a common radius; what a point lacks is bounded from below
  by that radius and by the straight line, and the radius doubles until no open point can be better.
* ``refine``: edges come by the straight-line bound of their rectangle, some at a time; distances to
  their ends come from one search a member that goes on as far as the next targets are.
* ``threshold``: nodes come by distance from the members (sorted access), a step of depth at a time; an
  edge is tried when its first end comes, unless the bounds from what is known of its ends rule it out,
  and then the missing distances come from searches that go on to them (random access).
* ``refine`` with an overlay: as refine, on the two-level graph; parts of neither member nor target
  are crossed by their shortcuts.

Each row carries what its group's search cost. Ties go by agg_dist, ni, nj, pos, pt_id.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.network import Network, placed
from .distances import Csr, fits_locally, frame

#: Points that one worker holds as arrays, 32 bytes each.
LOCAL_POINTS = 10_000_000
#: Points whose distances are worked out together.
BLOCK = 200_000
#: Tasks that hold a network with its shortcuts, which are several times the network.
TASKS = 6
_SLACK = 1e-9
COST = "settled long, popped long, heap long, tried long"
FOUND = f"qset long, rank int, pt_id long, ni long, nj long, pos double, agg_dist double, comp array<double>, {COST}"
PLACE = f"qset long, ni long, nj long, pos double, agg_dist double, {COST}"


@dataclass
class Arrays:
    """A network on a worker. Edges are the populated ones (all, for places); points are sorted by edge, starts[e]:starts[e + 1] being those of edge e."""

    graph: Csr
    x: np.ndarray
    y: np.ndarray
    a: np.ndarray
    b: np.ndarray
    w: np.ndarray
    starts: np.ndarray
    pt_id: np.ndarray
    pos: np.ndarray
    straight: bool
    overlay: "Overlay | None" = None
    at: dict = field(default_factory=dict)

    def edge(self, a: int, b: int) -> int:
        """The number of the populated edge between two ranks, or -1."""
        if not self.at and len(self.a):
            self.at = {(int(i), int(j)): k for k, (i, j) in enumerate(zip(self.a, self.b, strict=True))}
        return self.at.get((a, b), -1)


@dataclass
class Overlay:
    """part of each rank; top: shortcuts and crossing edges as a graph, at: the ranks of its nodes; inner: the whole graph with crossing edges shut."""

    part: np.ndarray
    top: Csr
    at: np.ndarray
    inner: Csr

    @classmethod
    def of(cls, graph: Csr, part: np.ndarray, short: tuple[np.ndarray, np.ndarray, np.ndarray]) -> "Overlay":
        source = np.repeat(np.arange(len(graph.ids), dtype=np.int32), np.diff(graph.starts))
        over = part[source] != part[graph.to]
        once = over & (source < graph.to)
        top = Csr(*(np.concatenate(x) for x in zip(short, (graph.ids[source[once]], graph.ids[graph.to[once]], graph.w[once]), strict=True)))
        inner = copy.copy(graph)
        inner.w = np.where(over, np.inf, graph.w)
        return cls(part, top, graph.ranks(top.ids), inner)


@dataclass
class Member:
    weight: float
    a: int
    b: int
    pos: float
    w: float
    x: float
    y: float

    @property
    def seeds(self):
        return [(self.a, self.pos), (self.b, self.w - self.pos)]


class Front:
    """A search by distance that can go on, in arrays: d holds for what is within ``radius``."""

    def __init__(self, graph: Csr, seeds):
        self.graph, self.d, self.radius, self.tally = graph, np.full(len(graph.ids), np.inf), -1.0, [0, 0]
        for k, d in seeds:
            self.d[k] = min(self.d[k], d)
        self.open = np.array([k for k, _ in seeds], np.int64)

    @property
    def settled(self) -> int:
        return int((self.d <= self.radius).sum() if len(self.open) else np.isfinite(self.d).sum())

    popped, most = property(lambda self: self.tally[0]), property(lambda self: self.tally[1])

    def grow(self, radius: float) -> None:
        """Settle all nodes up to a distance."""
        if radius > self.radius:
            self.open = self.graph.settle(self.d, self.open, radius, tally=self.tally)
            self.radius = radius if len(self.open) else np.inf

    def far(self, ranks: np.ndarray) -> np.ndarray:
        """The distances of ranks, inf where they are not settled."""
        d = self.d[ranks]
        return np.where(d <= self.radius, d, np.inf)

    def to(self, ranks: np.ndarray) -> np.ndarray:
        """The distances of ranks, after going on as far as they are."""
        while len(self.open):
            most = float(self.d[ranks].max(initial=0.0))
            if most <= self.radius:
                break
            self.grow(most if np.isfinite(most) else max(self.radius, 0.0) * 1.1 + 4 * self.graph.step)
        return self.far(ranks)


class Layered:
    """A search on the two-level graph: the seeds' parts by their own edges, then shortcuts and crossing edges to all border nodes, then from these the parts of the targets as they are asked for."""

    def __init__(self, over: Overlay, seeds):
        self.over, self.d, self.tally, self.opened = over, np.full(len(over.part), np.inf), [0, 0], set()
        for k, d in seeds:
            self.d[k] = min(self.d[k], d)
        over.inner.settle(self.d, np.array([k for k, _ in seeds], np.int64), tally=self.tally)
        top = self.d[over.at]
        over.top.settle(top, np.flatnonzero(np.isfinite(top)), tally=self.tally)
        self.d[over.at] = top

    settled = property(lambda self: int(np.isfinite(self.d).sum()))
    popped, most = property(lambda self: self.tally[0]), property(lambda self: self.tally[1])

    def to(self, ranks: np.ndarray) -> np.ndarray:
        fresh = set(np.unique(self.over.part[ranks]).tolist()) - self.opened
        if fresh:
            self.opened |= fresh
            border = self.over.at[np.isin(self.over.part[self.over.at], list(fresh))]
            self.over.inner.settle(self.d, border[np.isfinite(self.d[border])], tally=self.tally)
        return self.d[ranks]


class Best:
    """The k best points so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def kth(self) -> float:
        return self.rows[-1][0] if len(self.rows) == self.k else np.inf

    def offer(self, rows) -> None:
        self.rows = sorted([*self.rows, *rows])[: self.k]


class Group:
    """One group's search. Distances of members are rows, places columns."""

    def __init__(self, data: Arrays, members: list[Member], k: int, agg: str):
        self.data, self.members, self.best, self.sum = data, members, Best(k), agg == "sum"
        self.weight = np.array([m.weight for m in members])[:, None]
        self.own = np.array([data.edge(m.a, m.b) for m in members])
        self.tried = 0
        self.searches: list = []

    def fold(self, d: np.ndarray) -> np.ndarray:
        """The aggregate of the members' weighted distances; a sum adds them in order."""
        each = d * self.weight
        if not self.sum:
            return each.max(0)
        total = np.zeros(each.shape[1])
        for row in each:
            total = total + row
        return total

    def straight(self, x, y, x2=None, y2=None) -> np.ndarray:
        """Straight lines from the members to places, or to the rectangles between (x, y) and (x2, y2); 0 where they bound nothing."""
        x2, y2 = (x if x2 is None else x2), (y if y2 is None else y2)
        if not self.data.straight:
            return np.zeros((len(self.members), len(x)))
        mx, my = (np.array([getattr(m, c) for m in self.members])[:, None] for c in "xy")
        gap = lambda m, p, q: np.maximum(np.maximum(np.minimum(p, q) - m, m - np.maximum(p, q)), 0)
        return np.hypot(gap(mx, x, x2), gap(my, y, y2))

    def on(self, edge: np.ndarray, pos: np.ndarray, dl: np.ndarray, dr: np.ndarray) -> np.ndarray:
        """Distances to places on edges from those to the edges' ends."""
        d = np.minimum(dl + pos, dr + self.data.w[edge] - pos)
        for row, m, own in zip(d, self.members, self.own, strict=True):
            here = edge == own
            if own >= 0 and here.any():
                row[here] = np.minimum(row[here], np.abs(m.pos - pos[here]))
        return d

    def cost(self) -> tuple:
        return sum(s.settled for s in self.searches), sum(s.popped for s in self.searches), max((s.most for s in self.searches), default=0), self.tried

    def _offer(self, edge: np.ndarray, spots: np.ndarray, d: np.ndarray, total: np.ndarray) -> None:
        """Points at ``spots`` on ``edge`` with whole distances."""
        keep = np.flatnonzero(total <= self.best.kth)
        if len(keep) > 4 * self.best.k:  # no more than the ties of the k-th can matter
            keep = keep[total[keep] <= np.partition(total[keep], self.best.k - 1)[self.best.k - 1]]
        data, ids = self.data, self.data.graph.ids
        self.best.offer([(float(total[j]), int(ids[data.a[edge[j]]]), int(ids[data.b[edge[j]]]), float(data.pos[spots[j]]), int(data.pt_id[spots[j]]), d[:, j].tolist()) for j in keep])

    def _try(self, edges: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> None:
        """The points of some edges, from the distances to their two ends (members by edges)."""
        self.tried += len(edges)
        met = np.isfinite(ends[0]).all(0) & np.isfinite(ends[1]).all(0)
        edges, left, right = edges[met], ends[0][:, met], ends[1][:, met]
        first = self.data.starts[edges]
        held = self.data.starts[edges + 1] - first
        place = np.repeat(np.arange(len(edges)), held)
        spots = np.arange(len(place)) + np.repeat(first - np.cumsum(held) + held, held)
        for s in range(0, len(spots), BLOCK):
            p, i = place[s : s + BLOCK], spots[s : s + BLOCK]
            d = self.on(edges[p], self.data.pos[i], left[:, p], right[:, p])
            self._offer(edges[p], i, d, self.fold(d))

    # -- expand

    def expand(self, start: float, reach: float) -> list:
        data = self.data
        self.searches = fronts = [Front(data.graph, m.seeds) for m in self.members]
        edge = np.repeat(np.arange(len(data.a), dtype=np.int32), np.diff(data.starts))
        live, radius = np.arange(len(data.pos), dtype=np.int32), start
        while True:
            for f in fronts:
                f.grow(radius + reach)  # so that both ends of an edge with a place within the radius are known
            last = not any(len(f.open) for f in fronts)
            limit = np.inf if last else radius
            self.best, open_, low = Best(self.best.k), [], []
            for at in range(0, len(live), BLOCK):
                spots = live[at : at + BLOCK]
                e, p = edge[spots], data.pos[spots]
                d = self.on(e, p, self._far(data.a[e]), self._far(data.b[e]))
                known = (d <= limit) & np.isfinite(d)
                whole = known.all(0)
                w = np.flatnonzero(whole)
                self.tried += len(w)
                self._offer(e[w], spots[w], d[:, w], self.fold(d[:, w]))
                if not last:
                    rest = np.flatnonzero(~whole)
                    share = p[rest] / np.where(data.w[e[rest]] > 0, data.w[e[rest]], 1.0)
                    x, y = (c[data.a[e[rest]]] + share * (c[data.b[e[rest]]] - c[data.a[e[rest]]]) for c in (data.x, data.y))
                    bound = np.where(known[:, rest], d[:, rest], np.maximum(self.straight(x, y), radius))
                    open_.append(spots[rest])
                    low.append(self.fold(bound))
            if last:
                return self.best.rows
            rest, low = np.concatenate([*open_, np.zeros(0, np.int32)]), np.concatenate([*low, np.zeros(0)])
            able = rest[low <= self.best.kth + _SLACK]
            if not len(able):
                return self.best.rows
            ranks = {r[4] for r in self.best.rows}
            kept = np.flatnonzero(np.isin(data.pt_id, list(ranks))) if ranks else np.zeros(0, np.int32)
            live, radius = np.union1d(able, kept.astype(np.int32)), radius * 2

    def _far(self, ranks: np.ndarray) -> np.ndarray:
        return np.stack([f.far(ranks) for f in self.searches])

    def _bounds(self) -> np.ndarray:
        """The aggregate of straight lines to each edge's rectangle."""
        d, out = self.data, np.zeros(len(self.data.a))
        for s in range(0, len(out), BLOCK):
            a, b = d.a[s : s + BLOCK], d.b[s : s + BLOCK]
            out[s : s + BLOCK] = self.fold(self.straight(d.x[a], d.y[a], d.x[b], d.y[b]))
        return out

    # -- refine

    def _nearest(self, edges: np.ndarray, low: np.ndarray) -> np.ndarray:
        """A bound under the aggregate of every place of edges, from the least distance to their ends."""
        for row, own in zip(low, self.own, strict=True):
            row[edges == own] = 0.0
        return self.fold(low)

    def refine(self) -> list:
        data = self.data
        self.searches = [Front(data.graph, m.seeds) if data.overlay is None else Layered(data.overlay, m.seeds) for m in self.members]
        bound = self._bounds()
        self._random(np.argsort(bound, kind="stable"), bound)
        return self.best.rows

    def _random(self, edges: np.ndarray, bound: np.ndarray) -> None:
        """Try edges in order of their bound, some at a time and ever more, until the next ones cannot be better."""
        at, size = 0, 64
        while at < len(edges):
            some = edges[at : at + size]
            some = some[bound[some] <= self.best.kth + _SLACK]
            if not len(some):
                break
            at, size = at + size, min(2 * size, BLOCK // 4)
            ends = tuple(np.stack([s.to(end[some]) for s in self.searches]) for end in (self.data.a, self.data.b))
            able = self._nearest(some, np.minimum(*ends)) <= self.best.kth
            self._try(some[able], tuple(x[:, able] for x in ends))

    # -- threshold

    def threshold(self) -> list:
        """Sorted access goes to a common depth, ever deeper; the edges that it comes to and that what is known of their ends does not rule out are tried by random access."""
        data = self.data
        self.searches = fronts = [Front(data.graph, m.seeds) for m in self.members]
        whole = float(self.weight.sum() if self.sum else self.weight.max())
        seen, depth = np.zeros(len(data.a), bool), 4 * data.graph.step
        own = np.unique(self.own[self.own >= 0])  # their points may be nearer than both ends
        seen[own] = True
        self._random(own, np.zeros(len(data.a)))
        while True:
            for f in fronts:
                f.grow(depth)
            last = not any(len(f.open) for f in fronts)
            near = np.full(len(data.a), np.inf)
            for f in fronts:
                near = np.minimum(near, np.minimum(f.d[data.a], f.d[data.b]))
            fresh = np.flatnonzero(~seen & np.isfinite(near) & (last | (near <= depth)))
            seen[fresh] = True
            bound = np.full(len(data.a), np.inf)
            for s in range(0, len(fresh), BLOCK):
                e = fresh[s : s + BLOCK]
                low = np.stack([np.minimum(*(np.where(f.d[end[e]] <= f.radius, f.d[end[e]], np.maximum(line, f.radius)) for end, line in ((data.a, la), (data.b, lb)))) for f, la, lb in zip(fronts, *(self.straight(data.x[end[e]], data.y[end[e]]) for end in (data.a, data.b)), strict=True)])
                bound[e] = self._nearest(e, low)
            fresh = fresh[bound[fresh] <= self.best.kth + _SLACK]
            self._random(fresh[np.argsort(bound[fresh], kind="stable")], bound)
            # every edge that no member has come to is over the depth from all of them
            if last or whole * depth > self.best.kth + _SLACK:
                return self.best.rows
            depth = 1.25 * depth + 4 * data.graph.step

    # -- the best place anywhere

    def place(self, start: float, reach: float) -> tuple | None:
        """(agg_dist, ni, nj, pos): of all edges, by growing a common radius; the least lies at an end, at a member, or (for maxima) where a rising and a falling distance cross."""
        data = self.data
        self.searches = fronts = [Front(data.graph, m.seeds) for m in self.members]
        radius, low = start, np.zeros(len(data.a))
        while True:
            for f in fronts:
                f.grow(radius + reach)
            last, top = not any(len(f.open) for f in fronts), np.inf
            for s in range(0, len(data.a), BLOCK):
                e = np.arange(s, min(s + BLOCK, len(data.a)))
                dl, dr = self._far(data.a[e]), self._far(data.b[e])
                top = min(top, self.fold(dl).min(), self.fold(dr).min())
                near = np.minimum(dl, dr)
                if not last:
                    box = self.straight(data.x[data.a[e]], data.y[data.a[e]], data.x[data.b[e]], data.y[data.b[e]])
                    near = np.where(np.isfinite(near), near, np.maximum(box, radius))
                low[e] = self._nearest(e, near)
            able = np.flatnonzero(low <= top + _SLACK)
            if np.isfinite(top) and (last or all(np.isfinite(f.far(end[able])).all() for f in fronts for end in (data.a, data.b))):
                break
            if last:
                return None
            radius *= 2
        found = None
        for e in able.tolist():
            dl, dr = self._far(data.a[[e]]), self._far(data.b[[e]])
            if not (np.isfinite(dl).all() and np.isfinite(dr).all()):
                continue
            self.tried += 1
            pos = np.array(sorted(self._places(e, dl[:, 0], dr[:, 0])))
            total = self.fold(self.on(np.full(len(pos), e), pos, dl, dr))
            j = int(np.lexsort((pos, total))[0])
            row = (float(total[j]), int(data.graph.ids[data.a[e]]), int(data.graph.ids[data.b[e]]), float(pos[j]))
            found = row if found is None else min(found, row)
        return found

    def _places(self, e: int, dl: np.ndarray, dr: np.ndarray) -> set:
        w = float(self.data.w[e])
        here = [(m.weight, m.pos) for m, own in zip(self.members, self.own, strict=True) if own == e]
        places = {0.0, w, *(p for _, p in here)}
        if not self.sum:
            weight = self.weight[:, 0]
            rising = [*zip(weight * dl, weight, strict=True), *((-v * p, v) for v, p in here)]
            falling = [*zip(weight * (dr + w), weight, strict=True), *((v * p, v) for v, p in here)]
            cross = {(b - a) / (m + n) for a, m in rising for b, n in falling if m + n > 0}
            places |= {float(x) for x in cross if 0 < x < w}
        return places


def fits(net: Network) -> bool:
    """Whether a worker can hold the network, by count."""
    return fits_locally(net.edges) and (net.points is None or net.points.limit(LOCAL_POINTS + 1).count() <= LOCAL_POINTS)


def gathered_network(net: Network, straight: bool = True, every: bool = False, parts: DataFrame | None = None, short: DataFrame | None = None) -> Arrays:
    """The network on the driver; call only if it fits. every: all edges are candidates, not only those with points."""
    edges = frame(net.edges.select("ni", "nj", F.col("w").cast("double").alias("w"))).sort_values(["ni", "nj"])
    ni, nj, w = edges.ni.to_numpy(np.int64), edges.nj.to_numpy(np.int64), edges.w.to_numpy(np.float64)
    graph = Csr(ni, nj, w)
    at = frame(net.nodes.select("node_id", "x", "y")).set_index("node_id").reindex(graph.ids)
    a, b = (graph.ranks(x).astype(np.int32) for x in (ni, nj))
    empty = np.zeros(0, np.int64)
    pt_id, pos, of = empty, np.zeros(0), empty
    if net.points is not None and not every:
        points = frame(net.points.select("pt_id", "ni", "nj", F.col("pos").cast("double").alias("pos"))).merge(edges.assign(e=np.arange(len(edges)))[["ni", "nj", "e"]], on=["ni", "nj"])
        points = points.sort_values(["e", "pos", "pt_id"])
        held, of = np.unique(points.e.to_numpy(np.int64), return_inverse=True)
        a, b, w = a[held], b[held], w[held]
        pt_id, pos = points.pt_id.to_numpy(np.int64), points.pos.to_numpy(np.float64)
    starts = np.searchsorted(of, np.arange(len(a) + 1))
    overlay = None
    if parts is not None:
        part = frame(parts.select("node_id", "part")).set_index("node_id").part.reindex(graph.ids).to_numpy()
        s = frame(short.select("bi", "bj", "d"))
        overlay = Overlay.of(graph, part.astype(np.int64), (s.bi.to_numpy(np.int64), s.bj.to_numpy(np.int64), s.d.to_numpy(np.float64)))
    known = straight and not bool(at.x.isna().any() or at.y.isna().any())
    return Arrays(graph, at.x.to_numpy(float), at.y.to_numpy(float), a, b, w, starts, pt_id, pos, known, overlay)


def _grouped(net: Network, queries: DataFrame, run, schema: str, weighted: bool, data: Arrays) -> DataFrame:
    import pandas as pd

    shared = net.edges.sparkSession.sparkContext.broadcast(data)
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    who = placed(queries.withColumn("weight", weight), net.edges).select(F.col("qset").cast("long").alias("qset"), F.col("qi").cast("long").alias("qi"), "weight", "ni", "nj", "pos", "w")
    columns = [c.split()[0] for c in schema.split(", ")]

    def search(key, pdf):
        d = shared.value
        members = []
        for m in pdf.sort_values("qi").itertuples():
            a, b = d.graph.rank(m.ni), d.graph.rank(m.nj)
            share = m.pos / m.w if m.w > 0 else 0.0
            members.append(Member(m.weight, a, b, m.pos, m.w, d.x[a] + share * (d.x[b] - d.x[a]), d.y[a] + share * (d.y[b] - d.y[a])))
        return pd.DataFrame([(key[0], *r) for r in run(d, members)], columns=columns)

    return who.groupBy("qset").applyInPandas(search, schema)


def _start(data: Arrays) -> tuple[float, float]:
    """The first radius, and the longest edge."""
    w = data.graph.w
    return (float(8 * w.mean()) or 1.0, float(w.max())) if len(w) else (1.0, 0.0)


def ann_search(net: Network, queries: DataFrame, k: int = 10, agg: str = "sum", weighted: bool = False, method: str = "expand", straight: bool = True, parts: DataFrame | None = None, short: DataFrame | None = None) -> DataFrame:
    """FOUND: the k best points of each group and the group's costs (nodes settled, heap pops, largest heap, points or edges tried).

    straight: weights are at least straight lines, so these bound distances. parts (node_id, part) and short (of prepare.shortcuts) make refine search the two-level graph.
    """
    if agg not in ("sum", "max"):
        raise ValueError(f"agg is sum or max, not {agg}")
    if method not in ("expand", "refine", "threshold"):
        raise ValueError(f"method is expand, refine or threshold, not {method}")
    if not fits(net):
        raise ValueError("this network does not fit a worker; use ann_concurrent with the frame strategy")
    data = gathered_network(net, straight, parts=parts, short=short)

    def run(d: Arrays, members):
        group = Group(d, members, k, agg)
        rows = group.expand(*_start(d)) if method == "expand" else group.refine() if method == "refine" else group.threshold()
        return [(rank, pt_id, ni, nj, pos, total, comp, *group.cost()) for rank, (total, ni, nj, pos, pt_id, comp) in enumerate(rows, 1)]

    return _grouped(net, queries, run, FOUND, weighted, data)


def center_search(net: Network, queries: DataFrame, agg: str = "sum", weighted: bool = False, straight: bool = True) -> DataFrame:
    """PLACE: the best place anywhere for each group, and the group's costs."""
    if agg not in ("sum", "max"):
        raise ValueError(f"agg is sum or max, not {agg}")
    if not fits(net):
        raise ValueError("this network does not fit a worker; use center with the frame strategy")
    data = gathered_network(net, straight, every=True)

    def run(d: Arrays, members):
        group = Group(d, members, 1, agg)
        found = group.place(*_start(d))
        return [] if found is None else [(*found[1:], found[0], *group.cost())]

    return _grouped(net, queries, run, PLACE, weighted, data)


def overlay_search(net: Network, queries: DataFrame, parts: DataFrame, short: DataFrame) -> DataFrame:
    """qset, qi, node, d: distances from each query to the nodes of every part (node_id, part) over the two-level graph; one search a query, in few tasks, since each holds the shortcuts."""
    import pandas as pd

    if not fits_locally(net.edges):
        raise ValueError("this network does not fit a worker; use prepare.overlay_distances for one part after another")
    shared = net.edges.sparkSession.sparkContext.broadcast(gathered_network(net, False, True, parts, short))
    who = placed(queries, net.edges).select(F.col("qset").cast("long").alias("qset"), F.col("qi").cast("long").alias("qi"), "ni", "nj", "pos", "w")
    def run(batches):
        d = shared.value
        for pdf in batches:
            for q in pdf.itertuples():
                search = Layered(d.overlay, [(d.graph.rank(int(q.ni)), float(q.pos)), (d.graph.rank(int(q.nj)), float(q.w - q.pos))])
                far = search.to(np.arange(len(d.graph.ids)))
                met = np.isfinite(far)
                yield pd.DataFrame({"qset": q.qset, "qi": q.qi, "node": d.graph.ids[met], "d": far[met]})

    return who.repartition(TASKS, "qset", "qi").mapInPandas(run, "qset long, qi long, node long, d double")
