"""Searches over a network dealt out in blocks of edges, so that no task holds more than a block however large the network is.

Each edge is in one block (by ranges of its ``ni``, with its points); a node whose edges are in several blocks is on their border.
``reach`` finds the distances of all border nodes: by rounds, in which blocks whose border came nearer are searched in
arrays and tell their other border nodes, or (``local``) by one search a query over the whole graph, broadcast. With them each block
knows its distances by itself: ``each`` searches every block once more and hands its arrays and distances to a function.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.network import Network, placed, with_ends
from .distances import Csr, fits_locally, frame, gathered

#: Edges and points of one block, about 40 bytes each.
BLOCK = 200_000
#: Queries that one task searches for at once; a group that must be seen whole may have more.
TOGETHER = 32
_ENTRY = "no long, node long, d double"


@dataclass
class Block:
    """Arrays of one block: edges between ranks a and b of its graph, sorted by them; points sorted by edge, starts[e]:starts[e + 1] being those of edge e; own: nodes that no lower block holds; ends: x1, y1, x2, y2 of each edge."""

    graph: Csr
    a: np.ndarray
    b: np.ndarray
    w: np.ndarray
    border: np.ndarray
    own: np.ndarray
    starts: np.ndarray
    pt_id: np.ndarray
    pos: np.ndarray
    ends: np.ndarray
    at: dict = field(default_factory=dict)

    def edge(self, ni: int, nj: int) -> int:
        """The number of an edge, or -1."""
        if not self.at and len(self.a):
            ids = self.graph.ids
            self.at = dict(zip(zip(ids[self.a].tolist(), ids[self.b].tolist(), strict=True), range(len(self.a)), strict=True))
        return self.at.get((int(ni), int(nj)), -1)

    def to_places(self, rows: pd.DataFrame, d: np.ndarray, edge: np.ndarray, pos: np.ndarray, own: list[int]) -> np.ndarray:
        """Distances (queries by places) to places on edges."""
        out = np.minimum(d[:, self.a[edge]] + pos, d[:, self.b[edge]] + (self.w[edge] - pos))
        for k, (e, p) in enumerate(zip(own, rows.pos, strict=True)):
            here = np.flatnonzero(edge == e) if e >= 0 else ()
            if len(here):
                out[k, here] = np.minimum(out[k, here], np.abs(p - pos[here]))
        return out

    def own_edges(self, rows: pd.DataFrame) -> list[int]:
        """The edge of each query that lies in this block, -1 for others."""
        return [self.edge(i, j) for i, j in zip(rows.ni, rows.nj, strict=True)]


def located(queries: DataFrame, edges: DataFrame) -> pd.DataFrame:
    """The queries on the driver (60 bytes each) by qset, qi: qset, qi, ni, nj, pos, w, weight. Raises on one that is on no edge."""
    at = queries if "weight" in queries.columns else queries.withColumn("weight", F.lit(1.0))
    names = ["qset", "qi", "ni", "nj", "pos", "weight"]
    rows = placed(at.select(*[F.col(c).cast("double" if c in ("pos", "weight") else "long").alias(c) for c in names]), edges).toPandas()
    return rows.sort_values(["qset", "qi", "ni", "nj", "pos"], ignore_index=True)


def pack(pdf: pd.DataFrame) -> bytes:
    """A Block of rows (kind 0: edge a, b, v; 1: border node a of blocks from b on; 2: point c on a, b at v)."""
    block = int(pdf.block.iloc[0])
    e = pdf[pdf.kind == 0].sort_values(["a", "b"])
    ni, nj, w = e.a.to_numpy(np.int64), e.b.to_numpy(np.int64), e.v.to_numpy(np.float64)
    graph = Csr(ni, nj, w)
    a, b = (graph.ranks(x).astype(np.int32) for x in (ni, nj))
    edge = pdf[pdf.kind == 1]
    border = graph.ranks(edge.a)
    own = np.ones(len(graph.ids), bool)
    own[border[edge.b.to_numpy(np.int64) < block]] = False
    p = pdf[pdf.kind == 2]
    p = p.merge(pd.DataFrame({"a": ni, "b": nj, "e": np.arange(len(ni))}), on=["a", "b"]).sort_values(["e", "v", "c"])
    starts = np.searchsorted(p.e.to_numpy(np.int64), np.arange(len(ni) + 1))
    return pickle.dumps(Block(graph, a, b, w, border, own, starts, p.c.to_numpy(np.int64), p.v.to_numpy(np.float64), e[["x1", "y1", "x2", "y2"]].to_numpy(np.float64).T), protocol=5)


class Blocks:
    """The edges (and points) of a network in blocks; coords: with the coordinates of the edges' ends."""

    def __init__(self, net: Network, points: bool = True, coords: bool = False):
        self.net, held, self.spark = net, points and net.points is not None, net.edges.sparkSession
        low = net.edges.select("ni").unionByName(net.points.select("ni")) if held else net.edges.select("ni")
        n = -(-low.count() // BLOCK) or 1
        self.cuts = np.array(sorted(set(low.approxQuantile("ni", [k / n for k in range(1, n)], 1 / (8 * n)))) if n > 1 else [], np.int64)
        spots = ["x1", "y1", "x2", "y2"]
        edges = with_ends(net.edges, net.nodes) if coords else net.edges.withColumns({c: F.lit(None).cast("double") for c in spots})
        edges = self._dealt(edges.select(F.lit(0).alias("kind"), F.col("ni").alias("a"), F.col("nj").alias("b"), F.lit(0).cast("long").alias("c"), F.col("w").cast("double").alias("v"), *spots))
        none = [F.lit(None).cast("double").alias(c) for c in spots]
        rows, self.border = edges, None
        if len(self.cuts):
            met = edges.select(F.explode(F.array("a", "b")).alias("node"), "block").groupBy("node").agg(F.collect_set("block").alias("blocks"))
            border = met.filter(F.size("blocks") > 1).select("node", F.array_min("blocks").alias("least"), F.explode("blocks").alias("block")).checkpoint()
            self.border = border.select("node", "block")
            rows = rows.unionByName(border.select(F.lit(1).alias("kind"), F.col("node").alias("a"), F.col("least").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("v"), *none, "block"))
        if held:
            rows = rows.unionByName(self._dealt(net.points.select(F.lit(2).alias("kind"), F.col("ni").alias("a"), F.col("nj").alias("b"), F.col("pt_id").cast("long").alias("c"), F.col("pos").cast("double").alias("v"), *none)))
        self.packed = rows.groupBy("block").applyInPandas(lambda pdf: pd.DataFrame({"block": pdf.block.iloc[:1], "net": [pack(pdf)]}), "block long, net binary").checkpoint()

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows (a, ...) with their block."""
        cuts = self.cuts
        if not len(cuts):
            return rows.withColumn("block", F.lit(0).cast("long"))

        @F.pandas_udf("long")
        def block(a: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, a.to_numpy(np.int64), side="right").astype("int64"))

        return rows.withColumn("block", block("a"))

    def reach(self, rows: pd.DataFrame, bound: float | None = None, strategy: str = "auto") -> DataFrame:
        """block, no, node, d: for each row of located, by number, the ends of its edge (over the bound too: places between them may be near) and the border nodes that it reaches (within the bound)."""
        limit = np.inf if bound is None else float(bound)
        block = np.searchsorted(self.cuts, rows.ni.to_numpy(np.int64), side="right")
        ends = [pd.DataFrame({"block": block, "no": np.arange(len(rows)), "node": rows[c].to_numpy(np.int64), "d": d}) for c, d in (("ni", rows.pos), ("nj", rows.w - rows.pos))]
        seeds = self.spark.createDataFrame(pd.concat(ends).astype({"block": "int64", "no": "int64", "d": "float64"}), f"block long, {_ENTRY}")
        if self.border is None or not len(rows):
            return seeds
        if strategy == "auto":
            strategy = "local" if fits_locally(self.net.edges) else "frame"
        met = self._local(rows, limit) if strategy == "local" else self._rounds(seeds, limit, len(rows))
        return seeds.unionByName(met.join(self.border, "node").select("block", "no", "node", "d")).checkpoint()

    def _local(self, rows: pd.DataFrame, limit: float) -> DataFrame:
        graph = gathered(self.net.edges)
        border = graph.ranks(frame(self.border.select("node").distinct()).node.to_numpy(np.int64))
        shared = self.spark.sparkContext.broadcast((graph, border))
        who = rows[["ni", "nj", "pos", "w"]].assign(no=np.arange(len(rows), dtype="int64"))

        def run(batches):
            g, at = shared.value
            for pdf in batches:
                for q in pdf.itertuples():
                    d = g.all_from([(g.rank(q.ni), q.pos), (g.rank(q.nj), q.w - q.pos)], limit)[at]
                    met = np.isfinite(d)
                    yield pd.DataFrame({"no": q.no, "node": g.ids[at[met]], "d": d[met]})

        return self.spark.createDataFrame(who).repartition(min(len(who), 10_000), "no").mapInPandas(run, _ENTRY)

    def _rounds(self, seeds: DataFrame, limit: float, count: int) -> DataFrame:
        """The nearest distances of border nodes: as long as some come nearer, the other blocks that hold them are searched from these."""
        parts = -(-count // TOGETHER)
        chunk = F.expr(f"no div {TOGETHER}")
        work, seen = seeds.withColumn("chunk", chunk), None

        def step(key, new, net):
            if not len(new) or not len(net):
                return pd.DataFrame({"no": [], "node": [], "d": [], "of": []}).astype({"no": "int64", "node": "int64", "d": "float64", "of": "int64"})
            g = pickle.loads(net.net.iloc[0])
            no, d = searched(g, new, new.no.unique(), limit)
            far = d[:, g.border]
            k, b = np.nonzero(np.isfinite(far))
            return pd.DataFrame({"no": no[k], "node": g.graph.ids[g.border[b]], "d": far[k, b], "of": int(key[0])})

        while True:
            blocks = [r.block for r in work.select("block").distinct().collect()]
            if not blocks:
                return seen if seen is not None else seeds.select("no", "node", "d").limit(0)
            nets = self.packed.filter(F.col("block").isin(blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
            out = work.groupBy("block", "chunk").cogroup(nets.groupBy("block", "chunk")).applyInPandas(step, f"{_ENTRY}, of long")
            best = out.groupBy("no", "node").agg(F.min(F.struct("d", "of")).alias("m")).select("no", "node", "m.d", "m.of")
            if seen is not None:
                best = best.join(seen.withColumnRenamed("d", "old"), ["no", "node"], "left").filter("old is null or d < old").drop("old")
            best = best.checkpoint()
            seen = best.drop("of") if seen is None else seen.unionByName(best.drop("of")).groupBy("no", "node").agg(F.min("d").alias("d")).checkpoint()
            # the block that a distance comes from has searched from it already
            work = best.join(self.border, "node").filter("block <> of").select("block", "no", "node", "d", chunk.alias("chunk")).checkpoint()

    def each(self, rows: pd.DataFrame, entries: DataFrame, run, schema: str, bound: float | None = None, grouped: bool = False) -> DataFrame:
        """run(block, rows, d) of every block that is reached, for some rows of located at a time (grouped: never a part of a qset): d holds the distance of each row (down) to each rank, inf if it is not reached within the bound."""
        limit, chunks, spare = np.inf if bound is None else float(bound), [], 0
        for size in rows.groupby("qset", sort=True).size() if grouped else np.ones(len(rows), int):
            spare -= size
            if spare < 0:
                chunks.append(0)
                spare = TOGETHER - size
            chunks[-1] += int(size)
        of = np.repeat(np.arange(len(chunks)), chunks)
        first = np.concatenate([[0], np.cumsum(chunks)])
        shared = self.spark.sparkContext.broadcast((rows, first))
        names = [c.split()[0] for c in schema.split(", ")]
        numbers = self.spark.createDataFrame(pd.DataFrame({"no": np.arange(len(rows)), "chunk": of}).astype("int64"), "no long, chunk long")
        work = entries.join(numbers if len(rows) > 100_000 else F.broadcast(numbers), "no")
        active = F.broadcast(work.select(F.col("block").alias("of"), F.col("chunk").alias("part")).distinct())
        nets = self.packed.join(active, F.col("block") == F.col("of")).select(F.col("of").alias("block_"), "part", "net")

        def one(key, new, net):
            all_, start = shared.value
            if not len(new) or not len(net):
                return pd.DataFrame([], columns=names)
            block, chunk = pickle.loads(net.net.iloc[0]), int(key[1])
            some = all_.iloc[start[chunk] : start[chunk + 1]]
            _, d = searched(block, new, np.arange(start[chunk], start[chunk + 1]), limit)
            return run(block, some, d)

        return work.groupBy("block", "chunk").cogroup(nets.groupBy("block_", "part")).applyInPandas(one, schema)

    def scan(self, run, schema: str) -> DataFrame:
        """run(block), a DataFrame, of every block."""
        return self.packed.mapInPandas(lambda batches: (run(pickle.loads(x)) for pdf in batches for x in pdf.net), schema)


def searched(block: Block, entries: pd.DataFrame, numbers: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """numbers, and for each (down) the distances to all ranks of a block from its entries (no, node, d); inf over the limit."""
    g, numbers = block.graph, np.sort(numbers)
    n = len(g.ids)
    d = np.full(len(numbers) * n, np.inf)
    at = np.searchsorted(numbers, entries.no.to_numpy(np.int64)) * n + g.ranks(entries.node)
    np.minimum.at(d, at, entries.d.to_numpy(float))
    g.settle(d, at, limit)
    d[d > limit] = np.inf
    return numbers, d.reshape(len(numbers), n)


def blocks_of(net: Network, coords: bool = False) -> Blocks:
    """The blocks of a network, made once."""
    made = net.__dict__.setdefault("_blocks", {})
    if coords not in made:
        made[coords] = Blocks(net, coords=coords)
    return made[coords]
