"""The data model: a road network with data points on its edges, and groups of query points.

nodes(node_id, x, y), edges(ni < nj, w; unique), points(pt_id, ni, nj, pos), queries(qset, qi, ni, nj, pos, weight), where
0 <= pos <= w is measured from ni. Weights are at least the straight-line length wherever Euclidean bounds are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Network:
    nodes: DataFrame
    edges: DataFrame
    points: DataFrame | None = None


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, ends ascending, with its least weight; loops go, since no shortest path uses one."""
    ends = edges.select(F.least("ni", "nj").alias("ni"), F.greatest("ni", "nj").alias("nj"), F.col("w").cast("double").alias("w"))
    return ends.filter("ni <> nj").groupBy("ni", "nj").agg(F.min("w").alias("w"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, w: both directions of each edge."""
    return edges.select(F.col("ni").alias("src"), F.col("nj").alias("dst"), "w").unionByName(edges.select(F.col("nj").alias("src"), F.col("ni").alias("dst"), "w"))


def placed(things: DataFrame, edges: DataFrame, check: bool = True) -> DataFrame:
    """things (ni, nj, pos, ...) with their edge's w, ends ascending (a flipped pos counts from the other end).

    With check, raises if a row names no edge or lies outside it; that is one job over the few query rows, so leave it out for large tables.
    """
    flip = F.col("ni") > F.col("nj")
    rest = [c for c in things.columns if c not in ("ni", "nj", "pos", "w")]
    low = things.select(*rest, F.least("ni", "nj").alias("ni"), F.greatest("ni", "nj").alias("nj"), F.col("pos").alias("_pos"), flip.alias("_flip"))
    joined = low.join(edges.select("ni", "nj", "w"), ["ni", "nj"], "left" if check else "inner")
    out = joined.withColumn("pos", F.when(F.col("_flip"), F.col("w") - F.col("_pos")).otherwise(F.col("_pos")).cast("double"))
    if check:
        bad = out.filter(F.col("w").isNull() | F.col("pos").isNull() | (F.col("pos") < 0) | (F.col("pos") > F.col("w"))).limit(3).collect()
        if bad:
            raise ValueError(f"not on an edge of the network: {[(r.ni, r.nj, r.pos) for r in bad]}")
    return out.select(*rest, "ni", "nj", "pos", "w")


def validate(net: Network) -> dict[str, int]:
    """How many rows break each invariant; all 0 on a sound network."""
    from ..functions.geometry import euclid

    n, e = net.nodes, net.edges
    ends = with_ends(e, n)
    broken = {
        "unordered": e.filter("ni >= nj"),
        "repeated": e.groupBy("ni", "nj").count().filter("count > 1"),
        "negative": e.filter("w < 0"),
        "dangling": e.join(n, e.ni == n.node_id, "left_anti").unionByName(e.join(n, e.nj == n.node_id, "left_anti")),
        "too_short": ends.filter(F.col("w") < euclid(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) - 1e-9),
    }
    if net.points is not None:
        p = net.points.join(e, ["ni", "nj"], "left")
        broken["off_edge"] = p.filter("w is null or pos < 0 or pos > w")
    return {k: v.count() for k, v in broken.items()}


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the coordinates x1, y1 of ni and x2, y2 of nj."""
    a = nodes.select(F.col("node_id").alias("ni"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("nj"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "ni").join(b, "nj")


def with_xy(things: DataFrame, net: Network) -> DataFrame:
    """things (ni, nj, pos, ...) with their x and y, straight between the edge's ends."""
    from ..functions.geometry import along

    rest = [c for c in things.columns if c not in ("x", "y", "w")]
    ends = with_ends(net.edges, net.nodes)
    both = things.select(*rest).join(ends, ["ni", "nj"])
    return both.select(*rest, "w", along(F.col("x1"), F.col("x2"), F.col("pos"), F.col("w")).alias("x"), along(F.col("y1"), F.col("y2"), F.col("pos"), F.col("w")).alias("y"))


def running(df: DataFrame, into: str, amount: Column, *order: str | Column) -> DataFrame:
    """The sum of ``amount`` (a whole number) over all rows before, in the given order, without one global window: ranges are sorted and their sums added up.

    The ranges are checkpointed before they are summed, since sampling could draw others in a second run. The driver sees one number for each partition.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    sorted_ = df.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_amount", amount.cast("long")).checkpoint()
    sums = {r["_part"]: r["s"] for r in sorted_.groupBy("_part").agg(F.sum("_amount").alias("s")).collect()}
    before, run = {}, 0
    for k in sorted(sums):
        before[k], run = run, run + (sums[k] or 0)
    if not before:
        return df.withColumn(into, F.lit(0).cast("long"))
    start = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_amount").over(inner), F.lit(0)) + start[F.col("_part").cast("long")]
    return sorted_.withColumn(into, total.cast("long")).drop("_part", "_amount")


def numbered(df: DataFrame, into: str, *order: str | Column) -> DataFrame:
    """Dense numbers from 0 in the given order (see running)."""
    return running(df, into, F.lit(1), *order)


def derived(spark: SparkSession, sf_dir: str) -> tuple[Network, DataFrame]:
    """A deterministic network made from the customer, part and nation tables in whole-number arithmetic, and its queries.

    Nodes lie on a jittered grid; edges join right and lower neighbours; every weight and offset is a multiple of 0.25, so sums are exact.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    ids = read("customer").select(F.col("c_custkey").cast("long").alias("node_id"))
    size = ids.agg(F.count("*").alias("n"), F.ceil(F.sqrt(F.count("*").cast("double"))).cast("long").alias("g"))
    i, g, n = F.col("node_id"), F.col("g"), F.col("n")
    wide = ids.crossJoin(F.broadcast(size))  # one row
    place = wide.select("node_id", "n", "g", ((i % g) * 100 + (i * 37) % 41).alias("x"), (F.expr("node_id div g") * 100 + (i * 53) % 43).alias("y"))
    near = F.array(F.when(((i + 1) % g != 0) & (i + 1 < n), i + 1), F.when(i + g < n, i + g))
    pairs = place.select(i.alias("ni"), "x", "y", F.explode(near).alias("nj")).filter("nj is not null")
    ends = place.select(i.alias("nj"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    w = F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2")) + (F.col("ni") * 31 + F.col("nj") * 17) % 23
    edges = pairs.join(ends, "nj").select("ni", "nj", w.cast("double").alias("w"))
    listed = numbered(edges, "eidx", "ni", "nj").checkpoint()  # read by points, queries and every search
    e = F.broadcast(listed.agg(F.count("*").alias("e")))
    points = read("part").select(F.col("p_partkey").cast("long").alias("pt_id")).crossJoin(e).withColumn("eidx", (F.col("pt_id") * 7919) % F.col("e"))
    points = points.join(listed, "eidx").select("pt_id", "ni", "nj", (((F.col("pt_id") * 104729) % (F.col("w").cast("long") * 4 + 1)) / 4.0).alias("pos"))
    q = read("nation").select(F.col("n_regionkey").cast("long").alias("qset"), F.col("n_nationkey").cast("long").alias("qi")).crossJoin(e)
    q = q.withColumn("eidx", (F.col("qi") * 6151 + 13) % F.col("e")).join(listed, "eidx")
    queries = q.select("qset", "qi", "ni", "nj", (((F.col("qi") * 15485863 + 7) % (F.col("w").cast("long") * 4 + 1)) / 4.0).alias("pos"), (1.0 + (F.col("qi") % 4) * 0.5).alias("weight"))
    nodes = place.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    # a few numbers a row, read by every search: made once, so that plans stay small
    return Network(nodes.checkpoint(), listed.select("ni", "nj", "w"), points.checkpoint()), queries.checkpoint()
