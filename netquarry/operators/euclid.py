"""Straight-line operators: nearest neighbours, aggregate nearest neighbours, rectangle and disc queries, packing into tiles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, euclid


def nearest(objects: DataFrame, x: float, y: float, k: int = 1, key: str = "id") -> DataFrame:
    """rank, and the k objects (key, x, y) nearest to a place, by dist, then key: a distributed top-k, no global sort."""
    top = objects.withColumn("dist", euclid(F.col("x"), F.col("y"), F.lit(float(x)), F.lit(float(y)))).orderBy("dist", key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("dist", key)))  # over the k rows alone


def nearest_each(places: DataFrame, objects: DataFrame, k: int = 1, cell: float | None = None, place_key: str = "pid", key: str = "id") -> DataFrame:
    """place_key, key, dist, rank: the k nearest objects of each place (place_key, x, y), exact, on a grid of joins.

    Each round joins the places that are still open with the objects in a ring of cells as an equi-join; a place is done once its k-th
    distance is within the ring's certain radius. A round's ring grows twofold, so there are logarithmically many rounds.
    """
    if cell is None:
        ext = objects.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
        if not ext.n:
            return places.select(place_key, F.lit(None).cast("long").alias(key), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
        cell = max(math.sqrt(max((ext.x1 - ext.x0) * (ext.y1 - ext.y0), 1e-9) * 4 * k / ext.n), 1e-9)
    total = objects.count()
    open_, found = places.select(place_key, F.col("x").alias("px"), F.col("y").alias("py")), None
    size = float(cell)
    while True:
        grid = objects.select(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"), F.col(key), "x", "y")
        ring = F.sequence(F.lit(-1), F.lit(1))
        around = open_.withColumn("dx", F.explode(ring)).withColumn("dy", F.explode(ring))
        around = around.withColumn("cx", F.floor(F.col("px") / size) + F.col("dx")).withColumn("cy", F.floor(F.col("py") / size) + F.col("dy"))
        near = around.join(grid, ["cx", "cy"]).withColumn("dist", euclid(F.col("px"), F.col("py"), F.col("x"), F.col("y")))
        order = Window.partitionBy(place_key).orderBy("dist", key)
        top = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(place_key, key, "dist", "rank").checkpoint()
        state = top.groupBy(place_key).agg(F.count("*").alias("n"), F.max("dist").alias("far"))
        done = state.filter((F.col("n") >= min(k, total)) & (F.col("far") <= size)).select(place_key)
        part = top.join(done, place_key, "left_semi")
        found = part if found is None else found.unionByName(part)
        open_ = open_.join(done, place_key, "left_anti").checkpoint()
        if open_.isEmpty() or total == 0:
            return found
        size *= 2


def aggregate_nearest(objects: DataFrame, group: DataFrame, k: int = 1, agg: str = "sum", weighted: bool = False, key: str = "id") -> DataFrame:
    """qset, rank, key, agg_dist: the k objects (key and a point x, y or a rectangle xmin..ymax) of least aggregate distance to each group (qset, x, y, weight).

    The groups are broadcast if few; the aggregate is partial before its shuffle, and the ranking keeps k rows per group and task.
    """
    box = Box.of() if "xmin" in objects.columns else Box(F.col("x"), F.col("x"), F.col("y"), F.col("y"))
    what = objects.select(key, *box.named())
    who = group.select("qset", F.col("x").alias("qx"), F.col("y").alias("qy"), (F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("weight"))
    few = who.limit(100_001).count() <= 100_000
    q = Box(F.col("qx"), F.col("qx"), F.col("qy"), F.col("qy"))
    pairs = (what.crossJoin(F.broadcast(who)) if few else what.crossJoin(who)).withColumn("d", Box.of().gap(q))
    fold = {"sum": F.sum, "max": F.max}[agg](F.col("weight") * F.col("d"))
    order = Window.partitionBy("qset").orderBy("agg_dist", key)
    return pairs.groupBy("qset", key).agg(fold.alias("agg_dist")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def window_query(boxes: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """The boxes (xmin, xmax, ymin, ymax, ...) that meet the window (xmin, xmax, ymin, ymax); plain comparisons, so they reach a Parquet scan."""
    return boxes.filter(Box.of().meets(Box(*window)))


def stab_query(boxes: DataFrame, x: float, y: float) -> DataFrame:
    """The boxes that hold a place."""
    return boxes.filter(Box.of().holds(F.lit(float(x)), F.lit(float(y))))


def disc_query(boxes: DataFrame, x: float, y: float, r: float) -> DataFrame:
    """The boxes that meet a disc."""
    return boxes.filter(Box.of().meets_disc(F.lit(float(x)), F.lit(float(y)), r))


def box_join(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (prefixes l_ and r_) that meet: an equi-join on grid cells, each pair reported in the one cell that holds the low corner of its overlap."""

    def gridded(df, p):
        named = df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
        span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
        return named.withColumn("cx", span(f"{p}xmin", f"{p}xmax")).withColumn("cy", span(f"{p}ymin", f"{p}ymax"))

    pairs = gridded(left, "l_").join(gridded(right, "r_"), ["cx", "cy"])
    here = (F.floor(F.greatest("l_xmin", "r_xmin") / cell) == F.col("cx")) & (F.floor(F.greatest("l_ymin", "r_ymin") / cell) == F.col("cy"))
    return pairs.filter(Box.of("l_").meets(Box.of("r_")) & here).drop("cx", "cy")


def bounding_box(places: DataFrame, *by: str) -> DataFrame:
    """xmin, xmax, ymin, ymax of places (x, y), for each group."""
    return places.groupBy(*by).agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def centroid(group: DataFrame, weighted: bool = False) -> DataFrame:
    """qset, x, y: the mean place of each group, weights multiplying coordinates before the count divides."""
    w = F.col("weight") if weighted else F.lit(1.0)
    return group.groupBy("qset").agg((F.sum(F.col("x") * w) / F.count("*")).alias("x"), (F.sum(F.col("y") * w) / F.count("*")).alias("y"))


def within(places: DataFrame, x: float, y: float, r: float) -> int:
    """How many places lie within a straight-line radius."""
    return places.filter(euclid(F.col("x"), F.col("y"), F.lit(float(x)), F.lit(float(y))) <= r).count()


def str_tiles(boxes: DataFrame, capacity: int, key: str = "id") -> DataFrame:
    """boxes with slice and tile: sort-tile-recursive packing, by x-centre into slices of about sqrt(pages) * capacity, then by y-centre into pages of ``capacity``.

    Exact slices need a global order; it is a range shuffle with one count a partition on the driver (see numbered).
    """
    from ..sources.network import numbered

    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    pages = math.ceil(boxes.count() / capacity) or 1
    per_slice = capacity * math.ceil(math.sqrt(pages))
    placed = numbered(boxes.withColumn("_cx", cx).withColumn("_cy", cy), "_i", "_cx", "_cy", key).withColumn("slice", F.expr(f"_i div {per_slice}"))
    order = Window.partitionBy("slice").orderBy("_cy", "_cx", key)
    return placed.withColumn("tile", F.floor((F.row_number().over(order) - 1) / capacity).cast("long")).drop("_cx", "_cy", "_i")


def _tile(i, count, n: int):
    """The number, from 0, of the one of n equal parts (the first ones take what is left over) that place i of count falls into."""
    size, rest = F.floor(count / n), count % n
    return F.when(i < rest * (size + 1), F.floor(i / (size + 1))).otherwise(rest + F.floor((i - rest * (size + 1)) / F.greatest(size, F.lit(1)))).cast("long")


def _first(tile, count, n: int):
    """The first place of a part (see _tile)."""
    return (tile * F.floor(count / n) + F.least(tile, count % n)).cast("long")


def str_seeds(nodes: DataFrame, n: int = 5) -> DataFrame:
    """seed_no, node_id: n x n seeds, by falling x into n equal parts, each by falling y into n, and of each the middle node. Both orders are range shuffles (see numbered)."""
    from ..sources.network import numbered

    total = F.lit(nodes.count())
    columns = numbered(nodes, "_i", F.desc("x"), F.desc("y"), F.col("node_id")).withColumn("cx", _tile(F.col("_i"), total, n))
    rows = numbered(columns, "_j", F.col("cx"), F.desc("y"), F.desc("x"), F.col("node_id"))
    held = _first(F.col("cx") + 1, total, n) - _first(F.col("cx"), total, n)
    rows = rows.withColumn("held", held).withColumn("k", F.col("_j") - _first(F.col("cx"), total, n)).withColumn("cy", _tile(F.col("k"), F.col("held"), n))
    first, next_ = _first(F.col("cy"), F.col("held"), n), _first(F.col("cy") + 1, F.col("held"), n)
    return rows.filter(F.col("k") == first + F.floor((next_ - first) / 2)).select((F.col("cx") * n + F.col("cy")).cast("long").alias("seed_no"), "node_id")


def vector_group_nearest(objects: DataFrame, group: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """key, total: the k objects (key, v) of least summed straight-line distance to the vectors (v) of a group, by total, then key.

    Every object meets every member: as products of matrices, some rows at a time, each task with the group's vectors (8 bytes a number). These sums
    differ from the plain ones by rounding alone, so what is within that of the k-th least is summed once more in the plain way.
    """
    odd = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x))
    shape = objects.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.max(odd.cast("int")).alias("odd")).first()
    few = objects
    if shape.low is not None and shape.low == shape.high and not shape.odd and shape.low > 0:  # others have no plain matrix
        members = np.array([np.asarray(v, float) for v in group.toPandas().v], float).reshape(-1, shape.low)
        middle = members.mean(0) if len(members) else np.zeros(shape.low)
        shared = objects.sparkSession.sparkContext.broadcast((members - middle, middle))

        def sums(batches):
            q, mid = shared.value
            qq, held, worst = (q * q).sum(1), [], np.inf
            for pdf in batches:
                for s in range(0, len(pdf), 1000):
                    part = pdf.iloc[s : s + 1000]
                    v = np.stack([np.asarray(x, float) for x in part.v]) - mid
                    vv, total = (v * v).sum(1), np.zeros(len(v))
                    for t in range(0, len(q), 2000):
                        total += np.sqrt(np.maximum(vv[:, None] + qq[t : t + 2000] - 2 * v @ q[t : t + 2000].T, 0)).sum(1)
                    err = 1e-7 * len(q) * np.sqrt(vv + qq.max(initial=0.0))  # roots of rounding near 0, and far less elsewhere
                    new = part.assign(low=total - err, high=total + err)
                    held = [pd.concat([*held, new[new.low <= worst]])]
                    if len(held[0]) > k:
                        worst = np.partition(held[0].high.to_numpy(), k - 1)[k - 1]
                        held = [held[0][held[0].low <= worst]]
            yield from held

        kept = objects.mapInPandas(sums, f"{key} long, v array<double>, low double, high double").checkpoint()
        worst = kept.orderBy("high").limit(k).agg(F.max("high")).first()[0]
        # of equal vectors only the first k can count
        few = kept.filter(F.col("low") <= F.lit(worst)).withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy(key))).filter(F.col("_r") <= k).select(key, "v")
    group = group.select(F.col("v").alias("q"))
    group = F.broadcast(group) if group.limit(10_001).count() <= 10_000 else group
    gap = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return few.crossJoin(group).groupBy(key).agg(F.sum(gap).alias("total")).orderBy("total", key).limit(k)
