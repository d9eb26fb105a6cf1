"""Connected components over tables of edges, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, hot_keys, join_split, scratch


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for each end of the edges (a, b: of one orderable type).

    Each star maps a node's neighbours to the least of them, an aggregate that is combined before the shuffle; edges at hubs, whose
    neighbours may be most of all nodes, meet that least node where they are. The edges stay linear in number, and each round is a
    table in the shared folder, so neither lineage nor any group is held in memory. There is no round once the edges are stars
    around their roots, which one aggregate tells: a round is five jobs, and the driver keeps something of each.
    """
    spark = edges.sparkSession
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    paths, schema = [], edges.select("a", "b").schema

    def keep(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark, "stars"))
        df.write.option("compression", "zstd").parquet(paths[-1])
        if len(paths) > 2:
            drop_scratch(spark, paths[-3])
        return spark.read.schema(schema).parquet(paths[-1])

    def least(df: DataFrame, end: str) -> DataFrame:
        """df (a, b) with m: the least b that any row has whose a is this row's ``end``; null without."""
        counts = df.groupBy(F.col(end).alias("k")).agg(F.count("*").alias("n"))
        low = df.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        return join_split(df.withColumn("k", F.col(end)), low, ["k"], hot_keys(counts, ["k"], "n", n_rows), "left").drop("k")

    def state(df: DataFrame):
        """n: the number of edges. most: 1 if each node has one edge to a root or is a root, over 1 otherwise; null without edges."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        nodes = df.select(ends.alias("e")).groupBy("e.k").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        return nodes.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.max(F.col("up") + F.col("down")).alias("most")).first()

    current = keep(current)
    n_rows, most = state(current)
    while most is not None and most > 1:
        if not rounds:
            raise RuntimeError("components did not settle in the given rounds")
        rounds -= 1
        # large star: a node's larger neighbours go to the least of its neighbourhood
        large = keep(least(current, "b").select("a", F.coalesce("m", "b").alias("b")).distinct())
        # small star: its smaller neighbours and the node itself go to the least
        small = least(large, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        current = keep(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        n_rows, most = state(current)
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
