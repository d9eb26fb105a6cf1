"""Other scalar expressions: estimates, sets as bits, text, seeded variates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def polynomial(radius: Column, coefficients: Column, unit: float = 1000.0) -> Column:
    """The polynomial in radius / unit (constant term first), never below 0; Horner's scheme over the array."""
    x = radius / unit
    return F.greatest(F.lit(0.0), F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c))


def power_law(radius: Column, a: Column, b: Column) -> Column:
    """exp(a + b log r), cut to a whole number; 0 at radius 0."""
    return F.when(radius <= 0, F.lit(0)).otherwise(F.exp(a + b * F.log(radius)).cast("long"))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def cardinality(bits: Column) -> Column:
    """Number of set bits."""
    return F.bit_count(bits)


def members(bits: Column, width: int = 32) -> Column:
    """Positions of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(bits, i) == 1)


def coded(df: DataFrame, column: str, into: str = "code") -> DataFrame:
    """Dictionary codes 0, 1, ... in the order of the distinct values, nulls first; the order is a range shuffle of one row for each value."""
    from ..sources.network import numbered

    codes = numbered(df.select(F.col(column).alias("_value")).distinct(), into, "_value")
    return df.join(codes, df[column].eqNullSafe(codes["_value"])).drop("_value")


def gaussian(mean: float, deviation: float, seed: int) -> Column:
    return F.randn(seed) * deviation + mean


def zipf(theta: float, size: int, seed: int) -> Column:
    """A rank from 1 to size with probability proportional to rank ** -theta, by the inverse of its distribution."""
    weights = [r**-theta for r in range(1, size + 1)]
    total, run, steps = sum(weights), 0.0, []
    for w in weights:
        run += w / total
        steps.append(run)
    steps[-1] = 1.0
    drawn = F.array(*[F.lit(s) for s in steps])
    u = F.rand(seed)
    # one draw per row, then the first step that reaches it
    return F.aggregate(F.array(u), F.lit(0), lambda acc, x: acc + F.size(F.filter(drawn, lambda s: s < x)) + 1)


def poisson(mean: float, seed: int) -> Column:
    """Poisson counts: how many exponential waits of a unit rate fit into ``mean``; uniforms come from hashes of one draw."""
    import math

    most = int(mean + 12 * math.sqrt(mean) + 20)

    def count(u: Column) -> Column:
        def wait(i):
            h = F.pmod(F.xxhash64(u, i), F.lit(1 << 52)).cast("double")
            return -F.log((h + 0.5) / float(1 << 52))

        step = F.aggregate(
            F.sequence(F.lit(1), F.lit(most)), F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("n")),
            lambda acc, i: F.struct((acc["t"] + wait(i)).alias("t"), (acc["n"] + F.when(acc["t"] + wait(i) <= mean, 1).otherwise(0)).alias("n")), lambda acc: acc["n"],
        )
        return step

    return F.aggregate(F.array(F.rand(seed)), F.lit(0), lambda acc, u: acc + count(u))


def skew_weights(df: DataFrame, theta: float, agg: str = "sum", order: str = "qi", group: str = "qset", seed: int | None = None) -> DataFrame:
    """Query weights s ** -theta over s = 1, 2, ...: mean 1 for sums, greatest 1 for maxima; shuffled by a seeded hash if a seed is given."""
    by = F.xxhash64(F.lit(seed), group, order) if seed is not None else F.col(order)
    ranked = df.withColumn("_s", F.row_number().over(Window.partitionBy(group).orderBy(by, order)))
    raw, whole = F.pow(F.col("_s"), F.lit(-float(theta))), Window.partitionBy(group)
    norm = F.avg(raw).over(whole) if agg == "sum" else F.max(raw).over(whole)
    return ranked.withColumn("weight", raw / norm).drop("_s")
