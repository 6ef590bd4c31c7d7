"""Interval aggregate: for each probe, what the points of its group hold in
(at - span, at], told per value of `kind`: their number, the first, the last,
and the sum of weights that halve every `half_life_minutes` whole minutes before
the probe. No probe meets the single points of its interval.

Time is cut into buckets of span / 2**levels. Points are summed up in blocks of
1, 2, 4, ... buckets (one row per group, block and kind); an interval is at most
two blocks of each size, and the single points of the two buckets at its ends.
So p probes and q points of one group cost about (2 p + q) * levels rows, where
pairs would be p * q, and no task holds a group: rows are dealt out by block.

Weights. With a probe at minute m and rest r, and a point at minute i and rest s,
the whole minutes between are m - i, less one if s > r. A block's weight is
therefore 0.5**((m - end) / H) times the sum of 0.5**((end - i) / H) over its
points, plus (2**(1 / H) - 1) times that sum over the points with s > r. That
second sum is a running sum by falling rest. It runs in two steps, inside parts of
the minute (RESTS) and over the sums of the parts, so that a large block is
spread over RESTS tasks.

Rows of the result are parts: n and weight add up over the rows of a probe and
kind, first and last are the least and the greatest. A NULL group matches
nothing; a NULL kind is a kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions.timefn import whole_minutes_between
from touchline.operators.asof import bucket_of
from touchline.schema import MICROS_PER_MINUTE

LEVELS = 12
RESTS = 60
EDGE = -1  # the level of single points
_KEYS = ("__level", "__block")


def covering_blocks(rows: DataFrame, low: Column, high: Column, levels: int) -> DataFrame:
    """The rows, each with (__level, __block) of the blocks that make up the
    buckets between `low` and `high`, where block b of a level is the buckets from
    b * 2**level on; and on level EDGE the buckets `low` and `high` themselves."""
    found = rows.select(
        "*", low.alias("__low"), high.alias("__high"), F.explode(F.sequence(F.lit(EDGE), F.lit(levels))).alias("__level")
    )
    found = found.select(
        "*", F.expr("-shiftright(-(__low + 1), __level)").alias("__start"), F.expr("shiftright(__high, __level)").alias("__end")
    )
    # an odd block at either side is no part of a larger one inside
    odd = "array(if(pmod(__start, 2) = 1, __start, NULL), if(pmod(__end, 2) = 1, __end - 1, NULL))"
    edges = f"if(__level = {EDGE}, array_distinct(array(__low, __high)), {odd})"
    found = found.where(f"__level = {EDGE} OR __start < __end").withColumn("__block", F.explode(F.expr(edges)))
    return found.where("__block IS NOT NULL").drop("__low", "__high", "__start", "__end")


def _minute(at: Column) -> Column:
    return bucket_of(at, MICROS_PER_MINUTE)


def _rest(at: Column) -> Column:
    return F.pmod(at, F.lit(MICROS_PER_MINUTE))


def interval_parts(
    probes: DataFrame,
    points: DataFrame,
    by: str,
    at: str,
    point_at: str,
    span: int,
    kind: str,
    order: Sequence[str],
    half_life_minutes: float,
    levels: int = LEVELS,
) -> DataFrame:
    """The columns of `probes` and kind, n, weight, first, last; first and last
    are structs of (point_at, *order). Times are whole microseconds."""
    width = max(1, -(-span // (1 << levels)))
    probes = probes.where(F.col(by).isNotNull())
    points = points.where(F.col(by).isNotNull()).select(
        F.col(by), F.col(kind).alias("__kind"), F.col(point_at).alias("__at"),
        F.struct(F.col(point_at), *[F.col(c) for c in order]).alias("__point"), bucket_of(F.col(point_at), width).alias("__bucket"),
    )
    low, high = bucket_of(F.col(at) - F.lit(span), width), bucket_of(F.col(at), width)
    edge = F.col("__level") == EDGE
    leveled = points.withColumn("__level", F.explode(F.sequence(F.lit(EDGE), F.lit(levels))))
    block = F.expr(f"if(__level = {EDGE}, __bucket, shiftright(__bucket, __level))")
    leveled = leveled.withColumn("__block", block).drop("__bucket")
    end = _minute((F.col("__block") + 1) * F.expr(f"shiftleft({width}L, __level)"))
    ago = F.pow(F.lit(0.5), (end - _minute(F.col("__at"))) / F.lit(half_life_minutes))
    leveled = leveled.withColumn("__w", F.when(edge, F.lit(0.0)).otherwise(ago))
    # the single points of an edge bucket stay single
    blocks = leveled.groupBy(by, "__kind", *_KEYS, F.when(edge, F.col("__point")).alias("__single")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__w").alias("__sum"), F.min("__point").alias("first"), F.max("__point").alias("last")
    ).drop("__single")
    asked = covering_blocks(probes, low, high, levels).join(blocks, [by, *_KEYS])
    met = F.col(f"first.{point_at}")
    asked = asked.where(~edge | ((met <= F.col(at)) & (met > F.col(at) - F.lit(span))))

    # points of the same block and kind that are later in their minute
    part = MICROS_PER_MINUTE // RESTS
    cut = [by, "__kind", *_KEYS, "__part"]
    rest = _rest(F.col(at))
    asked = asked.withColumn("__rest", rest).withColumn("__w", F.lit(None).cast("double"))
    held = leveled.where(~edge).select(by, "__kind", *_KEYS, _rest(F.col("__at")).alias("__rest"), "__w")
    stacked = asked.unionByName(held, allowMissingColumns=True).withColumn("__part", bucket_of(F.col("__rest"), part))
    stacked = stacked.repartition(*cut)
    later = Window.partitionBy(*cut).orderBy(-F.col("__rest")).rangeBetween(Window.unboundedPreceding, -1)
    inside = stacked.withColumn("__in", F.sum("__w").over(later)).where(F.col("__w").isNull()).drop("__w")
    parts = stacked.groupBy(*cut).agg(F.sum("__w").alias("__w"), F.count_if(F.col("__w").isNull()).alias("__asked"))
    above = Window.partitionBy(*cut[:-1]).orderBy(-F.col("__part")).rangeBetween(Window.unboundedPreceding, -1)
    carry = parts.withColumn("__carry", F.sum("__w").over(above)).where(F.col("__asked") > 0)
    carry = carry.select(F.col(by).alias("__by"), F.col("__kind").alias("__k"), *[F.col(c).alias(c + "c") for c in cut[2:]], "__carry")
    same = (F.col(by) == F.col("__by")) & F.col("__kind").eqNullSafe(F.col("__k"))
    for c in cut[2:]:
        same = same & (F.col(c) == F.col(c + "c"))
    told = inside.join(carry, same, "left")
    extra = F.coalesce(F.col("__in"), F.lit(0.0)) + F.coalesce(F.col("__carry"), F.lit(0.0))
    ago = F.pow(F.lit(0.5), (_minute(F.col(at)) - end) / F.lit(half_life_minutes))
    weight = ago * (F.col("__sum") + F.lit(2.0 ** (1 / half_life_minutes) - 1) * extra)
    single = F.pow(F.lit(0.5), whole_minutes_between(F.col(at), met) / F.lit(half_life_minutes)) * F.col("n")
    weight = F.when(edge, single).otherwise(weight)
    return told.select(*probes.columns, F.col("__kind").alias(kind), "n", weight.alias("weight"), "first", "last")
