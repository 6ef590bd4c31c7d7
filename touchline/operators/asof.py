"""Skew-safe as-of fill: for each probe row, the latest build row of the same
group whose key is <= the probe's key, looked up independently for each value
column among rows where that column is not NULL, plus how many build rows lie
at or before the probe.

This is what the warehouse SQL writes as "join every earlier row of the user,
collect them into an array, take the top one" (a per-user quadratic
expansion). The usual Spark rewrite, one window partitioned by the group key,
is linear but sends a whole group to one task, so a single hot group (a bot
user holding a third of all rows) becomes one straggler. Here the key axis is
cut into fixed-width buckets and the scan runs in two levels:

  level 1  inside each (group, bucket): window over the bucket's build and
           probe rows, ordered by key, RANGE frame up to the current key
           (peers included, so a build row at the probe's own key counts).
  level 2  per (group, bucket) one summary: last non-NULL values and number of
           its build rows, and whether it holds probes.
  level 3  carry-in for each bucket that holds probes: the summaries of all
           earlier buckets of the group, via a window over one row per
           (group, bucket). Rows per window partition <= buckets per group,
           which is bounded by the time span over the bucket width, not by the
           data volume.

Result = level-1 value if any, else the carry. Both inputs are read once: the
stacked rows are hash-partitioned on (group, bucket) in one exchange, which
level 1 and level 2 both read. For that, neither filters the stacked rows and
both use all their columns; otherwise the optimizer would prune and filter each
use below the exchange, and the inputs would be scanned and shuffled twice. The
carry join is planned by AQE from runtime sizes (broadcast when small). A caller
that never uses some probe column should not pass it: pruned from level 1 alone,
it would undo the sharing.

A NULL group key matches nothing (SQL equality), so rows that have one are
left out on both sides: they are neither probes nor matches, and all
unidentified rows never meet as one hot group.

Precondition: at most one build row per (group, key). Callers aggregate to
that grain first, which also shrinks what is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_B = "__asof_bucket"
IS_BUILD = "__asof_is_build"
_CNT = "__asof_cnt"


def bucket_of(key: Column, width: int) -> Column:
    """floor(key / width) in exact integer arithmetic (monotone in key)."""
    rem = F.pmod(key, F.lit(width))
    return ((key - rem) / F.lit(width)).cast("long")


def asof_backward(
    probes: DataFrame,
    build: DataFrame,
    by: Sequence[str],
    key: str,
    values: Sequence[str],
    bucket_width: int,
    out: dict[str, str] | None = None,
    count_col: str = "asof_matches",
    build_key: str | None = None,
) -> DataFrame:
    """Append to every probe row (but those with a NULL group key) the as-of
    values and a match count.

    probes:      rows with columns `by` + [key] (+ any payload); NULL keys get
                 no match.
    build:       rows with `by` + [build_key or key] + `values`.
    out:         output name per value column (default: the value's name).
    count_col:   number of build rows with key <= probe key.
    """
    by = list(by)
    for c in by:
        probes, build = probes.filter(F.col(c).isNotNull()), build.filter(F.col(c).isNotNull())
    build_rows = build.select(
        *by,
        F.col(build_key or key).alias(key),
        *[F.col(v).alias(value_column(v)) for v in values],
    )
    stacked = probes.withColumn(IS_BUILD, F.lit(0)).unionByName(
        build_rows.withColumn(IS_BUILD, F.lit(1)), allowMissingColumns=True
    )
    return asof_stacked(stacked, by, key, values, bucket_width, out, count_col)


def value_column(value: str) -> str:
    """The column that holds a build row's value in stacked rows."""
    return f"__v_{value}"


def asof_stacked(
    stacked: DataFrame,
    by: Sequence[str],
    key: str,
    values: Sequence[str],
    bucket_width: int,
    out: dict[str, str] | None = None,
    count_col: str = "asof_matches",
    bucket_col: str | None = None,
) -> DataFrame:
    """`asof_backward` of rows that are stacked already: probes (IS_BUILD = 0)
    with `by`, key and any payload, build rows (IS_BUILD = 1) with `by`, key and a
    `value_column` for each value. Callers that take both from one aggregate read
    their input once. `bucket_col` keeps the bucket: the result is partitioned by
    (`by`, bucket), so that an aggregate of these keys needs no shuffle."""
    by = list(by)
    values = list(values)
    out = {v: (out or {}).get(v, v) for v in values}
    held = {*by, IS_BUILD, *map(value_column, values)}
    payload = [c for c in stacked.columns if c not in held]
    stacked = stacked.withColumn(_B, bucket_of(F.col(key), bucket_width)).repartition(*by, _B)

    # level 1: inside a bucket
    w1 = (
        Window.partitionBy(*by, _B)
        .orderBy(F.col(key))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inner = stacked.select(
        *by,
        _B,
        *payload,
        IS_BUILD,
        *[F.last(f"__v_{v}", ignorenulls=True).over(w1).alias(f"__in_{v}") for v in values],
        F.sum(IS_BUILD).over(w1).alias("__in_cnt"),
    ).filter(F.col(IS_BUILD) == 0)

    # level 2: one summary row per (group, bucket). The mark of a bucket with
    # probes is a hash of their payload, so that this use needs the same
    # columns as level 1 and the exchange is shared
    is_build = F.col(IS_BUILD) == 1
    mark = F.max(F.when(~is_build, F.xxhash64(*payload))).alias("__probes")
    summary = stacked.groupBy(*by, _B).agg(
        *[
            F.max_by(
                F.col(f"__v_{v}"), F.when(is_build & F.col(f"__v_{v}").isNotNull(), F.col(key))
            ).alias(f"__v_{v}")
            for v in values
        ],
        F.sum(IS_BUILD).alias(_CNT),
        mark,
    )

    # level 3: carry from all earlier buckets, for each bucket holding probes
    w3 = (
        Window.partitionBy(*by)
        .orderBy(F.col(_B))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    carry = summary.select(
        *by,
        _B,
        "__probes",
        *[F.last(f"__v_{v}", ignorenulls=True).over(w3).alias(f"__c_{v}") for v in values],
        F.sum(_CNT).over(w3).alias("__c_cnt"),
    ).filter(F.col("__probes").isNotNull() & F.col(_B).isNotNull()).drop("__probes")

    joined = inner.join(carry, on=[*by, _B], how="left")
    return joined.select(
        *by,
        *payload,
        *[F.coalesce(F.col(f"__in_{v}"), F.col(f"__c_{v}")).alias(out[v]) for v in values],
        (F.col("__in_cnt") + F.coalesce(F.col("__c_cnt"), F.lit(0))).alias(count_col),
        *([F.col(_B).alias(bucket_col)] if bucket_col else []),
    )


def asof_forward(
    probes: DataFrame,
    build: DataFrame,
    by: Sequence[str],
    key: str,
    values: Sequence[str],
    bucket_width: int,
    out: dict[str, str] | None = None,
    count_col: str = "asof_matches",
    build_key: str | None = None,
) -> DataFrame:
    """Mirror of `asof_backward`: the earliest build row with key >= probe key
    (count = build rows at or after the probe). Runs the backward scan on the
    negated key."""
    bkey = build_key or key
    neg = "__asof_neg_key"
    p = probes.withColumn(neg, -F.col(key))
    b = build.withColumn(neg, -F.col(bkey))
    if bkey in b.columns and bkey not in values and bkey not in by:
        b = b.drop(bkey)
    res = asof_backward(p, b, by, neg, values, bucket_width, out, count_col)
    return res.drop(neg)
