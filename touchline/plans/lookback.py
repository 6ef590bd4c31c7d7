"""First page seen by a converting user within a lookback window.

For each conversion event at time c, the earliest page view of the same user
with c - days <= page time <= c (both ends inclusive, exact 24-hour days);
conversions without one vanish. Then one row per transaction id: the
conversion whose first page is earliest (all conversions with the same id,
NULL included, form one pool).

Instead of joining every conversion with every page view of the user and
ranking the pairs, each conversion asks for the first page view at or after
c - days (a forward as-of lookup, `asof_forward`) and keeps it if it is not
after c. Work is linear in events and a heavy user is split by time bucket.
The per-id pick is an aggregate (`min_by`), so a huge NULL-id pool is merged
from partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.functions.params import page_location
from touchline.functions.timefn import micros_to_timestamp, shift_date_key
from touchline.operators.asof import asof_forward
from touchline.schema import MICROS_PER_DAY
from touchline.sources.export import shard_between

USER = "user_pseudo_id"
HOUR_US = 3_600 * 1_000_000

LOOKBACK_COLUMNS = (
    "user_pseudo_id",
    "purchase_revenue",
    "purchase_time",
    "first_page_time",
    "first_page_location",
)


def converters(events: DataFrame, conversion_event: str = "purchase") -> DataFrame:
    return events.filter(F.col("event_name") == F.lit(conversion_event)).select(
        USER,
        F.col("event_timestamp").alias("conversion_us"),
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
        F.col("ecommerce.transaction_id").alias("transaction_id"),
    )


def page_views(events: DataFrame) -> DataFrame:
    """One row per (user, page time): exports batch events under one timestamp,
    and of views at one time the smallest location stands for all."""
    views = events.filter(F.col("event_name") == "page_view").select(
        USER, F.col("event_timestamp").alias("page_us"), page_location().alias("location")
    )
    return views.groupBy(USER, "page_us").agg(F.min("location").alias("location")).select(
        USER, "page_us", F.struct("page_us", "location").alias("page")
    )


def first_page_in_window(
    conv: DataFrame,
    pages: DataFrame,
    days: int,
    bucket_width: int = HOUR_US,
) -> DataFrame:
    """Per transaction id, the conversion with the earliest page view in
    [conversion - days, conversion]. Output: LOOKBACK_COLUMNS (timestamps as
    TIMESTAMP)."""
    probes = conv.withColumn("__from_us", F.col("conversion_us") - F.lit(days * MICROS_PER_DAY))
    found = asof_forward(
        probes,
        pages,
        by=[USER],
        key="__from_us",
        build_key="page_us",
        values=["page"],
        bucket_width=bucket_width,
        count_col="__pages_after",
    ).filter(F.col("page.page_us").between(F.col("__from_us"), F.col("conversion_us")))
    order = F.struct(
        F.col("page.page_us"),
        F.col("conversion_us"),
        F.col(USER),
        F.col("page.location"),
        F.col("purchase_revenue"),
    )
    picked = found.groupBy("transaction_id").agg(
        F.min_by(
            F.struct(USER, "purchase_revenue", "conversion_us", "page"),
            order,
        ).alias("p")
    )
    return picked.select(
        F.col(f"p.{USER}").alias(USER),
        F.col("p.purchase_revenue").alias("purchase_revenue"),
        micros_to_timestamp(F.col("p.conversion_us")).alias("purchase_time"),
        micros_to_timestamp(F.col("p.page.page_us")).alias("first_page_time"),
        F.col("p.page.location").alias("first_page_location"),
    )


def lookback_window(
    events: DataFrame,
    days: int = 7,
    conversion_event: str = "purchase",
    conversion_dates: tuple[str | None, str | None] | None = None,
    page_dates: tuple[str | None, str | None] | None = None,
    bucket_width: int = HOUR_US,
) -> DataFrame:
    """Conversions of `conversion_dates` (inclusive yyyyMMdd suffix range; None
    = all). Page views of `page_dates`; None = the conversions' range, widened
    by the lookback days and one more day on both sides (shard dates follow the
    export's zone, times are UTC), so that only shards that can hold a view of
    the window are read."""
    start, end = conversion_dates or (None, None)
    if page_dates is None:
        page_dates = (shift_date_key(start, -days - 1), shift_date_key(end, 1))
    return first_page_in_window(
        converters(shard_between(events, start, end), conversion_event),
        page_views(shard_between(events, *page_dates)),
        days,
        bucket_width,
    )
