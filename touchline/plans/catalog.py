"""Registered queries: one callable (spark, sf_dir) -> DataFrame per job.

Each reads the `events` test table of `sf_dir` through the export adapter, and
all of it, except for the rows whose feature is a date window (`shard_*` and
`*_window_*`, `lookback_one_day`). Outputs are made engine-neutral for
comparison with the DuckDB oracle: TIMESTAMP columns become epoch microseconds
(`*_us`) and doubles are rounded to 4 places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from touchline.functions.channels import SiteLists, default_channel_grouping, site_rows, site_table
from touchline.functions.params import page_location, session_id
from touchline.functions.timefn import shift_date_key
from touchline.plans import attribution as A
from touchline.plans import sessions as S
from touchline.plans.channels import NO_CAMPAIGN, NO_MEDIUM, NO_SOURCE, channel_report
from touchline.plans.lookback import lookback_window
from touchline.plans.sql_functions import DEFAULT_EVENTS_VIEW, register_sql_functions
from touchline.session import shared_dir
from touchline.sources.export import read_export, shard_between, shard_day, shard_prefix, write_export
from touchline.sources.fixture import read_test_events

ALL = (None, None)  # no bound: every event, also one without a date
# Windows inside the month that the test table spans.
EXACT_DAY = "20240118"
PREFIX = "2024011"
WINDOW = ("20240120", "20240126")
WINDOW_HISTORY_DAYS = 10
HISTORY_DAYS = 90
TOUCH_WINDOW_DAYS = 14  # shorter than the data, so that it excludes touches
LONG_TOUCH_WINDOW_DAYS = 30
LOOKBACK_STATIC_DAYS = 7
LOOKBACK_TVF_DAYS = 14
# The social sites among the sources of the test table.
SITES = SiteLists(social=("facebook.com",))
DECIMALS = 4
# Sums of shares can lie exactly between two rounded values, where the last bits
# of a sum (the order of its rows) would decide; both engines round beside it.
OFF_TIE = 1e-7

Query = Callable[[SparkSession, str], DataFrame]


def neutral(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.unix_micros(F.col(f.name).cast("timestamp")).alias(f"{f.name}_us"))
        elif isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f.name) + OFF_TIE, DECIMALS).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_test_events(spark, sf_dir)


def _all(spark, sf_dir) -> DataFrame:
    return shard_between(_ev(spark, sf_dir), *ALL)


def _pairs(spark, sf_dir, era="post", days=TOUCH_WINDOW_DAYS) -> DataFrame:
    return A.attribution_pairs(_ev(spark, sf_dir), ALL, ALL, ALL, era, days)


def _parts(spark, sf_dir, era="post", days=TOUCH_WINDOW_DAYS) -> DataFrame:
    return A.attribution_parts(_ev(spark, sf_dir), ALL, ALL, ALL, era, days)


def q_event_params(spark, sf_dir):
    return _ev(spark, sf_dir).select(
        "user_pseudo_id", "event_timestamp", "event_name",
        session_id().alias("ga_session_id"), page_location().alias("page_location"),
    )


def q_event_params_strict(spark, sf_dir):
    """The same, where a repeated key would raise."""
    return _ev(spark, sf_dir).select(
        "user_pseudo_id", "event_timestamp", "event_name",
        session_id(strict=True).alias("ga_session_id"), page_location(strict=True).alias("page_location"),
    )


def _export(spark, sf_dir) -> DataFrame:
    """The events as a dataset partitioned by date, written and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/touchline-export-{uuid.uuid4().hex}"
    write_export(_ev(spark, sf_dir), path)
    return read_export(spark, path)


def q_export_day(spark, sf_dir):
    day = shard_day(_export(spark, sf_dir), EXACT_DAY)
    return day.groupBy("event_name").agg(F.count(F.lit(1)).alias("events"))


def q_export_prefix(spark, sf_dir):
    days = shard_prefix(_export(spark, sf_dir), PREFIX)
    return days.groupBy("event_date", "event_name").agg(F.count(F.lit(1)).alias("events"))


def q_export_sessions_window(spark, sf_dir):
    """The windowed report from partitions: history and window name their shards."""
    return S.traffic_report(_export(spark, sf_dir), *WINDOW, "post", WINDOW_HISTORY_DAYS)


def q_shard_range_counts(spark, sf_dir):
    return _all(spark, sf_dir).groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


def q_shard_exact(spark, sf_dir):
    day = shard_day(_ev(spark, sf_dir), EXACT_DAY)
    return day.groupBy("event_name").agg(F.count(F.lit(1)).alias("events"))


def q_shard_prefix(spark, sf_dir):
    days = shard_prefix(_ev(spark, sf_dir), PREFIX)
    return days.groupBy("event_date", "event_name").agg(F.count(F.lit(1)).alias("events"))


def q_shard_window(spark, sf_dir):
    """The computed range of a history: start - N days to the end."""
    ev = shard_between(_ev(spark, sf_dir), shift_date_key(WINDOW[0], -WINDOW_HISTORY_DAYS), WINDOW[1])
    return ev.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


def q_session_source(era):
    return lambda spark, sf_dir: S.current_sessions(_all(spark, sf_dir), era)


def q_history_last_nonnull(spark, sf_dir):
    return S.session_history_last_nonnull(_ev(spark, sf_dir), exclude_system=False)


def q_history_first(spark, sf_dir):
    return S.session_history_first(_all(spark, sf_dir))


def q_last_non_direct(era):
    return lambda spark, sf_dir: S.filled_sessions(_ev(spark, sf_dir), *ALL, era, HISTORY_DAYS)


def q_sessions_by_medium(era):
    return lambda spark, sf_dir: S.traffic_report(_ev(spark, sf_dir), *ALL, era, HISTORY_DAYS)


def q_sessions_window(era):
    return lambda spark, sf_dir: S.traffic_report(_ev(spark, sf_dir), *WINDOW, era, WINDOW_HISTORY_DAYS)


def q_conversions(spark, sf_dir):
    return neutral(A.conversions(_all(spark, sf_dir)))


def q_interactions(era):
    def run(spark, sf_dir):
        ev = _all(spark, sf_dir)
        rows = A.interactions(A.attribution_sessions(ev, era), S.session_history_first(ev))
        return rows.drop("raw_medium")
    return run


def q_touchpoints(days):
    def run(spark, sf_dir):
        tp = A.with_shares(A.with_pools(_pairs(spark, sf_dir, days=days)))
        return neutral(tp.drop("raw_medium", "decay_weight", "decay_total"))
    return run


def q_model(fn):
    return lambda spark, sf_dir: neutral(fn(_parts(spark, sf_dir)))


def q_compare(era):
    return lambda spark, sf_dir: neutral(A.compare_models(_parts(spark, sf_dir, era)))


def q_compare_window(spark, sf_dir):
    """Conversions of a week, sessions of the two weeks up to its end, the
    history of all before."""
    ev = _ev(spark, sf_dir)
    sessions = (shift_date_key(WINDOW[0], -TOUCH_WINDOW_DAYS), WINDOW[1])
    return neutral(A.attribution_report(ev, WINDOW, sessions, (None, WINDOW[1]), "post", TOUCH_WINDOW_DAYS))


def q_lookback_static(spark, sf_dir):
    return neutral(lookback_window(_ev(spark, sf_dir), LOOKBACK_STATIC_DAYS, "purchase", ALL, ALL))


def q_lookback_one_day(spark, sf_dir):
    day = (EXACT_DAY, EXACT_DAY)
    return neutral(lookback_window(_ev(spark, sf_dir), LOOKBACK_STATIC_DAYS, "purchase", day))


def q_lookback_tvf_one_day(spark, sf_dir):
    register_sql_functions(spark, SITES, _ev(spark, sf_dir))
    return neutral(spark.sql(
        f"SELECT * FROM lookback_window({LOOKBACK_STATIC_DAYS}, 'purchase', '{EXACT_DAY}', '{EXACT_DAY}')"
    ))


def q_lookback_tvf(spark, sf_dir):
    register_sql_functions(spark, SITES, _ev(spark, sf_dir))
    return neutral(spark.sql(f"SELECT * FROM lookback_window({LOOKBACK_TVF_DAYS}, 'purchase')"))


def q_channel_report(spark, sf_dir):
    return channel_report(_ev(spark, sf_dir), *ALL, SITES, "post", HISTORY_DAYS)


def q_channel_report_site_table(spark, sf_dir):
    """The same with the sites as a table."""
    return channel_report(_ev(spark, sf_dir), *ALL, site_table(site_rows(spark, SITES)), "post", HISTORY_DAYS)


def q_channel_push_and_added(spark, sf_dir):
    """Media that end in push, and sites that some users add to the lists."""
    source, medium = F.col("collected_traffic_source.manual_source"), F.col("collected_traffic_source.manual_medium")
    pushed = F.when(medium == "email", F.lit("Web-Push")).when(medium == "referral", F.lit("mobile_push")).otherwise(medium)
    user = F.col("user_pseudo_id")
    added = lambda end, site: F.when(user.endswith(end), F.array(F.lit("other.example"), F.lit(site)))
    channel = default_channel_grouping(
        F.coalesce(pushed, F.lit(NO_MEDIUM)), F.coalesce(source, F.lit(NO_SOURCE)),
        F.coalesce("collected_traffic_source.manual_campaign_name", F.lit(NO_CAMPAIGN)), SITES,
        added("7", "newsletter"), added("3", "partner.example"), added("2", "newsletter"), added("1", "partner.example"),
    )
    return _ev(spark, sf_dir).groupBy(channel.alias("channel")).agg(F.count(F.lit(1)).alias("events"))


def q_channel_sql(spark, sf_dir):
    register_sql_functions(spark, SITES, _ev(spark, sf_dir))
    return spark.sql(
        f"""
        SELECT default_channel_grouping(
                 coalesce(collected_traffic_source.manual_medium, '{NO_MEDIUM}'),
                 coalesce(collected_traffic_source.manual_source, '{NO_SOURCE}'),
                 coalesce(collected_traffic_source.manual_campaign_name, '{NO_CAMPAIGN}'),
                 NULL, NULL, NULL, NULL) AS channel,
               count(*) AS events
        FROM {DEFAULT_EVENTS_VIEW}
        WHERE event_name = 'session_start'
        GROUP BY 1
        """
    )


QUERIES: dict[str, Query] = {
    "event_params": q_event_params,
    "event_params_strict": q_event_params_strict,
    "shard_range_counts": q_shard_range_counts,
    "export_day": q_export_day,
    "export_prefix": q_export_prefix,
    "export_sessions_window": q_export_sessions_window,
    "shard_exact": q_shard_exact,
    "shard_prefix": q_shard_prefix,
    "shard_window": q_shard_window,
    "session_source_post": q_session_source("post"),
    "session_source_pre": q_session_source("pre"),
    "session_history_last_nonnull": q_history_last_nonnull,
    "session_history_first": q_history_first,
    "last_non_direct_post": q_last_non_direct("post"),
    "last_non_direct_pre": q_last_non_direct("pre"),
    "sessions_by_medium_post": q_sessions_by_medium("post"),
    "sessions_by_medium_pre": q_sessions_by_medium("pre"),
    "sessions_by_medium_window_post": q_sessions_window("post"),
    "sessions_by_medium_window_pre": q_sessions_window("pre"),
    "conversions": q_conversions,
    "interactions_post": q_interactions("post"),
    "interactions_pre": q_interactions("pre"),
    "touchpoints_post": q_touchpoints(TOUCH_WINDOW_DAYS),
    "touchpoints_30d_post": q_touchpoints(LONG_TOUCH_WINDOW_DAYS),
    "attr_first_post": q_model(A.first_touch),
    "attr_last_post": q_model(A.last_touch),
    "attr_linear_post": q_model(A.linear),
    "attr_position_post": q_model(A.position_based),
    "attr_decay_post": q_model(A.time_decay),
    "attr_compare_post": q_compare("post"),
    "attr_compare_pre": q_compare("pre"),
    "attr_compare_window_post": q_compare_window,
    "lookback_static": q_lookback_static,
    "lookback_one_day": q_lookback_one_day,
    "lookback_tvf_one_day": q_lookback_tvf_one_day,
    "lookback_tvf": q_lookback_tvf,
    "channel_report_post": q_channel_report,
    "channel_report_site_table_post": q_channel_report_site_table,
    "channel_push_and_added_sites": q_channel_push_and_added,
    "channel_sql_session_start": q_channel_sql,
}
