"""Adapter from the generic `events` test table to export-shaped rows.

The test table has (event_id, ts TIMESTAMP_NTZ, user_id, event_type, value,
props JSON {"k": 0..99}); the analyses need the export shape. Every field is a
deterministic function of one input row (a projection: no row is dropped), so
the adapter adds no shuffle and Catalyst prunes whatever a job does not use.
The same mapping is written in DuckDB SQL in `touchline.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.schema import MICROS_PER_DAY, PAGE_LOCATION_PARAM, SESSION_ID_PARAM

# Fixed values of the test-data mapping (FIXTURES.md section C).
EVENT_NAMES = {"view": "page_view", "signup": "session_start", "error": "first_visit"}
MEDIUM_BY_K_MOD_8 = {3: "organic", 4: "cpc", 5: "email", 6: "referral", 7: "social"}
SOURCE_BY_K_MOD_8 = {
    2: "bing",
    3: "google",
    4: "youtube.com",
    5: "newsletter",
    6: "partner.example",
    7: "facebook.com",
}
CAMPAIGN_BY_K_MOD_5 = {0: "spring-shop", 1: "cross-network"}
CAMPAIGN_OTHERWISE = "brand"
PAGE_URL_PREFIX = "https://shop.example/p/"
NO_SESSION_K = 99  # events with this k carry no session id
NO_SOURCE_USER_MOD = 10  # users with user_id % 10 == 0 have no traffic source
GCLID_K_MOD_20 = 5


def _lookup(key: Column, mapping: dict, otherwise=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(F.lit(otherwise))


def export_from_test_events(events: DataFrame) -> DataFrame:
    # parse the JSON and the timestamp once; Catalyst does not inline these
    # non-trivial expressions into their many uses below
    events = events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("__k"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("__us"),
    )
    ts = F.col("ts")
    us = F.col("__us")
    k = F.col("__k")
    has_source = (F.col("user_id") % NO_SOURCE_USER_MOD) != 0
    is_purchase = F.col("event_type") == "purchase"

    session_param = F.struct(
        F.lit(SESSION_ID_PARAM).alias("key"),
        F.struct(
            F.lit(None).cast("string").alias("string_value"),
            ((us - us % MICROS_PER_DAY) / MICROS_PER_DAY * 86_400).cast("long").alias("int_value"),
        ).alias("value"),
    )
    page_param = F.struct(
        F.lit(PAGE_LOCATION_PARAM).alias("key"),
        F.struct(
            F.concat(F.lit(PAGE_URL_PREFIX), k.cast("string")).alias("string_value"),
            F.lit(None).cast("long").alias("int_value"),
        ).alias("value"),
    )
    params = F.when(k == NO_SESSION_K, F.array(page_param)).otherwise(
        F.array(session_param, page_param)
    )

    event_name = F.col("event_type")
    for raw, name in EVENT_NAMES.items():
        event_name = F.when(F.col("event_type") == raw, F.lit(name)).otherwise(event_name)

    return events.select(
        F.date_format(ts, "yyyyMMdd").alias("event_date"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_pseudo_id"),
        us.alias("event_timestamp"),
        event_name.alias("event_name"),
        params.alias("event_params"),
        F.struct(
            F.when(has_source, _lookup(k % 8, MEDIUM_BY_K_MOD_8)).alias("manual_medium"),
            F.when(has_source, _lookup(k % 8, SOURCE_BY_K_MOD_8)).alias("manual_source"),
            _lookup(k % 5, CAMPAIGN_BY_K_MOD_5, CAMPAIGN_OTHERWISE).alias("manual_campaign_name"),
            F.when(
                has_source & ((k % 20) == GCLID_K_MOD_20),
                F.concat(F.lit("g"), F.col("event_id").cast("string")),
            ).alias("gclid"),
        ).alias("collected_traffic_source"),
        F.struct(
            F.when(is_purchase, F.col("value")).alias("purchase_revenue"),
            F.when(is_purchase, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias(
                "transaction_id"
            ),
        ).alias("ecommerce"),
    )


def read_test_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_from_test_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
