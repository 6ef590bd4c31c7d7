"""The export-shaped event row and shared constants.

One row per event, date-sharded by `event_date` (yyyyMMdd string). Only the
fields the analyses touch are declared; extra columns are carried untouched.
"""

from pyspark.sql import types as T

PARAM_VALUE = T.StructType(
    [
        T.StructField("string_value", T.StringType()),
        T.StructField("int_value", T.LongType()),
    ]
)

EVENT_PARAM = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", PARAM_VALUE)]
)

TRAFFIC_SOURCE = T.StructType(
    [
        T.StructField("manual_medium", T.StringType()),
        T.StructField("manual_source", T.StringType()),
        T.StructField("manual_campaign_name", T.StringType()),
        T.StructField("gclid", T.StringType()),
    ]
)

ECOMMERCE = T.StructType(
    [
        T.StructField("purchase_revenue", T.DoubleType()),
        T.StructField("transaction_id", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_date", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),  # epoch microseconds
        T.StructField("event_name", T.StringType()),
        T.StructField("event_params", T.ArrayType(EVENT_PARAM)),
        T.StructField("collected_traffic_source", TRAFFIC_SOURCE),
        T.StructField("ecommerce", ECOMMERCE),
    ]
)

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND
SECONDS_PER_DAY = 86_400

# Event names that are not user interactions in the "pre" era.
SYSTEM_EVENTS = ("session_start", "first_visit")

SESSION_ID_PARAM = "ga_session_id"
PAGE_LOCATION_PARAM = "page_location"
