"""SQL surface: session-scoped SQL functions.

  default_channel_grouping(medium, source, campaign, shopping_sites_add,
      search_sites_add, social_sites_add, video_sites_add) -> STRING
      A SQL scalar function (inlined by Catalyst; no Python on the row path).
      Extra-site arrays may be NULL.

  lookback_window(lookback_window_days, conversion_event
      [, conversion_start, conversion_end, page_start, page_end]) -> TABLE
      A SQL table function over a registered events view: the first page
      seen within the lookback window before each conversion, one row per
      transaction id. A NULL date is no bound; NULL page dates follow from the
      conversion dates and the lookback days. Same algorithm as `touchline.plans.lookback` (forward
      as-of over time buckets, no conversion x page-view join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.functions.channels import SiteLists, channel_case_sql
from touchline.plans.lookback import HOUR_US
from touchline.schema import MICROS_PER_DAY

DEFAULT_EVENTS_VIEW = "touchline_events"

_PAGE_TYPE = "STRUCT<page_us: BIGINT, location: STRING>"


def channel_function_sql(
    sites: SiteLists, name: str = "default_channel_grouping", fix_push_rule: bool = False
) -> str:
    body = channel_case_sql(
        "medium",
        "source",
        "campaign",
        sites,
        fix_push_rule=fix_push_rule,
        added={
            "shopping": "shopping_sites_add",
            "search": "search_sites_add",
            "social": "social_sites_add",
            "video": "video_sites_add",
        },
    )
    return (
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(medium STRING, source STRING, campaign STRING, "
        "shopping_sites_add ARRAY<STRING>, search_sites_add ARRAY<STRING>, "
        "social_sites_add ARRAY<STRING>, video_sites_add ARRAY<STRING>) "
        f"RETURNS STRING RETURN {body}"
    )


def _bucket(expr: str, width: int) -> str:
    return f"CAST((({expr}) - pmod({expr}, {width}L)) DIV {width}L AS BIGINT)"


def lookback_function_sql(
    events_view: str = DEFAULT_EVENTS_VIEW,
    name: str = "lookback_window",
    bucket_width: int = HOUR_US,
) -> str:
    day = f"{MICROS_PER_DAY}L"
    page_loc = (
        "get(event_params, CAST(array_position(event_params.key, 'page_location') - 1 AS INT))"
        ".value.string_value"
    )
    shifted = "date_format(date_add(to_date({0}, 'yyyyMMdd'), {1}), 'yyyyMMdd')"
    page_from = f"coalesce(page_start, {shifted.format('conversion_start', '-lookback_window_days - 1')})"
    page_to = f"coalesce(page_end, {shifted.format('conversion_end', '1')})"
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(
    lookback_window_days INT, conversion_event STRING,
    conversion_start STRING DEFAULT NULL, conversion_end STRING DEFAULT NULL,
    page_start STRING DEFAULT NULL, page_end STRING DEFAULT NULL)
RETURNS TABLE(user_pseudo_id STRING, purchase_revenue DOUBLE, purchase_time TIMESTAMP,
              first_page_time TIMESTAMP, first_page_location STRING)
RETURN
WITH probe AS (
  SELECT user_pseudo_id, event_timestamp AS conversion_us,
         ecommerce.purchase_revenue AS purchase_revenue, ecommerce.transaction_id AS transaction_id,
         -(event_timestamp - CAST(lookback_window_days AS BIGINT) * {day}) AS nk
  FROM {events_view}
  WHERE event_name = conversion_event AND user_pseudo_id IS NOT NULL
    AND (conversion_start IS NULL OR event_date >= conversion_start)
    AND (conversion_end IS NULL OR event_date <= conversion_end)
),
build AS (
  SELECT user_pseudo_id, -event_timestamp AS nk,
         named_struct('page_us', event_timestamp, 'location', min({page_loc})) AS page
  FROM {events_view}
  WHERE event_name = 'page_view' AND user_pseudo_id IS NOT NULL
    AND ({page_from} IS NULL OR event_date >= {page_from})
    AND ({page_to} IS NULL OR event_date <= {page_to})
  GROUP BY user_pseudo_id, event_timestamp
),
stacked AS (
  SELECT /*+ REPARTITION(user_pseudo_id, b) */ * FROM (
    SELECT user_pseudo_id, {_bucket('nk', bucket_width)} AS b, nk, conversion_us, purchase_revenue,
           transaction_id, CAST(NULL AS {_PAGE_TYPE}) AS page, 0 AS is_build
    FROM probe
    UNION ALL
    SELECT user_pseudo_id, {_bucket('nk', bucket_width)} AS b, nk, NULL, NULL, NULL, page, 1
    FROM build
  )
),
in_bucket AS (
  SELECT user_pseudo_id, b, conversion_us, purchase_revenue, transaction_id, is_build,
         last(page) IGNORE NULLS OVER (PARTITION BY user_pseudo_id, b ORDER BY nk
                                       RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_page
  FROM stacked
),
summary AS (
  SELECT user_pseudo_id, b, max_by(page, IF(is_build = 1, nk, NULL)) AS page,
         max(IF(is_build = 0, xxhash64(conversion_us, purchase_revenue, transaction_id), NULL)) AS probes
  FROM stacked GROUP BY user_pseudo_id, b
),
carry AS (
  SELECT user_pseudo_id, b, probes,
         last(page) IGNORE NULLS OVER (PARTITION BY user_pseudo_id ORDER BY b
                                       RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_page
  FROM summary
),
found AS (
  SELECT i.user_pseudo_id, i.conversion_us, i.purchase_revenue, i.transaction_id,
         coalesce(i.in_page, c.c_page) AS page
  FROM in_bucket i
  LEFT JOIN (SELECT * FROM carry WHERE probes IS NOT NULL) c
    ON i.user_pseudo_id = c.user_pseudo_id AND i.b = c.b
  WHERE i.is_build = 0
),
picked AS (
  SELECT min_by(named_struct('user_pseudo_id', user_pseudo_id, 'purchase_revenue', purchase_revenue,
                             'conversion_us', conversion_us, 'page', page),
                named_struct('t', page.page_us, 'c', conversion_us, 'u', user_pseudo_id,
                             'l', page.location, 'r', purchase_revenue)) AS p
  FROM found
  WHERE page IS NOT NULL AND page.page_us <= conversion_us
  GROUP BY transaction_id
)
SELECT p.user_pseudo_id, p.purchase_revenue, timestamp_micros(p.conversion_us) AS purchase_time,
       timestamp_micros(p.page.page_us) AS first_page_time, p.page.location AS first_page_location
FROM picked
"""


def register_sql_functions(
    spark: SparkSession,
    sites: SiteLists,
    events: DataFrame | None = None,
    events_view: str = DEFAULT_EVENTS_VIEW,
    fix_push_rule: bool = False,
) -> None:
    """Register the channel function, and the lookback table function when an
    events view exists; `events` (export-shaped) is registered as
    `events_view` when given."""
    if events is not None:
        events.createOrReplaceTempView(events_view)
    spark.sql(channel_function_sql(sites, fix_push_rule=fix_push_rule))
    if spark.catalog.tableExists(events_view):
        spark.sql(lookback_function_sql(events_view))
