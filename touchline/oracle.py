"""DuckDB SQL for every registered query (the correctness oracle).

Written in the textbook form of the original analyses -- window functions
over events, joins with every earlier session, pairs of conversions and page
views ranked per transaction -- so that it checks the Spark designs (as-of
fill, aggregated histories, one-pass model comparison, lookup-based lookback)
rather than restating them. Tables: the `events` test table (views are
pre-registered by the checker); the export adapter is repeated as a CTE.
"""

from __future__ import annotations

from touchline.functions.timefn import shift_date_key
from touchline.plans import catalog as C
from touchline.plans.attribution import MODEL_COLUMNS
from touchline.sources import fixture as X

# Doubles are rounded beside ties, like catalog.OFF_TIE.
SYSTEM = "('session_start', 'first_visit')"
DAY_US = 86_400_000_000


def _case(expr: str, mapping: dict, otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    tail = f" ELSE '{otherwise}'" if otherwise is not None else ""
    return f"CASE {expr} {whens}{tail} END"


def _prefix() -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EVENT_NAMES.items())
    has_src = f"user_id % {X.NO_SOURCE_USER_MOD} <> 0"
    return f"""
raw AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k, epoch_us(ts) AS us
  FROM events
),
ev AS (
  SELECT strftime(ts, '%Y%m%d') AS event_date,
         'u' || CAST(user_id AS VARCHAR) AS user_pseudo_id,
         us AS event_timestamp,
         CASE event_type {names} ELSE event_type END AS event_name,
         CASE WHEN k = {X.NO_SESSION_K} THEN NULL ELSE (us // {DAY_US}) * 86400 END AS ga_session_id,
         '{X.PAGE_URL_PREFIX}' || CAST(k AS VARCHAR) AS page_location,
         CASE WHEN {has_src} THEN {_case('k % 8', X.MEDIUM_BY_K_MOD_8)} END AS medium,
         CASE WHEN {has_src} THEN {_case('k % 8', X.SOURCE_BY_K_MOD_8)} END AS source,
         {_case('k % 5', X.CAMPAIGN_BY_K_MOD_5, X.CAMPAIGN_OTHERWISE)} AS campaign,
         CASE WHEN {has_src} AND k % 20 = {X.GCLID_K_MOD_20} THEN 'g' || CAST(event_id AS VARCHAR) END AS gclid,
         CASE WHEN event_type = 'purchase' THEN value END AS revenue,
         CASE WHEN event_type = 'purchase' THEN 't' || CAST(event_id AS VARCHAR) END AS transaction_id
  FROM raw
)"""


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join([_prefix(), *ctes]) + "\n" + body


ALL = "TRUE"


def _between(start: str | None, end: str | None) -> str:
    parts = [f"event_date >= '{start}'" if start else "", f"event_date <= '{end}'" if end else ""]
    return " AND ".join(p for p in parts if p) or ALL


def _current_sessions(era: str, campaign: bool = False, dates: str = ALL) -> str:
    camp = ", campaign" if campaign else ""
    if era == "post":
        return f"""cur AS (
  SELECT DISTINCT user_pseudo_id, ga_session_id,
         CASE WHEN gclid IS NOT NULL THEN 'cpc' ELSE medium END AS medium, source AS src{camp}
  FROM ev WHERE event_name = 'session_start' AND {dates})"""
    fv_camp = ", first_value(campaign) OVER w AS campaign" if campaign else ""
    return f"""cur AS (
  SELECT DISTINCT user_pseudo_id, ga_session_id,
         CASE WHEN g IS NOT NULL THEN 'cpc' ELSE m END AS medium, s AS src{camp}
  FROM (SELECT user_pseudo_id, ga_session_id,
               first_value(medium) OVER w AS m, first_value(source) OVER w AS s,
               first_value(gclid) OVER w AS g{fv_camp}
        FROM ev WHERE event_name NOT IN {SYSTEM} AND {dates}
        WINDOW w AS (PARTITION BY user_pseudo_id, ga_session_id ORDER BY event_timestamp)))"""


def _traffic_history(era: str, dates: str = ALL) -> str:
    only = f" AND event_name NOT IN {SYSTEM}" if era == "pre" else ""
    return f"""hist AS (
  SELECT DISTINCT user_pseudo_id, old_ga_session_id,
         CASE WHEN g IS NOT NULL THEN 'cpc' ELSE m END AS old_medium, s AS old_src
  FROM (SELECT user_pseudo_id, ga_session_id AS old_ga_session_id,
               first_value(medium IGNORE NULLS) OVER wd AS m,
               first_value(source IGNORE NULLS) OVER wd AS s,
               first_value(gclid) OVER wa AS g
        FROM ev WHERE {dates}{only}
        WINDOW wd AS (PARTITION BY user_pseudo_id, ga_session_id ORDER BY event_timestamp DESC),
               wa AS (PARTITION BY user_pseudo_id, ga_session_id ORDER BY event_timestamp)))"""


def _last_non_direct(campaign: bool = False) -> str:
    camp = ", c.campaign" if campaign else ""
    return f"""lnd AS (
  SELECT c.user_pseudo_id, c.ga_session_id,
         coalesce(c.medium, arg_max(h.old_medium, h.old_ga_session_id)) AS medium,
         coalesce(c.src, arg_max(h.old_src, h.old_ga_session_id)) AS src{camp}
  FROM cur c JOIN hist h
    ON h.user_pseudo_id = c.user_pseudo_id AND h.old_ga_session_id <= c.ga_session_id
  GROUP BY c.user_pseudo_id, c.ga_session_id, c.medium, c.src{camp})"""


def _first_history(dates: str = ALL) -> str:
    return f"""fhist AS (
  SELECT DISTINCT user_pseudo_id, old_ga_session_id,
         CASE WHEN g IS NOT NULL THEN 'cpc' ELSE m END AS old_medium
  FROM (SELECT user_pseudo_id, ga_session_id AS old_ga_session_id,
               first_value(medium) OVER w AS m, first_value(gclid) OVER w AS g
        FROM ev WHERE event_name NOT IN {SYSTEM} AND {dates}
        WINDOW w AS (PARTITION BY user_pseudo_id, ga_session_id ORDER BY event_timestamp)))"""


def _attribution_current(era: str, dates: str = ALL) -> str:
    if era == "post":
        return f"""acur AS (
  SELECT user_pseudo_id, ga_session_id,
         CASE WHEN gclid IS NOT NULL THEN 'cpc' ELSE medium END AS medium,
         min(event_timestamp) AS session_start_us
  FROM ev WHERE event_name = 'session_start' AND {dates}
  GROUP BY 1, 2, 3)"""
    return f"""acur AS (
  SELECT user_pseudo_id, ga_session_id,
         CASE WHEN g IS NOT NULL THEN 'cpc' ELSE m END AS medium,
         min(event_timestamp) AS session_start_us
  FROM (SELECT user_pseudo_id, ga_session_id, event_timestamp,
               first_value(medium) OVER w AS m, first_value(gclid) OVER w AS g
        FROM ev WHERE event_name NOT IN {SYSTEM} AND {dates}
        WINDOW w AS (PARTITION BY user_pseudo_id, ga_session_id ORDER BY event_timestamp))
  GROUP BY 1, 2, 3)"""


def _interactions(era: str, dates: str = ALL, history: str = ALL) -> list[str]:
    return [
        _attribution_current(era, dates),
        _first_history(history),
        """inter AS (
  SELECT c.user_pseudo_id, c.ga_session_id,
         coalesce(c.medium, arg_max(h.old_medium, h.old_ga_session_id)) AS medium,
         c.medium AS raw_medium, c.session_start_us
  FROM acur c JOIN fhist h
    ON h.user_pseudo_id = c.user_pseudo_id AND h.old_ga_session_id <= c.ga_session_id
  GROUP BY c.user_pseudo_id, c.ga_session_id, c.medium, c.session_start_us)""",
    ]


def _conversions(dates: str = ALL) -> str:
    return f"""conv AS (
  SELECT user_pseudo_id, ga_session_id, min(event_timestamp) AS conversion_us,
         sum(revenue) AS revenue, max(transaction_id) AS transaction_id
  FROM ev WHERE event_name = 'purchase' AND {dates}
  GROUP BY 1, 2)"""


POSITION = (
    "CASE WHEN total_interactions = 1 THEN 1.0::DOUBLE WHEN total_interactions = 2 THEN 0.5::DOUBLE "
    "WHEN rn = 1 THEN 0.4::DOUBLE WHEN rnd = 1 THEN 0.4::DOUBLE "
    "ELSE 0.2::DOUBLE / (total_interactions - 2) END"
)


def _base(
    era: str, days: int = C.TOUCH_WINDOW_DAYS, conversions: str = ALL, sessions: str = ALL, history: str = ALL
) -> list[str]:
    span = days * DAY_US
    return [
        _conversions(conversions),
        *_interactions(era, sessions, history),
        f"""pairs AS (
  SELECT i.user_pseudo_id, i.ga_session_id, i.medium, i.raw_medium, i.session_start_us AS interaction_us,
         c.ga_session_id AS conversion_session_id, c.conversion_us, c.revenue, c.transaction_id,
         pow(0.5, ((c.conversion_us - i.session_start_us) // 60000000) / 10080.0) AS w
  FROM conv c JOIN inter i ON i.user_pseudo_id = c.user_pseudo_id
  WHERE i.session_start_us <= c.conversion_us AND i.session_start_us > c.conversion_us - {span})""",
        """base AS (
  SELECT *,
         count(*) OVER (PARTITION BY transaction_id) AS total_interactions,
         row_number() OVER (PARTITION BY transaction_id ORDER BY interaction_us, user_pseudo_id,
             ga_session_id, medium NULLS FIRST, raw_medium NULLS FIRST, conversion_session_id NULLS FIRST, conversion_us) AS rn,
         row_number() OVER (PARTITION BY transaction_id ORDER BY interaction_us DESC,
             user_pseudo_id DESC, ga_session_id DESC, medium DESC NULLS LAST,
             raw_medium DESC NULLS LAST, conversion_session_id DESC NULLS LAST, conversion_us DESC) AS rnd,
         w / sum(w) OVER (PARTITION BY transaction_id) AS decay_share
  FROM pairs)""",
    ]


def _models() -> list[str]:
    return [
        """m_first AS (SELECT medium, round(sum(revenue) + 1e-7, 4) AS revenueFirstTouch,
           count(DISTINCT transaction_id) AS conversionsFirstTouch FROM base WHERE rn = 1 GROUP BY medium)""",
        """m_last AS (SELECT medium, round(sum(revenue) + 1e-7, 4) AS revenueLastTouch,
           count(DISTINCT transaction_id) AS conversionsLastTouch FROM base WHERE rnd = 1 GROUP BY medium)""",
        """m_linear AS (SELECT medium, round(sum(revenue / total_interactions) + 1e-7, 4) AS revenueLinear,
           round(sum(1.0::DOUBLE / total_interactions) + 1e-7, 4) AS conversionsLinear FROM base GROUP BY medium)""",
        f"""m_position AS (SELECT medium, round(sum(revenue * ({POSITION})) + 1e-7, 4) AS revenuePosition,
           round(sum({POSITION}) + 1e-7, 4) AS conversionsPosition FROM base GROUP BY medium)""",
        """m_decay AS (SELECT medium, round(sum(revenue * decay_share) + 1e-7, 4) AS revenueDecay,
           round(sum(decay_share) + 1e-7, 4) AS conversionsDecay FROM base GROUP BY medium)""",
    ]


def _lookback(days: int, dates: str = ALL) -> str:
    return _with(
        f"""conv AS (SELECT user_pseudo_id, event_timestamp AS conversion_us, revenue AS purchase_revenue,
                   transaction_id FROM ev WHERE event_name = 'purchase' AND {dates})""",
        f"""pv AS (SELECT user_pseudo_id, event_timestamp AS page_us, page_location
                 FROM ev WHERE event_name = 'page_view')""",
        body=f"""
SELECT c.user_pseudo_id, round(c.purchase_revenue + 1e-7, 4) AS purchase_revenue,
       c.conversion_us AS purchase_time_us, p.page_us AS first_page_time_us,
       p.page_location AS first_page_location
FROM conv c JOIN pv p ON p.user_pseudo_id = c.user_pseudo_id
WHERE c.conversion_us - p.page_us BETWEEN 0 AND {days} * {DAY_US}
QUALIFY row_number() OVER (PARTITION BY c.transaction_id ORDER BY p.page_us, c.conversion_us,
                           c.user_pseudo_id, p.page_location, c.purchase_revenue) = 1""",
    )


def _channel_case(m: str, s: str, c: str, added: dict[str, str] | None = None) -> str:
    """The rules written out by hand, with the sites that the test table's
    sources can be: google and bing (search), youtube.com (video) and
    facebook.com (social); none of them is a shopping site. added: conditions
    under which a row's source is a site of a category besides."""
    more = {k: (added or {}).get(k, "FALSE") for k in ("shopping", "search", "social", "video")}
    m, s, c = f"lower({m})", f"lower({s})", f"lower({c})"
    paid = f"regexp_matches({m}, '^(.*cp.*|ppc|retargeting|paid.*)$')"
    shop = f"regexp_matches({c}, '^(.*(([^a-df-z]|^)shop|shopping).*)$')"
    search, social, video = (
        f"({site} OR {more[k]})"
        for k, site in (("search", f"{s} IN ('google', 'bing')"), ("social", f"{s} = 'facebook.com'"), ("video", f"{s} = 'youtube.com'"))
    )
    return f"""CASE
  WHEN {s} = '(direct)' AND {m} IN ('(not set)', '(none)') THEN 'Direct'
  WHEN contains({c}, 'cross-network') THEN 'Cross-network'
  WHEN {more['shopping']} OR ({shop} AND {paid}) THEN 'Paid Shopping'
  WHEN {search} AND {paid} THEN 'Paid Search'
  WHEN {social} AND {paid} THEN 'Paid Social'
  WHEN {video} AND {paid} THEN 'Paid Video'
  WHEN {m} IN ('display', 'banner', 'expandable', 'interstitial', 'cpm') THEN 'Display'
  WHEN {paid} THEN 'Paid Other'
  WHEN {more['shopping']} OR {shop} THEN 'Organic Shopping'
  WHEN {social} OR {m} IN ('social', 'social-network', 'social-media', 'sm', 'social network', 'social media')
    THEN 'Organic Social'
  WHEN {video} OR contains({m}, 'video') THEN 'Organic Video'
  WHEN {search} OR {m} = 'organic' THEN 'Organic Search'
  WHEN {m} IN ('referral', 'app', 'link') THEN 'Referral'
  WHEN {s} IN ('email', 'e-mail', 'e_mail', 'e mail') OR {m} IN ('email', 'e-mail', 'e_mail', 'e mail') THEN 'Email'
  WHEN {m} = 'affiliate' THEN 'Affiliates'
  WHEN {m} = 'audio' THEN 'Audio'
  WHEN {s} = 'sms' OR {m} = 'sms' THEN 'SMS'
  WHEN suffix({m}, 'push') OR {s} = 'firebase' THEN 'Mobile Push Notification'
  ELSE 'N/A for (source/medium/campaign) = (' || {s} || '/' || {m} || '/' || {c} || ')' END"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["event_params"] = _with(
        body="SELECT user_pseudo_id, event_timestamp, event_name, ga_session_id, page_location FROM ev"
    )
    q["event_params_strict"] = q["event_params"]
    q["shard_range_counts"] = _with(
        body="SELECT event_date, count(*) AS events FROM ev GROUP BY event_date"
    )
    q["shard_exact"] = _with(
        body=f"SELECT event_name, count(*) AS events FROM ev WHERE event_date = '{C.EXACT_DAY}' GROUP BY event_name"
    )
    q["shard_prefix"] = _with(
        body=f"""SELECT event_date, event_name, count(*) AS events FROM ev
WHERE event_date LIKE '{C.PREFIX}%' GROUP BY event_date, event_name"""
    )
    history = _between(shift_date_key(C.WINDOW[0], -C.WINDOW_HISTORY_DAYS), C.WINDOW[1])
    q["export_day"], q["export_prefix"] = q["shard_exact"], q["shard_prefix"]
    q["shard_window"] = _with(body=f"SELECT event_date, count(*) AS events FROM ev WHERE {history} GROUP BY event_date")
    for era in ("post", "pre"):
        q[f"session_source_{era}"] = _with(_current_sessions(era), body="SELECT * FROM cur")
    # the running windows leave a NULL beside a session's last non-NULL value
    q["session_history_last_nonnull"] = _with(
        _traffic_history("post"),
        body="""SELECT user_pseudo_id, old_ga_session_id, max(old_medium) AS old_medium, max(old_src) AS old_src
FROM hist WHERE old_ga_session_id IS NOT NULL GROUP BY 1, 2""",
    )
    q["session_history_first"] = _with(
        _first_history(), body="SELECT * FROM fhist WHERE old_ga_session_id IS NOT NULL"
    )
    for era in ("post", "pre"):
        ctes = (_current_sessions(era), _traffic_history(era), _last_non_direct())
        q[f"last_non_direct_{era}"] = _with(*ctes, body="SELECT * FROM lnd")
        q[f"sessions_by_medium_{era}"] = _with(
            *ctes,
            body="""SELECT medium, count(DISTINCT user_pseudo_id || ' ' || CAST(ga_session_id AS VARCHAR)) AS sessions
FROM lnd GROUP BY medium""",
        )
        window = (
            _current_sessions(era, dates=_between(*C.WINDOW)), _traffic_history(era, history), _last_non_direct()
        )
        q[f"sessions_by_medium_window_{era}"] = _with(
            *window,
            body="""SELECT medium, count(DISTINCT user_pseudo_id || ' ' || CAST(ga_session_id AS VARCHAR)) AS sessions
FROM lnd GROUP BY medium""",
        )
    q["export_sessions_window"] = q["sessions_by_medium_window_post"]
    q["conversions"] = _with(
        _conversions(),
        body="""SELECT user_pseudo_id, ga_session_id, conversion_us, round(revenue + 1e-7, 4) AS revenue,
       transaction_id FROM conv""",
    )
    for era in ("post", "pre"):
        q[f"interactions_{era}"] = _with(*_interactions(era), body="SELECT * EXCLUDE (raw_medium) FROM inter")
    for name, days in (("touchpoints_post", C.TOUCH_WINDOW_DAYS), ("touchpoints_30d_post", C.LONG_TOUCH_WINDOW_DAYS)):
        q[name] = _with(
            *_base("post", days),
            body=f"""
SELECT user_pseudo_id, ga_session_id, medium, interaction_us, conversion_session_id, conversion_us,
       round(revenue + 1e-7, 4) AS revenue, transaction_id, total_interactions,
       rn = 1 AS is_first, rnd = 1 AS is_last,
       round(1.0::DOUBLE / total_interactions + 1e-7, 4) AS linear_share,
       round({POSITION} + 1e-7, 4) AS position_share,
       round(decay_share + 1e-7, 4) AS decay_share
FROM base""",
        )
    names = ("first", "last", "linear", "position", "decay")
    for name in names:
        q[f"attr_{name}_post"] = _with(*_base("post"), *_models(), body=f"SELECT * FROM m_{name}")
    cols = ", ".join(MODEL_COLUMNS)
    joined = "m_first " + " ".join(f"JOIN m_{n} USING (medium)" for n in names[1:])
    for era in ("post", "pre"):
        q[f"attr_compare_{era}"] = _with(*_base(era), *_models(), body=f"SELECT {cols} FROM {joined}")
    window = _base(
        "post", C.TOUCH_WINDOW_DAYS, _between(*C.WINDOW),
        _between(shift_date_key(C.WINDOW[0], -C.TOUCH_WINDOW_DAYS), C.WINDOW[1]), _between(None, C.WINDOW[1]),
    )
    q["attr_compare_window_post"] = _with(*window, *_models(), body=f"SELECT {cols} FROM {joined}")
    one_day = _lookback(C.LOOKBACK_STATIC_DAYS, _between(C.EXACT_DAY, C.EXACT_DAY))
    q["lookback_one_day"] = q["lookback_tvf_one_day"] = one_day
    q["lookback_static"] = _lookback(C.LOOKBACK_STATIC_DAYS)
    q["lookback_tvf"] = _lookback(C.LOOKBACK_TVF_DAYS)
    chan = _channel_case(
        f"coalesce(medium, '{C.NO_MEDIUM}')",
        f"coalesce(src, '{C.NO_SOURCE}')",
        f"coalesce(campaign, '{C.NO_CAMPAIGN}')",
    )
    q["channel_report_post"] = _with(
        _current_sessions("post", campaign=True),
        _traffic_history("post"),
        _last_non_direct(campaign=True),
        body=f"""SELECT channel, count(DISTINCT user_pseudo_id || ' ' || CAST(ga_session_id AS VARCHAR)) AS sessions
FROM (SELECT *, {chan} AS channel FROM lnd) GROUP BY channel""",
    )
    q["channel_report_site_table_post"] = q["channel_report_post"]
    source = f"lower(coalesce(source, '{C.NO_SOURCE}'))"
    ends = lambda digit, site: f"({source} = '{site}' AND user_pseudo_id LIKE '%{digit}')"
    pushed = "CASE medium WHEN 'email' THEN 'Web-Push' WHEN 'referral' THEN 'mobile_push' ELSE medium END"
    push_chan = _channel_case(
        f"coalesce({pushed}, '{C.NO_MEDIUM}')", source, f"coalesce(campaign, '{C.NO_CAMPAIGN}')",
        {"shopping": ends(7, "newsletter"), "search": ends(3, "partner.example"), "social": ends(2, "newsletter"), "video": ends(1, "partner.example")},
    )
    q["channel_push_and_added_sites"] = _with(
        body=f"SELECT channel, count(*) AS events FROM (SELECT {push_chan} AS channel FROM ev) GROUP BY channel"
    )
    raw_chan = _channel_case(
        f"coalesce(medium, '{C.NO_MEDIUM}')",
        f"coalesce(source, '{C.NO_SOURCE}')",
        f"coalesce(campaign, '{C.NO_CAMPAIGN}')",
    )
    q["channel_sql_session_start"] = _with(
        body=f"SELECT {raw_chan} AS channel, count(*) AS events FROM ev WHERE event_name = 'session_start' GROUP BY 1"
    )
    return q
