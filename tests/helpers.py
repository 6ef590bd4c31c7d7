"""Build export-shaped events by hand."""

from __future__ import annotations

import datetime as dt

from touchline.schema import EVENT, MICROS_PER_DAY

T0 = int(dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
DAY = MICROS_PER_DAY
MIN = 60_000_000


def ev(user, ts_us, name, sid=None, medium=None, source=None, gclid=None, campaign=None,
       revenue=None, txn=None, page=None):
    params = []
    if sid is not None:
        params.append(("ga_session_id", (None, sid)))
    if page is not None:
        params.append(("page_location", (page, None)))
    date = dt.datetime.fromtimestamp(ts_us / 1e6, tz=dt.timezone.utc).strftime("%Y%m%d")
    return (date, user, ts_us, name, params, (medium, source, campaign, gclid), (revenue, txn))


def events_df(spark, rows):
    return spark.createDataFrame(rows, EVENT)
