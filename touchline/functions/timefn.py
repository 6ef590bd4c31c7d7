"""Time helpers. Event times stay epoch microseconds (LongType) inside the
jobs, so every interval is exact 24-hour arithmetic whatever the session time
zone; they become TIMESTAMP values only on output."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F

from touchline.schema import MICROS_PER_MINUTE


def micros_to_timestamp(col: Column | str) -> Column:
    return F.timestamp_micros(F.col(col) if isinstance(col, str) else col)


def whole_minutes_between(later_us: Column, earlier_us: Column) -> Column:
    """Whole minutes from `earlier` to `later`, truncated toward zero."""
    diff = later_us - earlier_us
    # `%` keeps the dividend's sign, so this is exact truncating division
    return ((diff - diff % F.lit(MICROS_PER_MINUTE)) / F.lit(MICROS_PER_MINUTE)).cast("long")


def shift_date_key(date_key: str | None, days: int) -> str | None:
    """yyyyMMdd shifted by whole days, computed once on the driver so the
    bound reaches the scan as a literal (partition pruning). None (no bound)
    stays None."""
    if date_key is None:
        return None
    d = _dt.datetime.strptime(date_key, "%Y%m%d").date() + _dt.timedelta(days=days)
    return d.strftime("%Y%m%d")
