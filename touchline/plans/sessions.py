"""Session traffic source with last-non-direct fill, and sessions by medium.

Two eras of the export: from November 2023 the `session_start` event carries
the session's traffic source ("post"); before that it does not, and the
session's source is read from its first event that is not `session_start` or
`first_visit` ("pre"). One set of jobs takes `era` instead of two copies.

Semantics kept from the original analysis:
  * a click id (gclid) turns the medium into "cpc" and leaves the source;
  * a session whose medium (source) is NULL takes the medium (source) of the
    latest session of the same user, at or before it (by session id), that has
    one; medium and source are filled independently;
  * a session with no history row at or before it is dropped (the original
    outer join is made inner by its WHERE clause), as is a session without id;
  * a session with several (medium, source) rows counts once under each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.params import session_id
from touchline.functions.timefn import shift_date_key
from touchline.operators.asof import IS_BUILD, asof_backward, asof_stacked, value_column
from touchline.schema import SECONDS_PER_DAY, SYSTEM_EVENTS
from touchline.sources.export import shard_between

ERAS = ("post", "pre")
BUCKET = "__session_bucket"
USER = "user_pseudo_id"
SID = "ga_session_id"


def _traffic(field: str):
    return F.col(f"collected_traffic_source.{field}")


def _medium():
    return _traffic("manual_medium")


def _source():
    return _traffic("manual_source")


def _campaign():
    return _traffic("manual_campaign_name")


def _gclid():
    return _traffic("gclid")


def _check_era(era: str) -> None:
    if era not in ERAS:
        raise ValueError(f"era must be one of {ERAS}, got {era!r}")


def _cpc_if_clicked(gclid, medium):
    return F.when(gclid.isNotNull(), F.lit("cpc")).otherwise(medium)


def interaction_events(events: DataFrame) -> DataFrame:
    """Events that are not `session_start`/`first_visit` (NULL names drop too)."""
    return events.filter(~F.col("event_name").isin(*SYSTEM_EVENTS))


def current_sessions(events: DataFrame, era: str = "post", with_campaign: bool = False) -> DataFrame:
    """Distinct (user, session, medium, src[, campaign]) of the given events.

    post: read from every `session_start` event (several rows per session are
          possible and kept).
    pre:  the session's first interaction event (by event time), NULLs kept.
    """
    _check_era(era)
    extra = [_campaign().alias("campaign")] if with_campaign else []
    if era == "post":
        return (
            events.filter(F.col("event_name") == "session_start")
            .select(
                USER,
                session_id().alias(SID),
                _cpc_if_clicked(_gclid(), _medium()).alias("medium"),
                _source().alias("src"),
                *extra,
            )
            .distinct()
        )
    # min over (time, values): the first event, and equal times resolve the
    # same way on every run (a task recomputed after executor loss agrees)
    first = F.min(
        F.struct(
            F.col("event_timestamp").alias("ts"),
            _medium().alias("medium"),
            _source().alias("src"),
            _gclid().alias("gclid"),
            *extra,
        )
    ).alias("first")
    rows = interaction_events(events).groupBy(USER, session_id().alias(SID)).agg(first)
    return rows.select(
        USER,
        SID,
        _cpc_if_clicked(F.col("first.gclid"), F.col("first.medium")).alias("medium"),
        F.col("first.src").alias("src"),
        *([F.col("first.campaign").alias("campaign")] if with_campaign else []),
    )


def session_history_last_nonnull(events: DataFrame, exclude_system: bool) -> DataFrame:
    """One row per earlier (user, session): its last non-NULL medium and
    source and, when its first event has a click id, medium "cpc".

    Output: user_pseudo_id, old_ga_session_id, old_medium, old_src.
    """
    ev = interaction_events(events) if exclude_system else events
    ts = F.col("event_timestamp")
    return (
        ev.select(USER, session_id().alias("old_ga_session_id"), ts, _medium().alias("m"),
                  _source().alias("s"), _gclid().alias("g"))
        .filter(F.col("old_ga_session_id").isNotNull())
        .groupBy(USER, "old_ga_session_id")
        .agg(
            F.max(F.when(F.col("m").isNotNull(), F.struct(ts, F.col("m"))))["m"].alias("m"),
            F.max(F.when(F.col("s").isNotNull(), F.struct(ts, F.col("s"))))["s"].alias("old_src"),
            F.min(F.struct(ts, F.col("g")))["g"].alias("g"),
        )
        .select(
            USER,
            "old_ga_session_id",
            _cpc_if_clicked(F.col("g"), F.col("m")).alias("old_medium"),
            "old_src",
        )
    )


def session_history_first(events: DataFrame) -> DataFrame:
    """One row per earlier (user, session) with the medium of its first
    interaction event (NULL kept), "cpc" when that event has a click id.

    Output: user_pseudo_id, old_ga_session_id, old_medium.
    """
    first = F.min(F.struct(F.col("event_timestamp"), _medium().alias("m"), _gclid().alias("g")))
    return (
        interaction_events(events)
        .select(USER, session_id().alias("old_ga_session_id"), "event_timestamp",
                "collected_traffic_source")
        .filter(F.col("old_ga_session_id").isNotNull())
        .groupBy(USER, "old_ga_session_id")
        .agg(first.alias("f"))
        .select(USER, "old_ga_session_id", _cpc_if_clicked(F.col("f.g"), F.col("f.m")).alias("old_medium"))
    )


def last_non_direct(
    current: DataFrame,
    history: DataFrame,
    fill: tuple[str, ...] = ("medium", "src"),
    bucket_seconds: int = SECONDS_PER_DAY,
) -> DataFrame:
    """Fill NULL `fill` columns of current sessions from the user's latest
    history session (old_ga_session_id <= ga_session_id) that has a value.

    Sessions without id or without any history row at or before them are
    dropped. Output keeps the columns of `current`.
    """
    values = [f"old_{c}" for c in fill]
    probes = current.filter(F.col(SID).isNotNull())
    matched = asof_backward(
        probes,
        history,
        by=[USER],
        key=SID,
        build_key="old_ga_session_id",
        values=values,
        bucket_width=bucket_seconds,
        count_col="__history_rows",
    ).filter(F.col("__history_rows") > 0)
    cols = []
    for c in current.columns:
        cols.append(F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) if c in fill else F.col(c))
    return matched.select(*cols)


def sessions_by_medium(filled: DataFrame) -> DataFrame:
    """(medium, sessions) with distinct (user, session) counts, most first.
    A NULL medium (direct) is its own group. Rows that carry BUCKET are made
    distinct where they lie, partitioned by user and bucket."""
    return sessions_by(filled, "medium").orderBy(F.desc("sessions"), F.asc_nulls_last("medium"))


def sessions_by(filled: DataFrame, label: str) -> DataFrame:
    """(label, sessions): distinct (user, session) of each label."""
    keys = [USER, SID, label, *([BUCKET] if BUCKET in filled.columns else [])]
    return filled.select(*keys).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("sessions"))


def session_state(
    events: DataFrame, start_date: str | None, era: str = "post", with_campaign: bool = False
) -> DataFrame:
    """One row per (user, session) from one pass over the events: `current`, its
    rows as of `current_sessions` among the events from `start_date` on, and
    what `session_history_last_nonnull` tells of all of them (`history` rows:
    0 where none counts). Sessions without user or id are left out."""
    _check_era(era)
    ts = F.col("event_timestamp")
    name = F.col("event_name")
    extra = [_campaign().alias("c")] if with_campaign else []
    ev = events.select(
        USER, session_id().alias(SID), ts, name, "event_date", _medium().alias("m"), _source().alias("s"),
        _gclid().alias("g"), *extra,
    ).filter(F.col(USER).isNotNull() & F.col(SID).isNotNull())
    now = F.lit(True) if start_date is None else F.col("event_date") >= F.lit(start_date)
    touch = F.coalesce(~name.isin(*SYSTEM_EVENTS), F.lit(False))
    past = F.lit(True) if era == "post" else touch
    m, s, g = F.col("m"), F.col("s"), F.col("g")
    campaign = [F.col("c").alias("campaign")] if with_campaign else []
    if era == "post":
        row = F.struct(_cpc_if_clicked(g, m).alias("medium"), s.alias("src"), *campaign)
        current = F.collect_set(F.when((name == "session_start") & now, row))
    else:
        current = F.min(F.when(touch & now, F.struct(ts, m, s, g, *campaign)))
    state = ev.groupBy(USER, SID).agg(
        current.alias("current"),
        F.count_if(past).alias("history"),
        F.max(F.when(past & m.isNotNull(), F.struct(ts, m)))["m"].alias("old_m"),
        F.max(F.when(past & s.isNotNull(), F.struct(ts, s)))["s"].alias("old_src"),
        F.min(F.when(past, F.struct(ts, g)))["g"].alias("old_g"),
    )
    if era == "pre":
        first = F.col("current")
        row = F.struct(
            _cpc_if_clicked(first["g"], first["m"]).alias("medium"), first["s"].alias("src"),
            *([first["campaign"].alias("campaign")] if with_campaign else []),
        )
        state = state.withColumn("current", F.when(first.isNotNull(), F.array(row)))
    old = _cpc_if_clicked(F.col("old_g"), F.col("old_m")).alias("old_medium")
    return state.select(USER, SID, "current", "history", old, "old_src")


def filled_sessions(
    events: DataFrame,
    start_date: str | None,
    end_date: str | None,
    era: str = "post",
    history_days: int = 90,
    with_campaign: bool = False,
    keep_bucket: bool = False,
    bucket_seconds: int = SECONDS_PER_DAY,
) -> DataFrame:
    """Current sessions of [start, end] filled from the history of
    [start - history_days, end]; None is no bound. In era "post" the history reads every event;
    in "pre" only interaction events. Equal to `last_non_direct` of
    `current_sessions` and `session_history_last_nonnull`, but both come from one
    `session_state`, so the events are read and aggregated once. `keep_bucket`
    adds BUCKET."""
    span = shard_between(events, shift_date_key(start_date, -history_days), end_date)
    state = session_state(span, start_date, era, with_campaign)
    names = ["medium", "src", *(["campaign"] if with_campaign else [])]
    values = ["old_medium", "old_src"]
    null = F.lit(None).cast("string")

    def stacked_row(is_build: int, fields: dict) -> Column:
        return F.struct(
            F.lit(is_build).alias(IS_BUILD),
            *[fields.get(c, null).alias(c) for c in (*names, *map(value_column, values))],
        )

    probes = F.transform(F.coalesce("current", F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")),
                         lambda c: stacked_row(0, {n: c[n] for n in names}))
    build = F.filter(
        F.array(stacked_row(1, {value_column(v): F.col(v) for v in values})), lambda _: F.col("history") > 0
    )
    rows = state.select(USER, SID, F.inline(F.concat(probes, build)))
    matched = asof_stacked(
        rows, [USER], SID, values, bucket_seconds, count_col="__history_rows", bucket_col=BUCKET if keep_bucket else None
    ).filter(F.col("__history_rows") > 0)
    return matched.select(
        USER, SID, *[F.coalesce(c, f"old_{c}").alias(c) for c in ("medium", "src")],
        *(["campaign"] if with_campaign else []), *([BUCKET] if keep_bucket else []),
    )


def traffic_report(
    events: DataFrame,
    start_date: str | None,
    end_date: str | None,
    era: str = "post",
    history_days: int = 90,
) -> DataFrame:
    """Sessions per medium after last-non-direct fill."""
    return sessions_by_medium(filled_sessions(events, start_date, end_date, era, history_days, keep_bucket=True))
