"""Unidentified users, ties, one first and one last touch per pool, open
bounds, parameters, plans and skew."""

import itertools
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import DAY, MIN, T0, ev, events_df
from touchline.functions.channels import SiteLists
from touchline.plans import attribution as A
from touchline.plans import sessions as S
from touchline.plans.lookback import lookback_window
from touchline.plans.sql_functions import register_sql_functions
from touchline.sources.export import read_export, shard_between, write_export

SITES = SiteLists(social=())
ALL = (None, None)


# --- unidentified users -----------------------------------------------------------
def null_users(gap):
    """Two unidentified visitors, `gap` apart: the later could take the earlier's
    source, page or touch only if NULL matched itself."""
    at = T0 // 1_000_000
    return [
        ev(None, T0, "session_start", sid=at, medium="email", source="news"),
        ev(None, T0, "click", sid=at, medium="email", source="news"),
        ev(None, T0, "page_view", sid=at, page="p"),
        ev(None, T0 + gap, "session_start", sid=(T0 + gap) // 1_000_000),
        ev(None, T0 + gap, "click", sid=(T0 + gap) // 1_000_000),
        ev(None, T0 + gap, "purchase", sid=(T0 + gap) // 1_000_000, revenue=1.0, txn="t"),
    ]


@pytest.mark.parametrize("gap", [5 * MIN, 3 * DAY])
@pytest.mark.parametrize("era", ["post", "pre"])
def test_null_users_match_nothing(spark, gap, era):
    e = events_df(spark, null_users(gap))
    assert S.filled_sessions(e, None, None, era).count() == 0
    assert S.traffic_report(e, None, None, era).count() == 0
    assert A.interactions(A.attribution_sessions(e, era), S.session_history_first(e)).count() == 0
    assert A.attribution_touchpoints(e, ALL, ALL, ALL, era).count() == 0
    assert lookback_window(e, 7).count() == 0
    register_sql_functions(spark, SITES, e)
    assert spark.sql("SELECT * FROM lookback_window(7, 'purchase')").count() == 0


# --- one first and one last touch per pool ----------------------------------------
def test_equal_rows_after_filling_are_two_touches(spark):
    sid = T0 // 1_000_000
    e = events_df(spark, [
        ev("u", T0, "session_start", sid=sid, medium="email"),
        ev("u", T0, "session_start", sid=sid),
        ev("u", T0, "click", sid=sid, medium="email"),
        ev("u", T0 + MIN, "purchase", sid=sid, revenue=10.0, txn="t"),
    ])
    tp = A.with_shares(A.attribution_touchpoints(e, ALL, ALL, ALL))
    rows = tp.collect()
    assert len(rows) == 2 and sum(r.is_first for r in rows) == 1 and sum(r.is_last for r in rows) == 1
    for share in ("linear_share", "position_share", "decay_share"):
        assert sum(r[share] for r in rows) == pytest.approx(1)
    pairs = A.attribution_pairs(e, ALL, ALL, ALL)
    for fn in (A.first_touch, A.last_touch, A.linear, A.position_based, A.time_decay):
        (r,) = fn(pairs).collect()
        assert r[1] == pytest.approx(10.0) and r[2] == pytest.approx(1)
    assert A.compare_models(pairs).collect() == A.compare_models_joined(pairs).collect()
    third = A.with_shares(A.with_pools(A.touch_pairs(
        A.conversions(e),
        A.interactions(A.attribution_sessions(e), S.session_history_first(e)).unionByName(
            spark.createDataFrame([("u", 5, "cpc", "cpc", T0 - DAY)], "user_pseudo_id string, ga_session_id long, medium string, raw_medium string, session_start_us long")
        ),
    )))
    assert sum(r.position_share for r in third.collect()) == pytest.approx(1)


def test_models_from_pools_equal_row_level_shares(spark):
    import random

    rnd = random.Random(4)
    conv = [(f"u{i % 5}", i, T0 + rnd.randrange(40) * DAY, rnd.choice([None, 1.5, 20.0]), rnd.choice([None, f"t{i % 7}"])) for i in range(25)]
    inter = [(f"u{i % 5}", i, T0 + rnd.randrange(40) * DAY, rnd.choice([None, "a", "b", "c"])) for i in range(80)]
    pairs = A.touch_pairs(
        spark.createDataFrame(conv, "user_pseudo_id string, ga_session_id bigint, conversion_us bigint, revenue double, transaction_id string"),
        spark.createDataFrame(inter, "user_pseudo_id string, ga_session_id bigint, session_start_us bigint, medium string"),
    )
    rows = A.with_shares(A.with_pools(pairs), (0.5, 0.3, 0.2))
    for name, fn in (("linear", A.linear), ("position", lambda p: A.position_based(p, (0.5, 0.3, 0.2))), ("decay", A.time_decay)):
        want = rows.groupBy("medium").agg(F.sum(F.col("revenue") * F.col(f"{name}_share")), F.sum(f"{name}_share"))
        got = {r[0]: tuple(r)[1:] for r in fn(pairs).collect()}
        for r in want.collect():
            assert got[r[0]] == (r[1] if r[1] is None else pytest.approx(r[1]), pytest.approx(r[2]))
    for fn, flag in ((A.first_touch, "is_first"), (A.last_touch, "is_last")):
        want = {r[0]: tuple(r)[1:] for r in rows.filter(flag).groupBy("medium").agg(F.sum("revenue"), F.count_distinct("transaction_id")).collect()}
        assert {r[0]: tuple(r)[1:] for r in fn(pairs).collect()} == want


# --- tied page views --------------------------------------------------------------
def test_tied_page_views_give_the_smallest_location(spark):
    pages = ("a", "b", "c")
    for order in itertools.permutations(pages):
        e = events_df(spark, [ev("u", T0, "page_view", page=p) for p in order] + [ev("u", T0 + MIN, "purchase", revenue=1.0, txn="t")])
        assert [r.first_page_location for r in lookback_window(e, 7).collect()] == ["a"]
        register_sql_functions(spark, SITES, e)
        assert [r.first_page_location for r in spark.sql("SELECT * FROM lookback_window(7, 'purchase')").collect()] == ["a"]


# --- bounds -----------------------------------------------------------------------
def test_no_bound_keeps_every_event(spark):
    e = events_df(spark, [ev("u", T0, "page_view", page="p")])
    odd = e.withColumn("event_date", F.lit("19990101")).unionByName(e.withColumn("event_date", F.lit(None).cast("string")))
    assert shard_between(odd, None, None).count() == 2
    assert shard_between(odd, None, "20000101").count() == 1
    assert shard_between(odd, "20000101", None).count() == 0
    register_sql_functions(spark, SITES, odd.unionByName(events_df(spark, [ev("u", T0 + MIN, "purchase", revenue=1.0, txn="t")])))
    assert spark.sql("SELECT * FROM lookback_window(7, 'purchase')").count() == 1


# --- parameters -------------------------------------------------------------------
def test_model_parameters_reach_the_report(spark):
    sid = T0 // 1_000_000
    rows = [ev("u", T0 + i * DAY, name, sid=sid + i, medium=m) for i, m in enumerate(("email", "organic", "cpc")) for name in ("session_start", "click")]
    e = events_df(spark, rows + [ev("u", T0 + 2 * DAY + MIN, "purchase", sid=sid + 2, revenue=100.0, txn="t")])
    report = lambda **kw: {r.medium: r for r in A.attribution_report(e, ALL, ALL, ALL, **kw).collect()}
    assert report() == {}
    every = report(keep_all_media=True)
    assert set(every) == {"email", "organic", "cpc"}
    assert every["email"].revenuePosition == pytest.approx(40) and every["organic"].revenueFirstTouch is None
    other = report(keep_all_media=True, position_weights=(0.6, 0.1, 0.3), half_life_days=1)
    assert [other[m].revenuePosition for m in ("email", "organic", "cpc")] == pytest.approx([60, 10, 30])
    assert other["cpc"].conversionsDecay > every["cpc"].conversionsDecay
    assert other["cpc"].conversionsDecay / other["organic"].conversionsDecay == pytest.approx(2, rel=1e-3)


# --- plans ------------------------------------------------------------------------
@pytest.fixture(scope="module")
def export(spark, scratch):
    """A month of events of 40 users and a bot with a third of all rows."""
    rows = []
    for i in range(900):
        user = "bot" if i % 3 == 0 else f"u{i % 40}"
        at = T0 + (i * 7919) % 29 * DAY + i * MIN
        sid = at // 1_000_000
        rows.append(ev(user, at, "session_start", sid=sid, medium=("email", None, "cpc")[i % 3]))
        rows.append(ev(user, at + MIN, "page_view", sid=sid, medium=("email", None, "cpc")[i % 3], page=f"p{i % 9}"))
        if i % 5 == 0:
            rows.append(ev(user, at + 2 * MIN, "purchase", sid=sid, revenue=1.0, txn="(not set)" if i % 2 else f"t{i}"))
    path = tempfile.mkdtemp(prefix="export-", dir=scratch) + "/events"
    write_export(events_df(spark, rows).coalesce(1), path)
    return read_export(spark, path)


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def scans(df):
    """Scans that run: a reused exchange stands for the subtree it names."""
    return len(re.findall(r"FileScan|Scan parquet", final_plan(df)))


@pytest.mark.parametrize("era", ["post", "pre"])
def test_filled_sessions_reads_each_input_once(spark, export, era):
    assert scans(S.filled_sessions(export, "20240310", "20240320", era, 9)) <= 2


def test_lookback_reads_each_input_once(spark, export):
    assert scans(lookback_window(export, 7, "purchase", ("20240310", "20240320"))) <= 2
    register_sql_functions(spark, SITES, export)
    assert scans(spark.sql("SELECT * FROM lookback_window(7, 'purchase', '20240310', '20240320')")) <= 2


def test_touchpoints_read_each_input_once(spark, export):
    dates = ("20240301", "20240331")
    assert scans(A.attribution_touchpoints(export, dates, dates, dates)) <= 3
    assert scans(A.compare_models(A.attribution_pairs(export, dates, dates, dates))) <= 3
    assert scans(A.linear(A.attribution_pairs(export, dates, dates, dates))) <= 3


def test_lookback_prunes_both_sides(spark, export):
    days = ("20240310", "20240311")
    for df in (
        lookback_window(export, 7, "purchase", days),
        (register_sql_functions(spark, SITES, export), spark.sql("SELECT * FROM lookback_window(7, 'purchase', '20240310', '20240311')"))[1],
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
        assert len(filters) >= 2
        assert all(("20240310" in f and "20240311" in f) or ("20240302" in f and "20240312" in f) for f in filters), filters


def test_no_task_holds_the_hot_user(spark, export):
    """The bot's rows are dealt out by day, so no partition of the stacked
    exchange holds them all."""
    from touchline.operators.asof import bucket_of

    day = bucket_of(F.col("event_timestamp"), DAY)
    bot = export.where("user_pseudo_id = 'bot'")
    most = bot.groupBy("user_pseudo_id", day).count().agg(F.max("count")).first()[0]
    assert most < bot.count() / 10


def test_placeholder_transaction_is_split(spark, export):
    """A placeholder id with most touchpoints: the join back is split by AQE, or
    never needed (the models reduce each pool to one row a medium first)."""
    dates = ("20240301", "20240331")
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        pairs = A.attribution_pairs(export, dates, dates, dates)
        assert "skew=true" in final_plan(A.with_pools(pairs))
        credits = A.pool_credits(pairs).where("transaction_id = '(not set)'")
        assert credits.count() <= 3
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
