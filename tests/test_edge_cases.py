"""Hand-built rows with hand-computed answers (FIXTURES.md section D)."""

import pytest

from helpers import DAY, MIN, T0, ev, events_df
from touchline.plans import attribution as A
from touchline.plans import sessions as S
from touchline.plans.lookback import first_page_in_window, converters, page_views

CONV = "user_pseudo_id string, ga_session_id bigint, conversion_us bigint, revenue double, transaction_id string"
INTER = "user_pseudo_id string, ga_session_id bigint, session_start_us bigint, medium string"


def _tp(spark, conv_rows, inter_rows, days=30):
    conv = spark.createDataFrame(conv_rows, CONV)
    inter = spark.createDataFrame(inter_rows, INTER)
    return A.with_shares(A.touchpoints(conv, inter, days))


def _d1(spark):
    return _tp(
        spark,
        [("u", 9, T0, 100.0, "t1")],
        [("u", 1, T0 - 10 * DAY, "email"), ("u", 2, T0 - 3 * DAY, "organic"), ("u", 3, T0, "cpc")],
    )


def test_d1_shares(spark):
    rows = {r.medium: r for r in _d1(spark).collect()}
    for m in rows:
        assert rows[m].linear_share == pytest.approx(1 / 3)
    assert [rows[m].position_share for m in ("email", "organic", "cpc")] == pytest.approx([0.4, 0.2, 0.4])
    assert [rows[m].decay_share for m in ("email", "organic", "cpc")] == pytest.approx(
        [0.175691, 0.351383, 0.472926], abs=1e-6)
    assert rows["email"].is_first and rows["cpc"].is_last
    lin = {r.medium: r.revenueLinear for r in A.linear(_d1(spark)).collect()}
    assert lin["organic"] == pytest.approx(33.3333, abs=1e-3)


def test_d2_comparison_needs_first_and_last(spark):
    assert A.compare_models(_d1(spark)).count() == 0
    assert A.compare_models_joined(_d1(spark)).count() == 0


def test_d3_one_and_two_touches(spark):
    one = _tp(spark, [("u", 9, T0, 10.0, "t")], [("u", 1, T0 - DAY, "a")]).collect()
    assert [r.position_share for r in one] == [1.0]
    two = _tp(spark, [("u", 9, T0, 10.0, "t")], [("u", 1, T0 - DAY, "a"), ("u", 2, T0 - 2 * DAY, "b")]).collect()
    assert sorted(r.position_share for r in two) == [0.5, 0.5]


def test_d4_window_bounds(spark):
    rows = _tp(
        spark,
        [("u", 9, T0, 10.0, "t")],
        [("u", 1, T0 - 30 * DAY, "out"), ("u", 2, T0 - 30 * DAY + 1, "in1"), ("u", 3, T0, "in2")],
    ).collect()
    assert sorted(r.medium for r in rows) == ["in1", "in2"]


def test_d5_whole_minutes(spark):
    rows = _tp(spark, [("u", 9, T0, 10.0, "t")], [("u", 1, T0 - 59_000_000, "a")]).collect()
    assert rows[0].decay_weight == 1.0


def _fill(spark, rows, era="post"):
    e = events_df(spark, rows)
    cur = S.current_sessions(e, era)
    hist = S.session_history_last_nonnull(e, exclude_system=(era == "pre"))
    return {(r.ga_session_id): (r.medium, r.src) for r in S.last_non_direct(cur, hist).collect()}


def test_d6_d7_d8_fill(spark):
    base = [ev("u", T0, "session_start", sid=100, medium="email", source="news")]
    assert _fill(spark, base + [ev("u", T0 + DAY, "session_start", sid=200)])[200] == ("email", "news")
    assert _fill(spark, base + [ev("u", T0 + DAY, "session_start", sid=300, gclid="g1")])[300] == ("cpc", "news")
    d8 = [
        ev("u", T0, "session_start", sid=100, medium="email"),
        ev("u", T0 + DAY, "session_start", sid=150, source="ads"),
        ev("u", T0 + 2 * DAY, "session_start", sid=200),
    ]
    assert _fill(spark, d8)[200] == ("email", "ads")


def test_d9_session_fills_from_its_own_later_event(spark):
    rows = [ev("u", T0, "session_start", sid=100), ev("u", T0 + MIN, "click", sid=100, medium="organic")]
    assert _fill(spark, rows)[100][0] == "organic"


def test_d10_pre_era_needs_interaction_events(spark):
    rows = [ev("u", T0, "session_start", sid=100, medium="email"), ev("u", T0 + 1, "first_visit", sid=100)]
    assert _fill(spark, rows, "pre") == {}


def test_d11_session_without_id_vanishes(spark):
    rows = [ev("u", T0, "session_start", medium="email"), ev("u", T0 + 1, "click", sid=5, medium="x")]
    assert _fill(spark, rows) == {}


def test_d12_conversion_grain(spark):
    e = events_df(spark, [
        ev("u", T0, "purchase", sid=1, revenue=10.0, txn="t9"),
        ev("u", T0 + MIN, "purchase", sid=1, revenue=5.0, txn="t10"),
    ])
    r = A.conversions(e).collect()
    assert len(r) == 1 and r[0].revenue == 15.0 and r[0].transaction_id == "t9" and r[0].conversion_us == T0


def test_d13_session_counted_under_each_medium(spark):
    e = events_df(spark, [
        ev("u", T0, "session_start", sid=1, medium="email"),
        ev("u", T0 + MIN, "session_start", sid=1, medium="cpc"),
    ])
    cur = S.current_sessions(e, "post")
    rep = S.sessions_by_medium(S.last_non_direct(cur, S.session_history_last_nonnull(e, False)))
    assert {r.medium: r.sessions for r in rep.collect()} == {"email": 1, "cpc": 1}


def _lookback(spark, rows, days=7):
    e = events_df(spark, rows)
    return first_page_in_window(converters(e), page_views(e), days).collect()


def test_d14_first_page_in_window(spark):
    rows = [ev("u", T0, "purchase", revenue=1.0, txn="t")] + [
        ev("u", T0 + d, "page_view", page=f"p{i}")
        for i, d in enumerate((-8 * DAY, -7 * DAY, -DAY, 1_000_000))
    ]
    out = _lookback(spark, rows)
    assert len(out) == 1 and out[0].first_page_location == "p1"


def test_d15_no_page_no_row(spark):
    rows = [ev("u", T0, "purchase", revenue=1.0, txn="t"), ev("u", T0 - 8 * DAY, "page_view", page="p")]
    assert _lookback(spark, rows) == []


def test_d16_null_transaction_ids_pool(spark):
    rows = _tp(
        spark,
        [("u", 1, T0, 10.0, None), ("v", 2, T0, 20.0, None)],
        [("u", 1, T0 - DAY, "a"), ("v", 2, T0 - 2 * DAY, "b")],
    ).collect()
    assert {r.total_interactions for r in rows} == {2}
    assert sum(r.is_first for r in rows) == 1 and sum(r.is_last for r in rows) == 1
    assert sum(r.decay_share for r in rows) == pytest.approx(1.0)


def test_d17_null_medium(spark):
    tp = _tp(spark, [("u", 9, T0, 10.0, "t")], [("u", 1, T0 - DAY, None)])
    assert [r.medium for r in A.first_touch(tp).collect()] == [None]
    assert A.compare_models(tp).count() == 0
