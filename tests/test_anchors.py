"""Regression anchors on the derived fixture (FIXTURES.md section C)."""

from conftest import SF_MID, SF_SMALL
from touchline.plans import attribution as A
from touchline.plans.lookback import lookback_window
from touchline.plans.sessions import traffic_report
from touchline.sources import read_test_events


def _report(spark, sf, era):
    ev = read_test_events(spark, sf)
    return {r.medium: r.sessions for r in traffic_report(ev, "20240120", "20240130", era).collect()}


def test_sessions_by_medium_post(spark):
    assert _report(spark, SF_SMALL, "post") == {
        "referral": 14, "social": 11, "email": 9, None: 9, "cpc": 8, "organic": 8}
    assert _report(spark, SF_MID, "post") == {
        "cpc": 158, "email": 117, "referral": 110, "social": 110, "organic": 98, None: 56}


def test_sessions_by_medium_pre(spark):
    assert _report(spark, SF_SMALL, "pre") == {
        "cpc": 28, "referral": 23, "social": 22, "email": 15, None: 13, "organic": 12}
    assert _report(spark, SF_MID, "pre") == {
        "cpc": 273, "organic": 211, "referral": 209, "social": 209, "email": 189, None: 114}


def test_touchpoints_and_models(spark):
    for sf, n in ((SF_SMALL, 191), (SF_MID, 2160)):
        ev = read_test_events(spark, sf)
        tp = A.attribution_touchpoints(
            ev, ("20240124", "20240130"), ("20240101", "20240130"), ("20240101", "20240130"), "post", 14)
        assert tp.count() == n
        assert A.compare_models(tp).count() == 5


def test_lookback_counts(spark):
    for sf, d7, d14 in ((SF_SMALL, 6, 7), (SF_MID, 56, 57)):
        ev = read_test_events(spark, sf)
        day = ("20240118", "20240118")
        month = ("20240101", "20240131")
        assert lookback_window(ev, 7, "purchase", day, month).count() == d7
        assert lookback_window(ev, 14, "purchase", day, month).count() == d14
