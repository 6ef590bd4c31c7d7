"""Attribution invariants on the fixture: shares sum to 1 per pool, every
model credits the full converted revenue, one pass equals five joins."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from touchline.plans import attribution as A
from touchline.sources import read_test_events

ALL = ("20240101", "20240131")


@pytest.fixture(scope="module")
def tp(spark):
    ev = read_test_events(spark, SF_SMALL)
    return A.attribution_touchpoints(ev, ALL, ALL, ALL, "post", 14)


def test_shares_sum_to_one(tp):
    s = A.with_shares(tp).groupBy("transaction_id").agg(
        F.sum("linear_share").alias("l"), F.sum("position_share").alias("p"), F.sum("decay_share").alias("d"),
        F.count_if("is_first").alias("f"), F.count_if("is_last").alias("z"))
    for r in s.collect():
        assert r.l == pytest.approx(1) and r.p == pytest.approx(1) and r.d == pytest.approx(1)
        assert r.f == 1 and r.z == 1


def test_models_credit_all_revenue(tp):
    pools = tp.groupBy("transaction_id").agg(F.first("revenue").alias("r")).agg(F.sum("r")).first()[0]
    for fn, col in ((A.first_touch, "revenueFirstTouch"), (A.last_touch, "revenueLastTouch"),
                    (A.linear, "revenueLinear"), (A.position_based, "revenuePosition"),
                    (A.time_decay, "revenueDecay")):
        assert fn(tp).agg(F.sum(col)).first()[0] == pytest.approx(pools)


def test_one_pass_equals_joined(tp):
    a = sorted(A.compare_models(tp).collect())
    b = sorted(A.compare_models_joined(tp).collect())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x.medium == y.medium
        assert list(x[1:]) == pytest.approx(list(y[1:]))
