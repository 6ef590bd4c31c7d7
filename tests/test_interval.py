"""The interval aggregate against all pairs, and the models of a heavy user."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import DAY, MIN, T0
from touchline.operators.interval import covering_blocks, interval_parts
from touchline.plans import attribution as A

CONV = "user_pseudo_id string, ga_session_id bigint, conversion_us bigint, revenue double, transaction_id string"
INTER = "user_pseudo_id string, ga_session_id bigint, session_start_us bigint, medium string, raw_medium string"


def test_blocks_cover_a_range_once(spark):
    rnd = random.Random(2)
    rows = [(-5, 9), (0, 0), (3, 2), (7, 8), (0, 4096), (1, 4098)] + [(a := rnd.randrange(-3000, 3000), a + rnd.randrange(4098)) for _ in range(60)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "low long, high long")
    found = {r: [] for r in rows}
    for r in covering_blocks(df, F.col("low"), F.col("high"), 12).collect():
        found[r.low, r.high].append((r["__level"], r["__block"]))
    for (low, high), blocks in found.items():
        got = [x for level, b in blocks if level >= 0 for x in range(b << level, (b + 1) << level)]
        assert sorted(got) == list(range(low + 1, high)) and len(got) <= 4098 and len(blocks) <= 28
        assert sorted(b for level, b in blocks if level < 0) == sorted({low, high})


@pytest.mark.parametrize("levels,half_life", [(0, 60.0), (3, 10080.0), (12, 10080.0), (12, 0.01)])
def test_parts_equal_all_pairs(spark, levels, half_life):
    rnd = random.Random(levels)
    span = 2 * DAY
    at = lambda: rnd.choice([T0 + rnd.randrange(8 * DAY), T0 + rnd.randrange(200) * MIN, -rnd.randrange(3 * DAY)])
    points = [(rnd.choice(["a", "b", None]), at(), rnd.choice(["x", "y", None]), i) for i in range(150)]
    probes = [(rnd.choice(["a", "b", None]), at(), i) for i in range(60)]
    probes += [(u, t + d, 100 + i) for i, (u, t, _, _) in enumerate(points[:40]) for d in (0, 1, span, span - 1, MIN)]
    got = interval_parts(
        spark.createDataFrame(probes, "u string, at long, id long"), spark.createDataFrame(points, "u string, t long, k string, p long"),
        "u", "at", "t", span, "k", ("p",), half_life, levels,
    )
    got = got.groupBy("u", "at", "id", "k").agg(F.sum("n"), F.sum("weight"), F.min("first"), F.max("last"))
    got = {tuple(r)[:4]: (r[4], r[5], tuple(r[6]), tuple(r[7])) for r in got.collect()}
    want = {}
    for u, c, i in probes:
        for v, t, k, p in points:
            if u is not None and u == v and c - span < t <= c:
                want.setdefault((u, c, i, k), []).append(((t, p), 0.5 ** ((c - t) // MIN / half_life)))
    assert set(got) == set(want)
    for key, pairs in want.items():
        n, w, first, last = got[key]
        assert (n, first, last) == (len(pairs), min(p for p, _ in pairs), max(p for p, _ in pairs))
        assert w == pytest.approx(sum(x for _, x in pairs), rel=1e-9, abs=1e-300)


def tables(spark, conversions, sessions, users):
    rnd = random.Random(11)
    conv = [
        (rnd.choice(users), i, T0 + rnd.randrange(40 * DAY), rnd.choice([None, 1.5, 20.25]), rnd.choice([None, "(not set)", f"t{i % 50}"]))
        for i in range(conversions)
    ]
    inter = []
    for i in range(sessions):
        m = rnd.choice([None, "a", "b", "c"])
        inter.append((rnd.choice(users), i, T0 + rnd.randrange(40 * DAY), m, rnd.choice([m, None])))
    return spark.createDataFrame(conv, CONV), spark.createDataFrame(inter, INTER)


def rounded(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("light", [0, 12, 10_000])
def test_models_are_the_same_from_pairs_and_from_blocks(spark, light):
    conv, inter = tables(spark, 120, 400, ["u1", "u2", "u2", "u2", "u3", None])
    want = rounded(A.pool_credits(A.touch_pairs(conv, inter, 9, 3.0)))
    assert rounded(A.pool_credits(A.touch_parts(conv, inter, 9, 3.0, light=light))) == want
    parts = A.touch_parts(conv, inter, 9, light=light)
    assert rounded(A.compare_models(parts)) == rounded(A.compare_models_joined(A.touch_pairs(conv, inter, 9)))


def test_a_user_of_very_many_sessions_and_conversions(spark):
    """100,000 of each would be 3.5e9 pairs in a window of 14 days."""
    n = 100_000
    time = lambda seed: (F.lit(T0) + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(40 * DAY))).alias
    ids = spark.range(n)
    user = F.lit("bot").alias("user_pseudo_id")
    conv = ids.select(user, F.col("id").alias("ga_session_id"), time(1)("conversion_us"), F.lit(2.0).alias("revenue"), F.lit(None).cast("string").alias("transaction_id"))
    inter = ids.select(user, F.col("id").alias("ga_session_id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("medium"), time(2)("session_start_us"))
    rows = A.pool_credits(A.touch_parts(conv, inter, 14)).collect()
    assert len(rows) == 3
    assert sum(r.linear_conversions for r in rows) == pytest.approx(1) and sum(r.decay_conversions for r in rows) == pytest.approx(1)
    c, i = (sorted(r[0] for r in df.collect()) for df in (conv.select("conversion_us"), inter.select("session_start_us")))
    import numpy as np
    c, i = np.array(c), np.array(i)
    pairs = int((np.searchsorted(i, c, "right") - np.searchsorted(i, c - 14 * DAY, "right")).sum())
    parts = A.touch_parts(conv, inter, 14)
    total = parts.agg(F.sum("n"), F.count(F.lit(1)), F.sum("w")).first()
    assert total[0] == pairs and total[1] < 50 * n
    # the weights of some conversions, from their single sessions
    some = A.touch_parts(conv.where("ga_session_id < 20"), inter, 14).agg(F.sum("w")).first()[0]
    blocks = A.touch_parts(conv.where("ga_session_id < 20"), inter, 14, light=5).agg(F.sum("w")).first()[0]
    assert blocks == pytest.approx(some, rel=1e-9)
