"""Conversions, interactions, touchpoints and five rule-based attribution
models (first touch, last touch, linear, position based, time decay).

Semantics kept from the original analysis:
  * a conversion is one (user, session) with purchases in the window: first
    purchase time, summed revenue, lexically largest transaction id;
  * interactions are the user's sessions with their medium (NULL filled from
    the latest earlier session with one) and their first event time;
  * a touchpoint is an interaction in (conversion - window, conversion];
    conversions without one vanish;
  * credit is shared per transaction id: every conversion with the same id
    (NULL ids included) forms one pool for counts, order and decay totals;
  * decay halves every 7 days of whole minutes before the conversion;
  * position: 1 touch -> 1; 2 -> 1/2 each; more -> 0.4 first, 0.4 last, 0.2
    shared by the rest;
  * first/last "conversions" count distinct transaction ids, the others sum
    shares;
  * the comparison keeps a medium only if it is some pool's first touch and
    some pool's last touch (the original inner-joins the five tables), and
    never a NULL medium.

Scale notes: the models reduce touchpoints to one row per (transaction id,
medium) first (map-side partial aggregation); pool totals, first and last touch
come from a window over those few rows of each id. Touchpoints are read once,
and a pool that holds a third of them is a partial aggregate, never one task.
The row-level `touchpoints` relation joins the pool statistics back on the id;
there the NULL pool is spread over salted copies of its one row, and AQE splits
other large ids. The range join of conversions and interactions is bucketed by
the window's length: a conversion meets two buckets. The models use it for users
of at most LIGHT conversions, so that an interaction meets no more than these;
for heavier users they take each window's sums from pre-summed blocks of time
(touchline.operators.interval), without pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions.params import session_id
from touchline.functions.timefn import whole_minutes_between
from touchline.operators.asof import IS_BUILD, asof_stacked, bucket_of, value_column
from touchline.operators.interval import interval_parts
from touchline.plans.sessions import (
    ERAS,
    SID,
    USER,
    interaction_events,
    last_non_direct,
    session_history_first,
)
from touchline.schema import MICROS_PER_DAY, SECONDS_PER_DAY, SYSTEM_EVENTS
from touchline.sources.export import shard_between

HALF_LIFE_DAYS = 7.0
MINUTES_PER_DAY = 24 * 60
POSITION_WEIGHTS = (0.4, 0.2, 0.4)
NULL_POOL_SALTS = 64
LIGHT = 256  # conversions of a user whose touchpoints are made as pairs
PART_COLUMNS = ("transaction_id", "medium", "n", "rev", "w", "rev_w", "lo", "hi")

MODEL_COLUMNS = (
    "medium",
    "revenueFirstTouch",
    "conversionsFirstTouch",
    "revenueLastTouch",
    "conversionsLastTouch",
    "revenueLinear",
    "conversionsLinear",
    "revenuePosition",
    "conversionsPosition",
    "revenueDecay",
    "conversionsDecay",
)


def conversions(events: DataFrame, conversion_event: str = "purchase") -> DataFrame:
    """(user_pseudo_id, ga_session_id, conversion_us, revenue, transaction_id)."""
    return (
        events.filter(F.col("event_name") == conversion_event)
        .groupBy(USER, session_id().alias(SID))
        .agg(
            F.min("event_timestamp").alias("conversion_us"),
            F.sum("ecommerce.purchase_revenue").alias("revenue"),
            F.max("ecommerce.transaction_id").alias("transaction_id"),
        )
    )


def attribution_sessions(events: DataFrame, era: str = "post") -> DataFrame:
    """(user, session, medium, session_start_us) before filling.

    post: one row per (user, session, medium) of `session_start` events, with
          the earliest such event's time.
    pre:  the medium of the session's first interaction event and the time of
          its earliest interaction event.
    """
    if era not in ERAS:
        raise ValueError(f"era must be one of {ERAS}")
    medium = F.when(F.col("collected_traffic_source.gclid").isNotNull(), F.lit("cpc")).otherwise(
        F.col("collected_traffic_source.manual_medium")
    )
    if era == "post":
        return (
            events.filter(F.col("event_name") == "session_start")
            .groupBy(USER, session_id().alias(SID), medium.alias("medium"))
            .agg(F.min("event_timestamp").alias("session_start_us"))
        )
    return (
        interaction_events(events)
        .groupBy(USER, session_id().alias(SID))
        .agg(
            F.min(F.struct(F.col("event_timestamp"), medium.alias("m")))["m"].alias("medium"),
            F.min("event_timestamp").alias("session_start_us"),
        )
    )


def interactions(current: DataFrame, history: DataFrame) -> DataFrame:
    """Sessions with NULL medium filled from the latest earlier session
    (first-value history flavour); sessions without history vanish. The medium
    before filling stays as `raw_medium`: (user, session, raw medium) is the
    grain, and two rows of a session can be equal after filling."""
    return last_non_direct(current.withColumn("raw_medium", F.col("medium")), history, fill=("medium",))


def _order_key(rows: DataFrame) -> Column:
    # interaction time first (the original order), then fields that make the
    # order total so first/last are single rows and deterministic under ties;
    # revenue follows from the conversion and rides along
    raw = "raw_medium" if "raw_medium" in rows.columns else "medium"
    return F.struct(
        "interaction_us", USER, SID, "medium", F.col(raw).alias("raw"), "conversion_session_id", "conversion_us", "revenue"
    )


def touch_pairs(
    conv: DataFrame,
    inter: DataFrame,
    window_days: int = 30,
    half_life_days: float = HALF_LIFE_DAYS,
) -> DataFrame:
    """One row per (conversion, interaction of the same user in
    (conversion - window_days, conversion]): user_pseudo_id, ga_session_id,
    medium, raw_medium, interaction_us, conversion_session_id, conversion_us,
    revenue, transaction_id, decay_weight."""
    span = window_days * MICROS_PER_DAY
    width = max(span, MICROS_PER_DAY)
    c = conv.select(
        F.col(USER),
        F.col(SID).alias("conversion_session_id"),
        "conversion_us",
        "revenue",
        "transaction_id",
        F.explode(
            F.sequence(
                bucket_of(F.col("conversion_us") - F.lit(span), width),
                bucket_of(F.col("conversion_us"), width),
            )
        ).alias("__bucket"),
    )
    raw = "raw_medium" if "raw_medium" in inter.columns else "medium"
    i = inter.select(
        USER,
        SID,
        "medium",
        F.col(raw).alias("raw_medium"),
        F.col("session_start_us").alias("interaction_us"),
        bucket_of(F.col("session_start_us"), width).alias("__bucket"),
    )
    return (
        c.join(i, on=[USER, "__bucket"], how="inner")
        .filter(
            (F.col("interaction_us") <= F.col("conversion_us"))
            & (F.col("interaction_us") > F.col("conversion_us") - F.lit(span))
        )
        .drop("__bucket")
        .withColumn(
            "decay_weight",
            F.pow(
                F.lit(0.5),
                whole_minutes_between(F.col("conversion_us"), F.col("interaction_us"))
                / F.lit(half_life_days * MINUTES_PER_DAY),
            ),
        )
    )


def _pair_parts(pairs: DataFrame) -> DataFrame:
    """Touchpoints as rows of PART_COLUMNS."""
    key = _order_key(pairs)
    return pairs.select(
        "transaction_id",
        "medium",
        F.lit(1).cast("long").alias("n"),
        F.col("revenue").alias("rev"),
        F.col("decay_weight").alias("w"),
        (F.col("revenue") * F.col("decay_weight")).alias("rev_w"),
        key.alias("lo"),
        key.alias("hi"),
    )


def _block_parts(conv: DataFrame, inter: DataFrame, window_days: int, half_life_days: float) -> DataFrame:
    """The same from the sums of blocks of time, no row a touchpoint."""
    raw = "raw_medium" if "raw_medium" in inter.columns else "medium"
    points = inter.select(
        USER, "medium", F.col("session_start_us").alias("interaction_us"), SID, F.col(raw).alias("raw")
    )
    probes = conv.select(
        USER, F.col(SID).alias("conversion_session_id"), "conversion_us", "revenue", "transaction_id"
    )
    parts = interval_parts(
        probes, points, USER, "conversion_us", "interaction_us", window_days * MICROS_PER_DAY, "medium", (SID, "raw"),
        half_life_days * MINUTES_PER_DAY,
    )

    def key(point: str) -> Column:
        return F.struct(
            F.col(f"{point}.interaction_us").alias("interaction_us"), USER, F.col(f"{point}.{SID}").alias(SID), "medium",
            F.col(f"{point}.raw").alias("raw"), "conversion_session_id", "conversion_us", "revenue",
        )

    return parts.select(
        "transaction_id",
        "medium",
        "n",
        (F.col("revenue") * F.col("n")).alias("rev"),
        F.col("weight").alias("w"),
        (F.col("revenue") * F.col("weight")).alias("rev_w"),
        key("first").alias("lo"),
        key("last").alias("hi"),
    )


def touch_parts(
    conv: DataFrame,
    inter: DataFrame,
    window_days: int = 30,
    half_life_days: float = HALF_LIFE_DAYS,
    light: int = LIGHT,
) -> DataFrame:
    """What the models need of the touchpoints, as rows of PART_COLUMNS to be
    merged by (transaction_id, medium): numbers and sums add up, `lo` and `hi`
    are the first and the last touch. A user of more than `light` conversions
    gives rows of whole blocks of interactions, others one a touchpoint."""
    # the mark uses every column, so that all uses of `conv` share its exchange
    mark = F.max(F.xxhash64(*conv.columns))
    heavy = conv.groupBy(USER).agg(F.count(F.lit(1)).alias("__n"), mark.alias("__mark"))
    heavy = heavy.where((F.col("__n") > light) & F.col("__mark").isNotNull() & F.col(USER).isNotNull()).select(USER)
    pairs = touch_pairs(conv.join(heavy, USER, "left_anti"), inter, window_days, half_life_days)
    blocks = _block_parts(
        conv.join(heavy, USER, "left_semi"), inter.join(heavy, USER, "left_semi"), window_days, half_life_days
    )
    return _pair_parts(pairs).unionByName(blocks)


def with_pools(pairs: DataFrame) -> DataFrame:
    """Adds the statistics of each row's pool (rows of one transaction id):
    total_interactions, is_first, is_last, decay_total."""
    key = _order_key(pairs)
    pools = pairs.groupBy(F.col("transaction_id").alias("__tx")).agg(
        F.count(F.lit(1)).alias("total_interactions"),
        F.min(key).alias("__first"),
        F.max(key).alias("__last"),
        F.sum("decay_weight").alias("decay_total"),
    )
    salts = F.when(F.col("__tx").isNull(), F.sequence(F.lit(0), F.lit(NULL_POOL_SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    pools = pools.withColumn("__pool_salt", F.explode(salts))
    salt = F.when(
        F.col("transaction_id").isNull(),
        F.pmod(F.xxhash64(USER, SID, "conversion_us"), F.lit(NULL_POOL_SALTS)).cast("int"),
    ).otherwise(F.lit(0))
    joined = pairs.withColumn("__salt", salt).join(
        pools, F.col("transaction_id").eqNullSafe(F.col("__tx")) & (F.col("__salt") == F.col("__pool_salt")), "inner"
    )
    return joined.select(
        *pairs.columns,
        "total_interactions",
        (key == F.col("__first")).alias("is_first"),
        (key == F.col("__last")).alias("is_last"),
        "decay_total",
    )


def touchpoints(
    conv: DataFrame,
    inter: DataFrame,
    window_days: int = 30,
    half_life_days: float = HALF_LIFE_DAYS,
) -> DataFrame:
    """`touch_pairs` with the statistics of each row's pool:

    user_pseudo_id, ga_session_id, medium, interaction_us, conversion_session_id,
    conversion_us, revenue, transaction_id, total_interactions, is_first,
    is_last, decay_weight, decay_total.
    """
    return with_pools(touch_pairs(conv, inter, window_days, half_life_days)).select(
        USER,
        SID,
        "medium",
        "interaction_us",
        "conversion_session_id",
        "conversion_us",
        "revenue",
        "transaction_id",
        "total_interactions",
        "is_first",
        "is_last",
        "decay_weight",
        "decay_total",
    )


def with_shares(tp: DataFrame, position_weights: tuple[float, float, float] = POSITION_WEIGHTS) -> DataFrame:
    """Add linear_share, position_share and decay_share (each sums to 1 per pool)."""
    first_w, middle_w, last_w = (float(w) for w in position_weights)
    n = F.col("total_interactions")
    position = (
        F.when(n == 1, F.lit(1.0))
        .when(n == 2, F.lit(0.5))
        .when(F.col("is_first"), F.lit(first_w))
        .when(F.col("is_last"), F.lit(last_w))
        .otherwise(F.lit(middle_w) / (n - 2))
    )
    return tp.drop("linear_share", "position_share", "decay_share").select(
        "*",
        (F.lit(1.0) / n).alias("linear_share"),
        position.alias("position_share"),
        (F.col("decay_weight") / F.col("decay_total")).alias("decay_share"),
    )


def pool_credits(
    pairs: DataFrame, position_weights: tuple[float, float, float] = POSITION_WEIGHTS
) -> DataFrame:
    """Credit of each medium in each pool under the five models, one row per
    (transaction_id, medium): is_first, is_last, first_revenue, last_revenue and
    <model>_revenue, <model>_conversions for linear, position and decay.
    `pairs` are rows of `touch_parts`, `touch_pairs` or `touchpoints`."""
    first_w, middle_w, last_w = (float(w) for w in position_weights)
    parts = pairs if set(PART_COLUMNS) <= set(pairs.columns) else _pair_parts(pairs)
    parts = parts.groupBy("transaction_id", "medium").agg(
        *[F.sum(c).alias(c) for c in ("n", "rev", "w", "rev_w")], F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    pool = Window.partitionBy("transaction_id")  # one row a medium
    parts = parts.select(
        "*",
        F.sum("n").over(pool).alias("total"),
        F.sum("w").over(pool).alias("w_total"),
        (F.col("lo") == F.min("lo").over(pool)).alias("is_first"),
        (F.col("hi") == F.max("hi").over(pool)).alias("is_last"),
    )
    first, last = F.col("is_first").cast("int"), F.col("is_last").cast("int")
    first_rev = first * F.coalesce(F.col("lo.revenue"), F.lit(0.0))
    last_rev = last * F.coalesce(F.col("hi.revenue"), F.lit(0.0))
    n, total, rev = F.col("n"), F.col("total"), F.col("rev")
    middle = F.lit(middle_w) / (total - 2)

    def position(whole: Column, at_first: Column, at_last: Column) -> Column:
        rest = whole - at_first - at_last
        return (
            F.when(whole.isNull(), F.lit(None).cast("double"))
            .when(total == 1, whole.cast("double"))
            .when(total == 2, whole * 0.5)
            .otherwise(first_w * at_first + last_w * at_last + middle * rest)
        )

    return parts.select(
        "transaction_id",
        "medium",
        "is_first",
        "is_last",
        F.col("lo.revenue").alias("first_revenue"),
        F.col("hi.revenue").alias("last_revenue"),
        (rev / total).alias("linear_revenue"),
        (n / total).alias("linear_conversions"),
        position(rev, first_rev, last_rev).alias("position_revenue"),
        position(n, first, last).alias("position_conversions"),
        (F.col("rev_w") / F.col("w_total")).alias("decay_revenue"),
        (F.col("w") / F.col("w_total")).alias("decay_conversions"),
    )


def first_touch(tp: DataFrame) -> DataFrame:
    # a pool has one first row, so counting them counts transaction ids
    return (
        pool_credits(tp).filter("is_first")
        .groupBy("medium")
        .agg(
            F.sum("first_revenue").alias("revenueFirstTouch"),
            F.count("transaction_id").alias("conversionsFirstTouch"),
        )
    )


def last_touch(tp: DataFrame) -> DataFrame:
    return (
        pool_credits(tp).filter("is_last")
        .groupBy("medium")
        .agg(
            F.sum("last_revenue").alias("revenueLastTouch"),
            F.count("transaction_id").alias("conversionsLastTouch"),
        )
    )


def _share_model(credits: DataFrame, model: str) -> DataFrame:
    return credits.groupBy("medium").agg(
        F.sum(f"{model}_revenue").alias(f"revenue{model.title()}"),
        F.sum(f"{model}_conversions").alias(f"conversions{model.title()}"),
    )


def linear(tp: DataFrame) -> DataFrame:
    return _share_model(pool_credits(tp), "linear")


def position_based(
    tp: DataFrame, position_weights: tuple[float, float, float] = POSITION_WEIGHTS
) -> DataFrame:
    return _share_model(pool_credits(tp, position_weights), "position")


def time_decay(tp: DataFrame) -> DataFrame:
    return _share_model(pool_credits(tp), "decay")


def compare_models(
    tp: DataFrame,
    position_weights: tuple[float, float, float] = POSITION_WEIGHTS,
    keep_all_media: bool = False,
) -> DataFrame:
    """All five models in one aggregation over the pools' credits instead of
    five aggregations joined. keep_all_media keeps the media (NULL too) that the
    original's inner joins lose."""
    tx, first, last = F.col("transaction_id"), F.col("is_first"), F.col("is_last")
    agg = pool_credits(tp, position_weights).groupBy("medium").agg(
        F.sum(F.when(first, F.col("first_revenue"))).alias("revenueFirstTouch"),
        F.count(F.when(first, tx)).alias("conversionsFirstTouch"),
        F.sum(F.when(last, F.col("last_revenue"))).alias("revenueLastTouch"),
        F.count(F.when(last, tx)).alias("conversionsLastTouch"),
        F.sum("linear_revenue").alias("revenueLinear"),
        F.sum("linear_conversions").alias("conversionsLinear"),
        F.sum("position_revenue").alias("revenuePosition"),
        F.sum("position_conversions").alias("conversionsPosition"),
        F.sum("decay_revenue").alias("revenueDecay"),
        F.sum("decay_conversions").alias("conversionsDecay"),
        F.count_if(first).alias("__firsts"),
        F.count_if(last).alias("__lasts"),
    )
    if not keep_all_media:
        agg = agg.filter(F.col("medium").isNotNull() & (F.col("__firsts") > 0) & (F.col("__lasts") > 0))
    return agg.select(*MODEL_COLUMNS)


def compare_models_joined(tp: DataFrame) -> DataFrame:
    """The textbook form: five aggregates inner-joined on medium (used to
    check `compare_models`)."""
    out = first_touch(tp)
    for part in (last_touch(tp), linear(tp), position_based(tp), time_decay(tp)):
        out = out.join(part, on="medium", how="inner")
    return out.select(*MODEL_COLUMNS)


Dates = tuple[str | None, str | None]


def _hull(*dates: Dates) -> Dates:
    """The smallest range that holds all of them."""
    starts, ends = zip(*dates)
    return (None if None in starts else min(starts)), (None if None in ends else max(ends))


def _within(dates: Dates) -> Column:
    start, end = dates
    day, inside = F.col("event_date"), F.lit(True)
    if start is not None:
        inside = inside & (day >= F.lit(start))
    if end is not None:
        inside = inside & (day <= F.lit(end))
    return F.coalesce(inside, F.lit(False))


def attribution_state(
    events: DataFrame,
    conversion_dates: Dates,
    session_dates: Dates,
    history_dates: Dates,
    era: str = "post",
    conversion_event: str = "purchase",
) -> DataFrame:
    """What `conversions`, `attribution_sessions` and `session_history_first` tell,
    from one pass over the events: rows of (user, session) and, in era "post",
    the medium of its `session_start` events. A user's other events are one row a
    session, so conversions and history stand on one row each."""
    ts, name = F.col("event_timestamp"), F.col("event_name")
    touch = F.coalesce(~name.isin(*SYSTEM_EVENTS), F.lit(False))
    m, g = F.col("m"), F.col("g")
    medium = F.when(g.isNotNull(), F.lit("cpc")).otherwise(m)
    ev = shard_between(events, *_hull(conversion_dates, session_dates, history_dates)).select(
        USER, session_id().alias(SID), ts, F.col("collected_traffic_source.manual_medium").alias("m"),
        F.col("collected_traffic_source.gclid").alias("g"), F.col("ecommerce.purchase_revenue").alias("value"),
        F.col("ecommerce.transaction_id").alias("tx"),
        F.coalesce((name == conversion_event) & _within(conversion_dates), F.lit(False)).alias("is_conversion"),
        (touch & _within(history_dates)).alias("is_past"),
        F.coalesce((name == "session_start" if era == "post" else touch) & _within(session_dates), F.lit(False)).alias("is_current"),
    ).filter(F.col(USER).isNotNull() & (F.col("is_conversion") | F.col("is_past") | F.col("is_current")))
    current, past, converts = F.col("is_current"), F.col("is_past"), F.col("is_conversion")
    keys, first = [], F.min(F.when(current, F.struct(ts, medium.alias("m"))))["m"]
    if era == "post":
        ev = ev.withColumn("start_medium", F.when(current, medium)).withColumn("is_start", current)
        keys, first = ["is_start", "start_medium"], F.col("start_medium")
    return ev.groupBy(USER, SID, *keys).agg(
        first.alias("raw_medium"),
        F.min(F.when(current, ts)).alias("session_start_us"),
        F.min(F.when(past, F.struct(ts, m, g))).alias("past"),
        F.min(F.when(converts, ts)).alias("conversion_us"),
        F.sum(F.when(converts, F.col("value"))).alias("revenue"),
        F.max(F.when(converts, F.col("tx"))).alias("transaction_id"),
    ).select(
        USER, SID, "raw_medium", "session_start_us", "conversion_us", "revenue", "transaction_id",
        F.col("past").isNotNull().alias("has_past"),
        F.when(F.col("past.g").isNotNull(), F.lit("cpc")).otherwise(F.col("past.m")).alias("old_medium"),
    )


def attribution_inputs(
    events: DataFrame,
    conversion_dates: Dates,
    session_dates: Dates,
    history_dates: Dates,
    era: str = "post",
    conversion_event: str = "purchase",
) -> tuple[DataFrame, DataFrame]:
    """(conversions, interactions) of an export; a date of None is no bound.
    Users without id, who match nothing, are left out."""
    if era not in ERAS:
        raise ValueError(f"era must be one of {ERAS}")
    if conversion_event in SYSTEM_EVENTS:  # these stand on several rows of the state
        current = attribution_sessions(shard_between(events, *session_dates), era)
        history = session_history_first(shard_between(events, *history_dates))
        return conversions(shard_between(events, *conversion_dates), conversion_event), interactions(current, history)
    state = attribution_state(events, conversion_dates, session_dates, history_dates, era, conversion_event)
    # always true, but it needs every column: so no use of the state is pruned,
    # and all of them share its exchange
    state = state.where(F.pmod(F.xxhash64(*state.columns), F.lit(2)) < 2)
    conv = state.where(F.col("conversion_us").isNotNull()).select(USER, SID, "conversion_us", "revenue", "transaction_id")
    string, number = F.lit(None).cast("string"), F.lit(None).cast("long")

    def row(is_build: int, medium: Column, at: Column, old: Column) -> Column:
        return F.struct(
            F.lit(is_build).alias(IS_BUILD), medium.alias("medium"), at.alias("session_start_us"),
            old.alias(value_column("old_medium")),
        )

    here = F.col(SID).isNotNull()
    probe = F.when(here & F.col("session_start_us").isNotNull(), row(0, F.col("raw_medium"), F.col("session_start_us"), string))
    build = F.when(here & F.col("has_past"), row(1, string, number, F.col("old_medium")))
    rows = state.select(USER, SID, F.explode(F.array(probe, build)).alias("r")).where("r IS NOT NULL").select(USER, SID, "r.*")
    found = asof_stacked(rows, [USER], SID, ["old_medium"], SECONDS_PER_DAY, count_col="__history_rows")
    inter = found.filter(F.col("__history_rows") > 0).select(
        USER, SID, F.coalesce("medium", "old_medium").alias("medium"), "session_start_us", F.col("medium").alias("raw_medium")
    )
    return conv, inter


def attribution_pairs(
    events: DataFrame,
    conversion_dates: Dates,
    session_dates: Dates,
    history_dates: Dates,
    era: str = "post",
    window_days: int = 30,
    conversion_event: str = "purchase",
    half_life_days: float = HALF_LIFE_DAYS,
) -> DataFrame:
    """`touch_pairs` of an export."""
    conv, inter = attribution_inputs(events, conversion_dates, session_dates, history_dates, era, conversion_event)
    return touch_pairs(conv, inter, window_days, half_life_days)


def attribution_parts(
    events: DataFrame,
    conversion_dates: Dates,
    session_dates: Dates,
    history_dates: Dates,
    era: str = "post",
    window_days: int = 30,
    conversion_event: str = "purchase",
    half_life_days: float = HALF_LIFE_DAYS,
) -> DataFrame:
    """`touch_parts` of an export: what the models take."""
    conv, inter = attribution_inputs(events, conversion_dates, session_dates, history_dates, era, conversion_event)
    return touch_parts(conv, inter, window_days, half_life_days)


def attribution_touchpoints(
    events: DataFrame,
    conversion_dates: Dates,
    session_dates: Dates,
    history_dates: Dates,
    era: str = "post",
    window_days: int = 30,
    conversion_event: str = "purchase",
    half_life_days: float = HALF_LIFE_DAYS,
) -> DataFrame:
    pairs = attribution_pairs(
        events, conversion_dates, session_dates, history_dates, era, window_days, conversion_event, half_life_days
    )
    return with_pools(pairs).drop("raw_medium")


def attribution_report(
    events: DataFrame,
    conversion_dates: Dates,
    session_dates: Dates,
    history_dates: Dates,
    era: str = "post",
    window_days: int = 30,
    conversion_event: str = "purchase",
    half_life_days: float = HALF_LIFE_DAYS,
    position_weights: tuple[float, float, float] = POSITION_WEIGHTS,
    keep_all_media: bool = False,
) -> DataFrame:
    """The five-model comparison per medium."""
    parts = attribution_parts(
        events, conversion_dates, session_dates, history_dates, era, window_days, conversion_event, half_life_days
    )
    return compare_models(parts, position_weights, keep_all_media)
