"""Operator 8: mixing sources to target weights by entropy balancing.

Size of a document: its number of words. A source's target is its share of
`ratio` times all words by weight (the weights repeat over the sources in code
point order, null last), but at most `cap` times the source's own words; the
excess is shared again by weight until no target is above its cap.

Rates solve: least relative entropy to one copy of each document, such that
sum(rate * size) is the source's target, with 0 <= rate <= cap. The solution is
rate = min(cap, exp(lambda * size / mean size)) with one dual variable a
source, found by bracketed Newton steps. A step is one aggregate over the
staged (source, size) histogram for all sources at once; documents are not
read again. A source that holds a third of all rows is a partial aggregate.

Rates become whole copies, floor(rate) or one more: a document gets one more
if u - frac(rate) is below a threshold of its source, u being a hash of its id
and text, and of its number among rows that repeat both (counted in two levels, so
that rows of one id and text are never in one task). The threshold is where the source's words meet its target, found by
refining histograms of that margin (bins of bins), so that a source misses its
target by about one document's size at most and reruns agree.

Cases: null text has size 0; a null source is a source of its own, last in
order; documents of size 0 are taken as they are rated and add no words; rows
that repeat, null ids included, each count and are rounded one by one (which of
them gets a copy more is arbitrary, how many is not); very long texts are only
counted; a source without words has target 0; an empty table gives an empty
result; other columns are ignored. A dual that does not converge is an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from touchline.llm.common import staged, text_or_empty, word_count

BINS = 1024
MAX_NEWTON = 60
TOLERANCE = 1e-9


def _ranked(sources: DataFrame) -> DataFrame:
    """A rank for each source in code point order, null last, without pulling
    the sources into one task (a sort and a count per partition)."""
    spark = sources.sparkSession
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    rows = ordered.rdd.zipWithIndex().map(lambda p: (*p[0], p[1]))
    schema = T.StructType([*sources.schema.fields, T.StructField("rank", T.LongType())])
    return spark.createDataFrame(rows, schema)


def source_targets(sources: DataFrame, weights: Sequence[float], ratio: float, cap: float) -> DataFrame:
    """Adds `target` to (source, source_size, docs)."""
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = staged(_ranked(sources).withColumn("weight", pick), "mix-sources")
    most = F.col("source_size") * F.lit(float(cap))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"] * float(ratio)
    # share(s) = level * weight(s); whoever is above the cap is held there, and
    # the rest share what is left, until nobody is above
    level = 0.0
    while True:
        held = (F.lit(level) * F.col("weight") >= most) & F.lit(level > 0)
        got = ranked.agg(
            F.coalesce(F.sum(F.when(held, most)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        new = (total - got["capped"]) / got["weight"] if got["weight"] else level
        if new <= level * (1 + 1e-15) or not got["weight"]:
            break
        level = new
    return ranked.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def _solve(hist: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """(source, lam): the dual variable of each source. Newton with a bracket;
    `hist` is (source, size, docs)."""
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("docs")).otherwise(F.lit(1.0))
    full = F.col("target") >= F.col("source_size") * F.lit(cap) * (1 - 1e-12)
    state = staged(
        sources.select(
            "source", "target", mean.alias("mean"), full.alias("full"),
            F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"),
            (F.lit(math.log(cap)) * mean + 1.0).alias("hi"),
        ),
        "mix-dual",
    )
    done = 0
    while done < MAX_NEWTON:
        for _ in range(5):
            both = hist.join(state, hist["source"].eqNullSafe(state["source"])).drop(hist["source"])
            x = F.col("size") / F.col("mean")
            e = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
            words = F.col("size") * F.col("n")
            free = e < cap
            step = both.groupBy("source").agg(
                *[F.first(c).alias(c) for c in ("target", "mean", "full", "lam", "lo", "hi")],
                F.sum(words * F.least(e, F.lit(cap))).alias("have"),
                F.sum(F.when(free, words * e * x).otherwise(0.0)).alias("slope"),
            )
            miss = F.col("have") - F.col("target")
            lo = F.when(miss <= 0, F.col("lam")).otherwise(F.col("lo"))
            hi = F.when(miss >= 0, F.col("lam")).otherwise(F.col("hi"))
            newton = F.col("lam") - miss / F.col("slope")
            inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
            state = step.select(
                "source", "target", "mean", "full",
                F.when(miss == 0, F.col("lam")).when(inside, newton).otherwise((lo + hi) / 2).alias("lam"),
                lo.alias("lo"), hi.alias("hi"),
                F.when(F.col("full") | (F.col("target") <= 0), F.lit(0.0))
                .otherwise(F.abs(miss) / F.col("target")).alias("error"),
            )
            done += 1
        state = staged(state, "mix-dual")
        if (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
        state = state.drop("error")
    else:
        raise ArithmeticError(f"after {MAX_NEWTON} Newton steps a source still misses its target")
    # sums of doubles differ in their last bits with the order of the rows; the
    # rounded variable is the same in every run
    return state.select("source", F.round("lam", 12).alias("lam"), "mean", "full")


def _thresholds(rated: DataFrame, sources: DataFrame, rounds: int = 4) -> DataFrame:
    """(source, below): documents whose margin is less than `below` get one
    more copy. Each round cuts the bin of the source in which the wanted words
    are reached into BINS bins."""
    base = rated.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("sure"))
    want = sources.join(base, sources["source"].eqNullSafe(base["source"])).select(
        sources["source"], (F.col("target") - F.col("sure")).alias("want")
    )
    state = want.select("source", "want", F.lit(-1.0).alias("lo"), F.lit(2.0).alias("width"))
    open_rows = rated.where("may AND size > 0").select("source", "margin", "size")
    for _ in range(rounds):
        state = staged(state, "mix-threshold")
        at = F.floor((F.col("margin") - F.col("lo")) / F.col("width") * BINS)
        binned = (
            open_rows.join(state, open_rows["source"].eqNullSafe(state["source"])).drop(open_rows["source"])
            .where((at >= 0) & (at < BINS))
            .groupBy("source", at.alias("bin")).agg(F.sum("size").alias("words"))
        )
        order = Window.partitionBy("source").orderBy("bin")  # at most BINS rows a source
        run = binned.withColumn("upto", F.sum("words").over(order))
        run = run.join(state.select(F.col("source").alias("s"), "want"), F.col("source").eqNullSafe(F.col("s")))
        # the first bin in which the wanted words are reached; beyond all bins if never
        cross = run.where(F.col("upto") >= F.col("want")).groupBy("source").agg(
            F.min_by(F.struct("bin", "words", "upto"), "bin").alias("c")
        )
        state = state.join(
            cross.select(F.col("source").alias("s"), "c"), F.col("source").eqNullSafe(F.col("s")), "left"
        ).select(
            "source",
            F.when(F.col("c").isNotNull(), F.col("want") - (F.col("c.upto") - F.col("c.words")))
            .otherwise(F.lit(0.0)).alias("want"),
            F.when(F.col("c").isNotNull(), F.col("lo") + F.col("c.bin") * F.col("width") / BINS)
            .otherwise(F.col("lo") + F.col("width")).alias("lo"),
            (F.col("width") / BINS).alias("width"),
            F.coalesce(F.col("c.words"), F.lit(0)).alias("words"),
        )
    # the last bin holds about one document: take it if that is nearer
    near = (F.col("want") > 0) & (F.col("words") - F.col("want") < F.col("want"))
    return staged(
        state.select("source", F.when(near, F.col("lo") + F.col("width")).otherwise(F.col("lo")).alias("below")),
        "mix-threshold",
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` (with __h) with `__copy`: 0, or the number of a row among those
    of one __h. Numbers count on from part to part of the table, so the rows of one
    __h are numbered where they lie."""
    twice = rows.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__h")
    twice = staged(twice, "mix-repeated")
    if twice.isEmpty():
        return rows.withColumn("__copy", F.lit(0).cast("long"))
    again = rows.join(twice, "__h", "left_semi").withColumn("__row", F.monotonically_increasing_id())
    again = staged(again.withColumn("__part", F.shiftright("__row", 33)), "mix-copies")
    sizes = again.groupBy("__h", "__part").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__h").orderBy("__part"))  # a row a part
    before = sizes.select(F.col("__h").alias("h"), F.col("__part").alias("part"), (upto - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("__h", "__part").orderBy("__row"))
    numbered = again.withColumn("__copy", own.cast("long")).join(
        before, (F.col("__h") == F.col("h")) & (F.col("__part") == F.col("part"))
    )
    numbered = numbered.withColumn("__copy", F.col("__copy") + F.col("before") - 1).select(*rows.columns, "__copy")
    once = rows.join(twice, "__h", "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    return once.unionByName(numbered)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, carried: Column) -> DataFrame:
    """`carried` as `__doc`, and the rows' source, size and u (a number from 0 to 1
    that depends on id and text, and on the row's number among equal ones)."""
    rows = docs.select(
        carried.alias("__doc"), F.col(source_col).alias("__source"), word_count(text_or_empty(text_col)).alias("__size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("__h"),
    )
    h = F.when(F.col("__copy") == 0, F.col("__h")).otherwise(F.xxhash64("__h", "__copy"))
    u = (F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))).alias("__u")
    return _numbered(rows).select("__doc", "__source", "__size", u)


def _rate(cap: int) -> Column:
    grown = F.exp(F.least(F.col("lam") * F.col("__size") / F.col("mean"), F.lit(700.0)))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), grown))


def _copies(cap: int) -> Column:
    rate = _rate(cap)
    extra = (F.floor(rate) < cap) & (F.col("__u") - (rate - F.floor(rate)) < F.col("below"))
    return (F.floor(rate) + F.when(extra, 1).otherwise(0)).cast("int")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """A join with one row a source."""
    return rows.join(plan, F.col("__source").eqNullSafe(F.col("s")))


def mixing_plan(sized: DataFrame, weights: Sequence[float], ratio: float, cap: int) -> DataFrame:
    """One row a source: s, source_size, target, dual variable and rounding
    threshold. `sized` holds __source, __size and __u of each document."""
    rows = sized.select(F.col("__source").alias("source"), F.col("__size").alias("size"), "__u")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = staged(source_targets(sources, weights, ratio, float(cap)), "mix-targets")
    hist = staged(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    dual = _solve(hist, sources, float(cap))
    known = sources.join(dual.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", "lam", "mean", "full"
    )
    known = staged(known, "mix-known")
    rate = _rate(cap)
    rated = _with_plan(sized, known).select(
        F.col("s").alias("source"), F.col("__size").alias("size"), F.floor(rate).alias("copies"),
        (F.col("__u") - (rate - F.floor(rate))).alias("margin"), (F.floor(rate) < cap).alias("may"),
    )
    rated = staged(rated, "mix-rated")
    below = _thresholds(rated, sources.select("source", "target")).withColumnRenamed("source", "x")
    return staged(known.join(below, F.col("s").eqNullSafe(F.col("x"))).drop("x"), "mix-plan")


def entropy_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    ratio: float = 1.5,
    cap: int = 2,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, rate,
    copies (0 to cap), taken (= copies * size)."""
    rows = staged(_sized(docs, id_col, text_col, source_col, F.col(id_col)), "mix-sized")
    out = _with_plan(rows, mixing_plan(rows, weights, ratio, cap))
    return out.select(
        F.col("__doc").alias(id_col), F.col("__source").alias("source"), F.col("__size").alias("size"),
        "source_size", "target", _rate(cap).alias("rate"), _copies(cap).alias("copies"),
        (_copies(cap) * F.col("__size")).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    ratio: float = 1.5,
    cap: int = 2,
) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. Texts are not shuffled
    but those of rows that repeat id and text: the plan (one row a source) is joined
    to the scan."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # apart from the plan's columns, whatever their names
    sized = _sized(docs, id_col, text_col, source_col, whole)
    plan = mixing_plan(staged(sized.select("__source", "__size", "__u"), "mix-sized"), weights, ratio, cap)
    times = F.sequence(F.lit(1), _copies(cap))
    rows = _with_plan(sized, plan).where(_copies(cap) > 0)
    rows = rows.select("__doc", F.explode(times).alias("__copy"))
    return rows.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
