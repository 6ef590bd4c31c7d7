"""Sites as a table, strict lookups, and reports over real partitions."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import T0, ev, events_df
from touchline.functions.channels import SiteLists, default_channel_grouping, site_lists, site_rows, site_table, with_channel
from touchline.functions.params import event_param, page_location, session_id
from touchline.plans import catalog

SITES = SiteLists(social=("facebook.com", "Some.Site", "t.co"))
MEDIA = ("cpc", "(none)", "organic", "social", "email", "x-push", None)
SOURCES = ("google", "GOOGLE", "facebook.com", "some.site", "Some.Site", "youtube.com", "amazon", "(direct)", "nowhere", None)
CAMPAIGNS = ("(not set)", "spring-shop", "cross-network", None)


def rows(spark):
    found = [(i, m, s, c, "clash") for i, (m, s, c) in enumerate((m, s, c) for m in MEDIA for s in SOURCES for c in CAMPAIGNS)]
    return spark.createDataFrame(found, "i int, medium string, source string, campaign string, site string")


def test_table_equals_lists(spark):
    df = rows(spark)
    want = df.select("i", default_channel_grouping("medium", "source", "campaign", SITES).alias("channel"))
    got = with_channel(df, "medium", "source", "campaign", site_table(site_rows(spark, SITES)))
    assert got.columns == [*df.columns, "channel"] and got.count() == df.count()
    assert sorted(map(tuple, got.select("i", "channel").collect())) == sorted(map(tuple, want.collect()))


def test_long_lists_as_a_table(spark):
    """Beyond what a list in an expression may hold; nothing is collected."""
    many = spark.range(150_000).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("SOURCE_CATEGORY_SOCIAL").alias("category"))
    many = many.unionByName(many.limit(10))  # a site given twice is one site
    with pytest.raises(ValueError):
        site_lists(many)
    df = spark.range(0, 300_000, 1000).select("id", F.concat(F.lit("S"), "id").alias("source"))
    got = with_channel(df, F.lit("x"), "source", F.lit("y"), site_table(many))
    assert got.count() == 300
    assert got.where("channel = 'Organic Social'").count() == 150


def test_the_published_list_size(spark):
    sites = SiteLists(social=tuple(f"network{i}.example" for i in range(592)))
    df = spark.createDataFrame([("network0.example",), ("NETWORK591.example",), ("network592.example",)], "s string")
    channel = default_channel_grouping(F.lit("referral"), "s", F.lit("c"), sites)
    assert [r[0] for r in df.select(channel).collect()] == ["Organic Social", "Organic Social", "Referral"]


@pytest.mark.parametrize("row", [("a.example", "news"), (None, "social"), ("", "video"), ("a.example", None)])
def test_a_row_that_cannot_be_placed_raises(spark, row):
    table = site_table(spark.createDataFrame([("b.example", "search"), row], "source string, category string"))
    with pytest.raises(Exception, match="not a .source, category. row"):
        table.collect()


def test_strict_channel_raises_on_null(spark):
    df = rows(spark)
    strict = lambda d: d.select(default_channel_grouping("medium", "source", "campaign", SITES, strict=True)).collect()
    with pytest.raises(Exception, match="is NULL"):
        strict(df)
    assert len(strict(df.dropna())) == (len(MEDIA) - 1) * (len(SOURCES) - 1) * (len(CAMPAIGNS) - 1)


def repeated(spark):
    df = events_df(spark, [ev("u", T0, "click", sid=7, page="p")])
    return df.withColumn("event_params", F.concat("event_params", "event_params"))


def test_strict_parameters(spark):
    once = events_df(spark, [ev("u", T0, "click", sid=7, page="p"), ev("u", T0, "click")])
    both = once.unionByName(once.withColumn("event_params", F.lit(None).cast(once.schema["event_params"].dataType)))
    for lookup in (session_id, page_location):
        assert both.select(lookup(strict=True)).collect() == both.select(lookup()).collect()
        assert repeated(spark).select(lookup().alias("x")).first().x is not None
        with pytest.raises(Exception, match="more than one event parameter"):
            repeated(spark).select(lookup(strict=True)).collect()
    assert repeated(spark).select(event_param("other", strict=True)).first()[0] is None


@pytest.mark.parametrize("name,days", [("export_day", 1), ("export_prefix", 10), ("export_sessions_window", 17)])
def test_reports_read_only_the_shards_they_name(spark, name, days):
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert filters and all("event_date" in f for f in filters)
    files = df.inputFiles()  # of the relation; the filters above are what the scan takes of them
    assert len({re.search("event_date=([0-9]+)", f)[1] for f in files}) > days
