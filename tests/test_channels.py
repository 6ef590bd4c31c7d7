"""Channel grouping: the ten reference cases, derived edge cases, and the
column function and the SQL function agreeing."""

import pytest
from pyspark.sql import functions as F

from touchline.functions.channels import SiteLists, default_channel_grouping, read_site_lists, site_lists
from touchline.plans.sql_functions import register_sql_functions

NA = "N/A for (source/medium/campaign) = ({}/{}/{})"

# The published inputs and answers.
# (medium, source, campaign, extra video sites, expected)
REFERENCE_CASES = [
    ("ab", "sdf", "not", None, NA.format("sdf", "ab", "not")),
    ("", "", "Cross-network", None, "Cross-network"),
    ("(none)", "(direct)", "", None, "Direct"),
    ("cpc", "asdf", "shop", None, "Paid Shopping"),
    ("display", "asdf", "a", None, "Display"),
    ("my medium", "asdf", "shopping", None, "Organic Shopping"),
    ("referral", "asdf", "fds", None, "Referral"),
    ("sms", "asdf", "fds", None, "SMS"),
    ("cpc", "youtube.com", "fds", None, "Paid Video"),
    ("cpc", "myvideoplayer.com", "fds", ["myvideoplayer.com"], "Paid Video"),
]

# social sites these cases rely on (the social list is a parameter)
SOCIAL = ("ig", "t.co", "Hatena", "facebook.com")
SITES = SiteLists(social=SOCIAL)

DERIVED_CASES = [
    ("cpm", "google", "x", "Paid Search"),
    ("cpm", "zzz", "x", "Display"),
    ("cpc", "amazon", "x", "Paid Shopping"),
    ("x", "eshop.example", "eshop", "Organic Shopping"),
    ("x", "y", "workshop", NA.format("y", "x", "workshop")),
    ("mobile-app", "y", "z", NA.format("y", "mobile-app", "z")),
    ("webpush", "y", "z", "Mobile Push Notification"),
    ("organic", "ig", "z", "Organic Social"),
    ("none", "Hatena", "z", NA.format("hatena", "none", "z")),
    ("video", "t.co", "z", "Organic Social"),
    ("email", "amazon", "z", "Paid Shopping"),
    ("affiliate", "y", "z", "Affiliates"),
    ("audio", "y", "z", "Audio"),
    ("x", "firebase", "z", "Mobile Push Notification"),
    (None, "y", "z", None),
    ("CPC", "YouTube.com", "FDS", "Paid Video"),
    ("cpc\n", "zzz", "x", NA.format("zzz", "cpc\n", "x")),
    ('a"mobile', "y", "z", "Mobile Push Notification"),
    ("social media", "y", "z", "Organic Social"),
    ("e mail", "y", "z", "Email"),
    ("x", "sms", "z", "SMS"),
    ("paid-social", "y", "z", "Paid Other"),
    ("organic", "y", "z", "Organic Search"),
    ("my-video", "y", "z", "Organic Video"),
    ("cpc", "facebook.com", "x", "Paid Social"),
    ("x", "facebook.com", "x", "Organic Social"),
    ("email", "facebook.com", "y", "Organic Social"),
]


def test_reference_cases_column(spark):
    for medium, source, campaign, video, expected in REFERENCE_CASES:
        for sites, added in ((SITES.extended(video=video), None), (SITES, F.col("v"))):
            df = spark.createDataFrame([(medium, source, campaign, video)], "m string, s string, c string, v array<string>")
            got = df.select(default_channel_grouping("m", "s", "c", sites, video_sites_add=added).alias("ch")).first().ch
            assert got == expected, (medium, source, campaign)


def test_reference_cases_sql_function(spark):
    register_sql_functions(spark, SITES)
    rows = []
    for medium, source, campaign, video, expected in REFERENCE_CASES:
        v = "array(" + ", ".join(f"'{x}'" for x in (video or [])) + ")"
        rows.append(
            f"SELECT default_channel_grouping('{medium}', '{source}', '{campaign}', array(), array(), "
            f"array(), {v}) AS output, '{expected}' AS expected"
        )
    out = spark.sql(" UNION ALL ".join(rows)).collect()
    assert [r.output for r in out] == [r.expected for r in out]


def test_null_extra_arrays_are_empty(spark):
    register_sql_functions(spark, SITES)
    r = spark.sql("SELECT default_channel_grouping('cpc', 'zzz', 'x', NULL, NULL, NULL, NULL) AS c").first()
    assert r.c == "Paid Other"


@pytest.mark.parametrize("medium,source,campaign,expected", DERIVED_CASES)
def test_derived_cases(spark, medium, source, campaign, expected):
    df = spark.createDataFrame([(medium, source, campaign)], "m string, s string, c string")
    assert df.select(default_channel_grouping("m", "s", "c", SITES).alias("ch")).first().ch == expected


def test_sql_function_agrees_with_column(spark):
    cases = [(m, s, c) for m, s, c, _ in DERIVED_CASES] + [(m, s, c) for m, s, c, _, _ in REFERENCE_CASES]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, m string, s string, c string")
    for fix in (False, True):
        register_sql_functions(spark, SITES, fix_push_rule=fix)
        both = df.select(
            F.expr("default_channel_grouping(m, s, c, NULL, NULL, NULL, NULL)").alias("f"),
            default_channel_grouping("m", "s", "c", SITES, fix_push_rule=fix).alias("ch"),
        )
        assert both.where("NOT f <=> ch").count() == 0


def test_user_sites_as_columns(spark):
    df = spark.createDataFrame(
        [("cpc", "mine.com", "x", ["mine.com"]), ("cpc", "mine.com", "x", None), ("cpc", "mine.com", "x", [None, "other"])],
        "m string, s string, c string, a array<string>",
    )
    for category, want in (("search", "Paid Search"), ("social", "Paid Social"), ("video", "Paid Video"), ("shopping", "Paid Shopping")):
        col = default_channel_grouping("m", "s", "c", SITES, **{f"{category}_sites_add": F.col("a")})
        assert [r[0] for r in df.select(col).collect()] == [want, "Paid Other", "Paid Other"]


def test_push_rule_switch(spark):
    df = spark.createDataFrame([("mobile-app", "y", "z")], "m string, s string, c string")
    published, fixed = (default_channel_grouping("m", "s", "c", SITES, fix_push_rule=x) for x in (False, True))
    assert tuple(df.select(published, fixed).first()) == (NA.format("y", "mobile-app", "z"), "Mobile Push Notification")


def test_social_list_is_required():
    with pytest.raises(ValueError, match="social site list is required"):
        SiteLists()
    with pytest.raises(TypeError):
        default_channel_grouping("m", "s", "c")


def test_site_lists_are_read_whole_or_not_at_all(spark, scratch):
    path = f"{scratch}/sites.csv"
    with open(path, "w") as fh:
        fh.write("source,category\nfacebook.com,SOURCE_CATEGORY_SOCIAL\nmyshop,shopping\n")
    s = read_site_lists(spark, path, base=SITES)
    assert "facebook.com" in s.social and "myshop" in s.shopping and "google" in s.search
    for bad in (("a.com", "socail"), ("a.com", None), (None, "social")):
        with pytest.raises(ValueError, match="not a"):
            site_lists(spark.createDataFrame([("ok.com", "video"), bad], "source string, category string"))


def test_membership_is_hash_set_not_join(spark):
    df = spark.createDataFrame([("cpc", "google", "x")], "m string, s string, c string")
    plan = df.select(default_channel_grouping("m", "s", "c", SITES)).select(F.col("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "INSET" in plan.upper()
