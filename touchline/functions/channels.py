"""Default channel grouping from (medium, source, campaign).

One rule table, rendered two ways: as a native Column expression (CASE WHEN
chain, codegen'd, site membership as hash-set `IN` lookups, no join) and as
SQL text (the session SQL function). The first matching rule wins; inputs are
lowercased first; user-added sites are not.

The social list (about 600 entries) is not stated here and has no default: the
caller passes it, or reads the vendor's list with `read_site_lists`.

Site lists of any length can be a table instead (`site_table`, one row a site
with a flag for each category): `with_channel` joins it on the lower-cased source,
and its size decides how (nothing is collected).

Deviation on purpose: a NULL medium, source or campaign yields NULL instead of
failing the whole job (`strict` raises, as the original does).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --- Fixed values (must equal the original definitions) ----------------------
# Site categories of the default channel definitions (vendor list pulled on
# 19 Jan 2024), in published order. Entries with capitals can never match a
# lowercased source; they are kept as published.
SHOPPING_SITES = (
    'Google Shopping', 'IGShopping', 'aax-us-east.amazon-adsystem.com', 'aax.amazon-adsystem.com',
    'alibaba', 'alibaba.com', 'amazon', 'amazon.co.uk', 'amazon.com', 'apps.shopify.com',
    'checkout.shopify.com', 'checkout.stripe.com', 'cr.shopping.naver.com', 'cr2.shopping.naver.com',
    'ebay', 'ebay.co.uk', 'ebay.com', 'ebay.com.au', 'ebay.de', 'etsy', 'etsy.com', 'm.alibaba.com',
    'm.shopping.naver.com', 'mercadolibre', 'mercadolibre.com', 'mercadolibre.com.ar',
    'mercadolibre.com.mx', 'message.alibaba.com', 'msearch.shopping.naver.com', 'nl.shopping.net',
    'no.shopping.net', 'offer.alibaba.com', 'one.walmart.com', 'order.shopping.yahoo.co.jp',
    'partners.shopify.com', 's3.amazonaws.com', 'se.shopping.net', 'shop.app', 'shopify',
    'shopify.com', 'shopping.naver.com', 'shopping.yahoo.co.jp', 'shopping.yahoo.com', 'shopzilla',
    'shopzilla.com', 'simplycodes.com', 'store.shopping.yahoo.co.jp', 'stripe', 'stripe.com',
    'uk.shopping.net', 'walmart', 'walmart.com',
)
VIDEO_SITES = (
    'blog.twitch.tv', 'crackle', 'crackle.com', 'curiositystream', 'curiositystream.com', 'd.tube',
    'dailymotion', 'dailymotion.com', 'dashboard.twitch.tv', 'disneyplus', 'disneyplus.com',
    'fast.wistia.net', 'help.hulu.com', 'help.netflix.com', 'hulu', 'hulu.com', 'id.twitch.tv',
    'iq.com', 'iqiyi', 'iqiyi.com', 'jobs.netflix.com', 'justin.tv', 'm.twitch.tv', 'm.youtube.com',
    'music.youtube.com', 'netflix', 'netflix.com', 'player.twitch.tv', 'player.vimeo.com', 'ted',
    'ted.com', 'twitch', 'twitch.tv', 'utreon', 'utreon.com', 'veoh', 'veoh.com',
    'viadeo.journaldunet.com', 'vimeo', 'vimeo.com', 'wistia', 'wistia.com', 'youku', 'youku.com',
    'youtube', 'youtube.com',
)
SEARCH_SITES = (
    '360.cn', 'alice', 'aol', 'ar.search.yahoo.com', 'ask', 'at.search.yahoo.com',
    'au.search.yahoo.com', 'auone', 'avg', 'babylon', 'baidu', 'biglobe', 'biglobe.co.jp',
    'biglobe.ne.jp', 'bing', 'br.search.yahoo.com', 'ca.search.yahoo.com', 'centrum.cz',
    'ch.search.yahoo.com', 'cl.search.yahoo.com', 'cn.bing.com', 'cnn', 'co.search.yahoo.com',
    'comcast', 'conduit', 'daum', 'daum.net', 'de.search.yahoo.com', 'dk.search.yahoo.com',
    'dogpile', 'dogpile.com', 'duckduckgo', 'ecosia.org', 'email.seznam.cz', 'eniro',
    'es.search.yahoo.com', 'espanol.search.yahoo.com', 'exalead.com', 'excite.com',
    'fi.search.yahoo.com', 'firmy.cz', 'fr.search.yahoo.com', 'globo', 'go.mail.ru', 'google',
    'google-play', 'hk.search.yahoo.com', 'id.search.yahoo.com', 'in.search.yahoo.com',
    'incredimail', 'it.search.yahoo.com', 'kvasir', 'lens.google.com', 'lite.qwant.com', 'lycos',
    'm.baidu.com', 'm.naver.com', 'm.search.naver.com', 'm.sogou.com', 'mail.rambler.ru',
    'mail.yandex.ru', 'malaysia.search.yahoo.com', 'msn', 'msn.com', 'mx.search.yahoo.com', 'najdi',
    'naver', 'naver.com', 'news.google.com', 'nl.search.yahoo.com', 'no.search.yahoo.com',
    'ntp.msn.com', 'nz.search.yahoo.com', 'onet', 'onet.pl', 'pe.search.yahoo.com',
    'ph.search.yahoo.com', 'pl.search.yahoo.com', 'play.google.com', 'qwant', 'qwant.com', 'rakuten',
    'rakuten.co.jp', 'rambler', 'rambler.ru', 'se.search.yahoo.com', 'search-results',
    'search.aol.co.uk', 'search.aol.com', 'search.google.com', 'search.smt.docomo.ne.jp',
    'search.ukr.net', 'secureurl.ukr.net', 'seznam', 'seznam.cz', 'sg.search.yahoo.com', 'so.com',
    'sogou', 'sogou.com', 'sp-web.search.auone.jp', 'startsiden', 'startsiden.no', 'suche.aol.de',
    'terra', 'th.search.yahoo.com', 'tr.search.yahoo.com', 'tut.by', 'tw.search.yahoo.com',
    'uk.search.yahoo.com', 'ukr', 'us.search.yahoo.com', 'virgilio', 'vn.search.yahoo.com',
    'wap.sogou.com', 'webmaster.yandex.ru', 'websearch.rakuten.co.jp', 'yahoo', 'yahoo.co.jp',
    'yahoo.com', 'yandex', 'yandex.by', 'yandex.com', 'yandex.com.tr', 'yandex.fr', 'yandex.kz',
    'yandex.ru', 'yandex.ua', 'yandex.uz', 'zen.yandex.ru',
)

# Rule patterns, in JavaScript regex syntax as defined.
PAID_MEDIUM = r"^(.*cp.*|ppc|retargeting|paid.*)$"
SHOPPING_CAMPAIGN = r"^(.*(([^a-df-z]|^)shop|shopping).*)$"
VIDEO_MEDIUM = r"^(.*video.*)$"
PUSH_MEDIUM = r'"mobile|notification"'  # literal quotes: an alternation of `"mobile` and `notification"`
# Literal terms.
DIRECT_SOURCE = "(direct)"
DIRECT_MEDIA = ("(not set)", "(none)")
CROSS_NETWORK = "cross-network"
DISPLAY_MEDIA = ("display", "banner", "expandable", "interstitial", "cpm")
SOCIAL_MEDIA = ("social", "social-network", "social-media", "sm", "social network", "social media")
REFERRAL_MEDIA = ("referral", "app", "link")
EMAIL_TERMS = ("email", "e-mail", "e_mail", "e mail")
NOT_MATCHED_PREFIX = "N/A for (source/medium/campaign) = ("
CATEGORIES = ("shopping", "search", "social", "video")

# The rule chain, first match wins. Conditions: ("site", category),
# ("eq"|"in"|"re"|"contains"|"ends", field, value), ("and"|"or", a, b).
PAID = ("re", "medium", PAID_MEDIUM)
SHOP_CAMPAIGN = ("re", "campaign", SHOPPING_CAMPAIGN)
RULES = (
    ("Direct", ("and", ("eq", "source", DIRECT_SOURCE), ("in", "medium", DIRECT_MEDIA))),
    ("Cross-network", ("contains", "campaign", CROSS_NETWORK)),
    ("Paid Shopping", ("or", ("site", "shopping"), ("and", SHOP_CAMPAIGN, PAID))),
    ("Paid Search", ("and", ("site", "search"), PAID)),
    ("Paid Social", ("and", ("site", "social"), PAID)),
    ("Paid Video", ("and", ("site", "video"), PAID)),
    ("Display", ("in", "medium", DISPLAY_MEDIA)),
    ("Paid Other", PAID),
    ("Organic Shopping", ("or", ("site", "shopping"), SHOP_CAMPAIGN)),
    ("Organic Social", ("or", ("site", "social"), ("in", "medium", SOCIAL_MEDIA))),
    ("Organic Video", ("or", ("site", "video"), ("re", "medium", VIDEO_MEDIUM))),
    ("Organic Search", ("or", ("site", "search"), ("eq", "medium", "organic"))),
    ("Referral", ("in", "medium", REFERRAL_MEDIA)),
    ("Email", ("or", ("in", "source", EMAIL_TERMS), ("in", "medium", EMAIL_TERMS))),
    ("Affiliates", ("eq", "medium", "affiliate")),
    ("Audio", ("eq", "medium", "audio")),
    ("SMS", ("or", ("eq", "source", "sms"), ("eq", "medium", "sms"))),
    (
        "Mobile Push Notification",
        ("or", ("or", ("ends", "medium", "push"), ("re", "medium", PUSH_MEDIUM)), ("eq", "source", "firebase")),
    ),
)
# ------------------------------------------------------------------------------


def rules(fix_push_rule: bool = False) -> tuple:
    """The rule chain. As published, the push rule's pattern holds literal
    quotes; fix_push_rule takes them out (the evident intent)."""
    if not fix_push_rule:
        return RULES

    def fixed(cond):
        if cond == ("re", "medium", PUSH_MEDIUM):
            return ("re", "medium", PUSH_MEDIUM.replace('"', ""))
        return tuple(fixed(c) if isinstance(c, tuple) else c for c in cond) if cond[0] in ("and", "or") else cond

    return tuple((label, fixed(cond)) for label, cond in RULES)


def java_regex(js_pattern: str) -> str:
    """JavaScript `$` (no multiline) matches only at the end of input; Java's
    also matches before a final line terminator, so use `\\z`."""
    return js_pattern[:-1] + r"\z" if js_pattern.endswith("$") else js_pattern


@dataclass(frozen=True)
class SiteLists:
    """Site lists per category. Shopping, search and video default to the
    published lists; `social` must be given (an empty tuple to have none)."""

    shopping: tuple[str, ...] = SHOPPING_SITES
    search: tuple[str, ...] = SEARCH_SITES
    social: tuple[str, ...] | None = None
    video: tuple[str, ...] = VIDEO_SITES

    def __post_init__(self) -> None:
        if self.social is None:
            raise ValueError(
                "the social site list is required: SiteLists(social=...) or read_site_lists(spark, path)"
            )

    def extended(self, shopping=None, search=None, social=None, video=None) -> "SiteLists":
        """Append user sites (kept as given, like the original; NULL = none)."""
        add = {"shopping": shopping, "search": search, "social": social, "video": video}
        return replace(self, **{k: tuple(getattr(self, k)) + tuple(v or ()) for k, v in add.items()})

    def get(self, category: str) -> tuple[str, ...]:
        return tuple(getattr(self, category))


MAX_SITES = 100_000  # a list beyond this belongs in a join, not in an expression


def site_lists(rows: DataFrame, base: SiteLists | None = None) -> SiteLists:
    """Lists from (source, category) rows, appended to `base` (default: empty
    lists). A category is one of shopping/search/social/video, in any case, with
    or without a `SOURCE_CATEGORY_` prefix. A row without a source or with
    another category is an error that names it."""
    first, second = rows.columns[:2]
    found = rows.select(F.col(first).alias("s"), F.col(second).alias("c")).limit(MAX_SITES + 1).collect()
    if len(found) > MAX_SITES:
        raise ValueError(f"more than {MAX_SITES} sites")
    extra: dict[str, list[str]] = {c: [] for c in CATEGORIES}
    for source, category in found:
        name = (category or "").strip().lower().removeprefix("source_category_")
        if not source or name not in extra:
            raise ValueError(f"not a (source, category) row: {(source, category)!r}")
        extra[name].append(source.strip())
    base = base or SiteLists(shopping=(), search=(), social=(), video=())
    return base.extended(**extra)


def read_site_lists(spark: SparkSession, path: str, base: SiteLists | None = None, header: bool = True) -> SiteLists:
    """`site_lists` of a CSV file of source,category rows in any store that
    Spark reads."""
    rows = spark.read.schema("source string, category string").option("mode", "PERMISSIVE").csv(path, header=header)
    return site_lists(rows, base)


def site_table(rows: DataFrame) -> DataFrame:
    """(site, shopping, search, social, video) from (source, category) rows, one
    row a site; categories as for `site_lists`. A row that can't be placed raises
    when the table is read."""
    first, second = rows.columns[:2]
    name = F.regexp_replace(F.lower(F.trim(F.col(second))), "^source_category_", "")
    bad = F.col(first).isNull() | (F.col(first) == "") | name.isNull() | ~name.isin(*CATEGORIES)
    told = F.concat(F.lit("not a (source, category) row: "), F.to_json(F.struct(F.col(first), F.col(second))))
    site = F.when(bad, F.raise_error(told)).otherwise(F.trim(F.col(first)))
    return rows.select(site.alias("site"), name.alias("name")).groupBy("site").agg(
        *[F.max(F.col("name") == c).alias(c) for c in CATEGORIES]
    )


def site_rows(spark: SparkSession, sites: SiteLists) -> DataFrame:
    """(source, category) rows of lists held in the program."""
    rows = [(s, c) for c in CATEGORIES for s in sites.get(c)]
    return spark.createDataFrame(rows, "source string, category string")


def with_channel(
    df: DataFrame,
    medium: Column | str,
    source: Column | str,
    campaign: Column | str,
    sites: DataFrame,
    name: str = "channel",
    fix_push_rule: bool = False,
    strict: bool = False,
) -> DataFrame:
    """The rows with their channel, the sites taken from a `site_table` by a
    left join on the lower-cased source: broadcast or shuffled by its measured
    size, a frequent source split by AQE. Equal to `default_channel_grouping` with
    the same lists."""
    flags = sites.select(F.col("site").alias("__site"), *[F.col(c).alias(f"__{c}") for c in CATEGORIES])
    rows = df.withColumn("__source", F.lower(_col(source)))
    joined = rows.join(flags, F.col("__source") == F.col("__site"), "left")
    known = {c: F.coalesce(F.col(f"__{c}"), F.lit(False)) for c in CATEGORIES}
    channel = _channel(_col(medium), _col(source), _col(campaign), known.__getitem__, fix_push_rule, strict)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], channel.alias(name))


# --- Column rendering ---------------------------------------------------------
def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _render_column(cond, fields: dict[str, Column], site: Callable[[str], Column]) -> Column:
    op = cond[0]
    if op == "site":
        return site(cond[1])
    if op in ("and", "or"):
        a = _render_column(cond[1], fields, site)
        b = _render_column(cond[2], fields, site)
        return (a & b) if op == "and" else (a | b)
    x, v = fields[cond[1]], cond[2]
    if op == "eq":
        return x == F.lit(v)
    if op == "in":
        return x.isin(*v)
    if op == "re":
        return x.rlike(java_regex(v))
    if op == "contains":
        return x.contains(v)
    if op == "ends":
        return x.endswith(v)
    raise ValueError(op)


def default_channel_grouping(
    medium: Column | str,
    source: Column | str,
    campaign: Column | str,
    sites: SiteLists,
    shopping_sites_add: Column | None = None,
    search_sites_add: Column | None = None,
    social_sites_add: Column | None = None,
    video_sites_add: Column | None = None,
    fix_push_rule: bool = False,
    strict: bool = False,
) -> Column:
    """Channel name for each row. Site membership compiles to hash-set IN
    lookups inside the generated code (the lists are small and fixed). The
    `*_sites_add` arguments are array columns of user sites per row (NULL =
    none). fix_push_rule drops the literal quotes of the push rule's pattern;
    strict raises on a NULL input."""
    low = F.lower(_col(source))
    added = {
        "shopping": shopping_sites_add,
        "search": search_sites_add,
        "social": social_sites_add,
        "video": video_sites_add,
    }

    def site(cat: str) -> Column:
        items = sites.get(cat)
        known = low.isin(*items) if items else F.lit(False)
        if added[cat] is not None:
            known = known | F.coalesce(F.array_contains(added[cat], low), F.lit(False))
        return known

    return _channel(_col(medium), _col(source), _col(campaign), site, fix_push_rule, strict)


def _channel(
    medium: Column, source: Column, campaign: Column, site: Callable[[str], Column], fix_push_rule: bool, strict: bool
) -> Column:
    f = {"medium": F.lower(medium), "source": F.lower(source), "campaign": F.lower(campaign)}
    missing = F.raise_error(F.lit("medium, source or campaign is NULL")) if strict else F.lit(None)
    out = F.when(f["medium"].isNull() | f["source"].isNull() | f["campaign"].isNull(), missing)
    for label, cond in rules(fix_push_rule):
        out = out.when(_render_column(cond, f, site), F.lit(label))
    fallback = F.concat(
        F.lit(NOT_MATCHED_PREFIX), f["source"], F.lit("/"), f["medium"], F.lit("/"), f["campaign"], F.lit(")")
    )
    return out.otherwise(fallback).cast("string")


# --- SQL rendering --------------------------------------------------------------
def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _render_sql(cond, fields: dict[str, str], site: Callable[[str], str]) -> str:
    op = cond[0]
    if op == "site":
        return site(cond[1])
    if op in ("and", "or"):
        a = _render_sql(cond[1], fields, site)
        b = _render_sql(cond[2], fields, site)
        return f"({a} {op.upper()} {b})"
    x, v = fields[cond[1]], cond[2]
    if op == "eq":
        return f"({x} = {_quote(v)})"
    if op == "in":
        return f"({x} IN ({', '.join(_quote(i) for i in v)}))"
    if op == "re":
        return f"({x} RLIKE {_quote(java_regex(v))})"
    if op == "contains":
        return f"contains({x}, {_quote(v)})"
    if op == "ends":
        return f"endswith({x}, {_quote(v)})"
    raise ValueError(op)


def channel_case_sql(
    medium: str,
    source: str,
    campaign: str,
    sites: SiteLists,
    added: dict[str, str] | None = None,
    fix_push_rule: bool = False,
) -> str:
    """The rule chain as a Spark SQL CASE expression over three SQL expressions.

    `added` maps a category to a SQL array expression of extra sites (the
    arguments of the SQL function).
    """
    f = {k: f"lower({v})" for k, v in (("medium", medium), ("source", source), ("campaign", campaign))}
    added = added or {}

    def site(cat: str) -> str:
        items = sites.get(cat)
        parts = []
        if items:
            parts.append(f"{f['source']} IN ({', '.join(_quote(i) for i in items)})")
        if cat in added:
            parts.append(f"coalesce(array_contains({added[cat]}, {f['source']}), false)")
        return "(" + " OR ".join(parts) + ")" if parts else "false"

    lines = [f"WHEN {f['medium']} IS NULL OR {f['source']} IS NULL OR {f['campaign']} IS NULL THEN NULL"]
    for label, cond in rules(fix_push_rule):
        lines.append(f"WHEN {_render_sql(cond, f, site)} THEN {_quote(label)}")
    fallback = f"concat({_quote(NOT_MATCHED_PREFIX)}, {f['source']}, '/', {f['medium']}, '/', {f['campaign']}, ')')"
    return "CASE " + " ".join(lines) + f" ELSE {fallback} END"
