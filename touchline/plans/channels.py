"""Channel report: the default channel grouping applied to sessions after
last-non-direct fill, counted as distinct sessions per channel.

A session whose medium and source are still unknown after the fill is direct
traffic; the export spells that "(none)"/"(direct)", and an absent campaign
"(not set)", so those are the values classified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.functions.channels import SiteLists, default_channel_grouping, with_channel
from touchline.plans.sessions import BUCKET, SID, USER, filled_sessions, sessions_by

NO_MEDIUM, NO_SOURCE, NO_CAMPAIGN = "(none)", "(direct)", "(not set)"


def session_channels(
    events: DataFrame,
    start_date: str | None,
    end_date: str | None,
    sites: SiteLists | DataFrame,
    era: str = "post",
    history_days: int = 90,
    fix_push_rule: bool = False,
    keep_bucket: bool = False,
) -> DataFrame:
    filled = filled_sessions(events, start_date, end_date, era, history_days, True, keep_bucket)
    medium, source, campaign = (
        F.coalesce(F.col(c), F.lit(none)) for c, none in (("medium", NO_MEDIUM), ("src", NO_SOURCE), ("campaign", NO_CAMPAIGN))
    )
    if isinstance(sites, DataFrame):
        return with_channel(filled, medium, source, campaign, sites, fix_push_rule=fix_push_rule)
    channel = default_channel_grouping(medium, source, campaign, sites, fix_push_rule=fix_push_rule)
    kept = [BUCKET] if keep_bucket else []
    return filled.select(USER, SID, "medium", "src", "campaign", channel.alias("channel"), *kept)


def channel_report(
    events: DataFrame,
    start_date: str | None,
    end_date: str | None,
    sites: SiteLists | DataFrame,
    era: str = "post",
    history_days: int = 90,
    fix_push_rule: bool = False,
) -> DataFrame:
    """Sessions per channel; `sites` are lists or a `site_table`."""
    rows = session_channels(events, start_date, end_date, sites, era, history_days, fix_push_rule, keep_bucket=True)
    return sessions_by(rows, "channel").orderBy(F.desc("sessions"), F.asc("channel"))
