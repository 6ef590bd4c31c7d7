from touchline.functions.params import event_param, session_id, page_location
from touchline.functions.timefn import (
    micros_to_timestamp,
    whole_minutes_between,
    shift_date_key,
)
from touchline.functions.channels import (
    SiteLists,
    default_channel_grouping,
    channel_case_sql,
    read_site_lists,
    site_lists,
)

__all__ = [
    "event_param",
    "session_id",
    "page_location",
    "micros_to_timestamp",
    "whole_minutes_between",
    "shift_date_key",
    "SiteLists",
    "default_channel_grouping",
    "channel_case_sql",
    "read_site_lists",
    "site_lists",
]
