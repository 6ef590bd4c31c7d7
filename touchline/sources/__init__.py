from touchline.sources.export import (
    read_export,
    write_export,
    shard_between,
    shard_day,
    shard_prefix,
)
from touchline.sources.fixture import export_from_test_events, read_test_events

__all__ = [
    "read_export",
    "write_export",
    "shard_between",
    "shard_day",
    "shard_prefix",
    "export_from_test_events",
    "read_test_events",
]
