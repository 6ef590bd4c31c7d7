"""Export scans: exact shard, prefix wildcard and suffix range become
partition filters on event_date."""

import tempfile

from helpers import DAY, T0, ev, events_df
from touchline.functions.timefn import shift_date_key
from touchline.sources.export import read_export, shard_between, shard_day, shard_prefix, write_export


def test_shard_scans_prune_partitions(spark, scratch):
    rows = [ev(f"u{i}", T0 + i * 10 * DAY, "page_view", sid=i, page="p") for i in range(8)]
    path = tempfile.mkdtemp(prefix="export-", dir=scratch) + "/events"
    write_export(events_df(spark, rows), path)
    df = read_export(spark, path)
    assert dict(df.dtypes)["event_date"] == "string"
    days = sorted(r.event_date for r in df.select("event_date").collect())
    assert shard_day(df, days[2]).count() == 1
    assert shard_prefix(df, days[0][:6]).count() == sum(d.startswith(days[0][:6]) for d in days)
    assert shard_between(df, days[1], days[4]).count() == 4
    plan = shard_between(df, days[1], days[4])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    plan = shard_prefix(df, "2024")._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith(event_date" in plan


def test_history_bound():
    assert shift_date_key("20230723", -90) == "20230424"
