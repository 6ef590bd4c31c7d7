"""Reading an event export and selecting date shards.

A warehouse export is one table per day (`events_YYYYMMDD`) addressed by exact
name, prefix wildcard or suffix range. Here it is one parquet dataset
partitioned by `event_date` (yyyyMMdd string); the three address forms become
filters on the partition column, which Catalyst turns into PartitionFilters,
so a job reads only the shards it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.schema import EVENT


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Date-partitioned export. The schema is given explicitly so the
    partition column stays a string and nested fields are not inferred per
    file; nested-column pruning then reads only the fields a job touches."""
    return spark.read.schema(EVENT).option("basePath", path).parquet(path)


def write_export(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write export-shaped rows as a dataset partitioned by event_date."""
    df.write.mode(mode).partitionBy("event_date").parquet(path)


def _date(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def shard_between(
    df: DataFrame, start: str | None, end: str | None, date_col: str = "event_date"
) -> DataFrame:
    """Inclusive lexical suffix range (`_table_suffix BETWEEN a AND b`). None is
    no bound on that side; without any, every row stays, also one without a date."""
    if start is not None:
        df = df.filter(_date(date_col) >= F.lit(start))
    if end is not None:
        df = df.filter(_date(date_col) <= F.lit(end))
    return df


def shard_day(df: DataFrame, day: str, date_col: str = "event_date") -> DataFrame:
    """One exact shard (`events_YYYYMMDD`)."""
    return df.filter(_date(date_col) == F.lit(day))


def shard_prefix(df: DataFrame, prefix: str, date_col: str = "event_date") -> DataFrame:
    """Every shard whose suffix starts with `prefix` (`events_202310*`)."""
    return df.filter(_date(date_col).startswith(prefix))
