"""SparkSession helpers.

The jobs themselves never change session settings; these helpers are for
scripts, the benchmark and the tests.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the jobs are designed around. AQE re-plans joins from runtime sizes
# (its broadcast conversion is the size check for every small side), coalesces
# shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the event_date partition column holds yyyyMMdd strings; never let it be
    # inferred as an integer
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.ui.enabled": "false",
    # Batch jobs with many short stages: keep the driver's status store small,
    # or every finished job/stage/task it retains slows later jobs down.
    "spark.ui.retainedJobs": "50",
    "spark.ui.retainedStages": "100",
    "spark.ui.retainedTasks": "2000",
    "spark.sql.ui.retainedExecutions": "20",
}


def get_session(
    master: str | None = None,
    app_name: str = "touchline",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str | None:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    A default is only applied when the session has none (tests, local runs).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if default:
        spark.conf.set("spark.checkpoint.dir", default)
        spark.sparkContext.setCheckpointDir(default)
    return default


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session (tests) gets a
    temporary folder; a cluster session must name a shared one."""
    path = checkpoint_dir(spark)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return checkpoint_dir(spark, default="file://" + tempfile.mkdtemp(prefix="touchline-shared-"))
