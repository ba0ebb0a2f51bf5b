"""Session helpers: defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def local_session(cpus: str | int = 8, app: str = "karyospark", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the cluster names it.

    Only a local session may do without the setting (tests, one machine): it gets a fresh folder for its lifetime.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="karyospark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other job uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df, name: str):
    """Cut lineage by writing a table to the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, *keys: str, per_core: int = 2):
    """Hash-partition by keys into a fixed number of tasks.

    For work that is heavy in CPU but light in bytes (long windows, grouped Python): left to
    itself the adaptive planner would fold such small data into one task. At least the session's
    shuffle partitions, so a task's share of a large table does not depend on the cores alone.
    Steps that list many more rows than they read ask for more tasks `per_core`.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(per_core * spark.sparkContext.defaultParallelism, least), *keys)
