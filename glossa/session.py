"""Session helpers: building a session, reading tables, shared scratch paths.

Intermediate results that must survive executor loss are written under the
cluster's shared ``spark.checkpoint.dir``.  That setting is read from the
session; a private directory is configured only when it is unset (tests).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "glossa", driver_memory: str | None = None) -> SparkSession:
    """Session for local runs and tests.  On a cluster, pass no master and
    let the submit configuration decide; ``driver_memory`` only matters in
    local mode, where the driver JVM runs every task."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", driver_memory or "16g")
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediates.

    Uses the session's ``spark.checkpoint.dir``, else the directory its context was
    given; only a local master without either gets a private one, which goes with the
    process.
    """
    sc = spark.sparkContext
    root = spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError(f"set {_CKPT_KEY} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="glossa-ckpt-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(_CKPT_KEY, root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/glossa/{name}-{uuid.uuid4().hex[:12]}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: computed once, with a size that
    the planner knows (it broadcasts small tables by that, not by a promise)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)
