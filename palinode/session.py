"""Session settings, table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "palinode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; cluster settings win when given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # hash instead of sort where every partition of the smaller side is known to be small
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a table that comes in fewer files than there are cores (a one-file sample), so that heavy
    per-row work runs on all of them. A sharded corpus has files enough and is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores <= 64:
        return df.repartition(cores, key)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """A table of the data folder, optionally spread."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df, spread_by) if spread_by else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of `spark.checkpoint.dir`; only a local master may fall back to a temp folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palinode-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for results that must go through files."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{name}-{uuid.uuid4().hex}"
