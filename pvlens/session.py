"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every pvlens job expects; cluster launchers may override any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "pvlens",
              shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the pvlens defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        merged["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    merged.update(conf)
    for k, v in merged.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    tune_session(spark)
    checkpoint_dir(spark)
    return spark


# Catalyst adds ``size(arr) > 0`` below every explode of an array attribute
# and then pushes it through the projection that computes the array — so a
# regex-built array (entities, symptoms, word lists) is computed twice per
# row, the first time before any repartitioning. Our explodes never need the
# early filter; the explode itself drops empty arrays.
EXCLUDED_RULES = ["org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"]


def tune_session(spark: SparkSession) -> None:
    """Settings of a session that pvlens builds itself; a caller's session is
    left as it is (results do not depend on them)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = "spark.sql.optimizer.excludedRules"
    current = [r for r in (spark.conf.get(key, "") or "").split(",") if r]
    missing = [r for r in EXCLUDED_RULES if r not in current]
    if missing:
        spark.conf.set(key, ",".join(current + missing))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (``spark.checkpoint.dir``).

    Only a local session, whose driver and tasks are one process, may do
    without: it gets a temporary folder. On a cluster a folder of one machine
    would be lost to the others, so an unset folder is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="pvlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for job outputs that
    must be re-read (sinks, stream sources, lineage cuts)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def session_setting(spark: SparkSession, name: str, value: str):
    """A setting of the caller's session that holds within the block and is put back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again:
    its lineage is cut and an executor that is lost takes nothing with it. The
    shuffle files of the write are dropped when it ends."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with session_setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
