"""Session settings the library relies on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", partitions: int = 8, **options: str) -> SparkSession:
    """A session for local work: UTC, adaptive plans, few shuffle partitions."""
    b = SparkSession.builder.master(master).appName("threadlake")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, x in (conf | options).items():
        b = b.config(k, x)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local session that has none uses /tmp/checkpoints."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, unless the session has a folder for them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as Parquet in the shared folder: cuts lineage, survives lost executors, and its size is known anew.

    The size is why loops use this and not checkpoint(): what is read from a checkpoint keeps the estimate of its plan, which
    a join squares, so that after some rounds the planner works on numbers of many thousand digits.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
