"""A session with the settings the engine is written for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Adaptive execution on, UTC, and as many shuffle partitions as given; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


@lru_cache(4)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the one named by ``spark.checkpoint.dir``. Where it is unset, one of
    this machine serves a session whose tasks all run in this process; on a cluster that is an error.
    """
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rsplit("/", 1)[0]  # Spark adds a folder of its own
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder(context.applicationId)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows doesn't compute it again, and any executor can be lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
