"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Masters that run everything in one process of this machine.
LOCAL_MASTER = re.compile(r"local(\[.*\])?$")

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Bytes of whole pages that go to a Python worker at a time, which holds two such batches.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PAGE_BATCH = str(4 << 20)

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, whatever folder they start in."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = os.path.join(tempfile.mkdtemp(prefix="pageloom-"), package.name)
    archive = shutil.make_archive(base, "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def batch_pages(spark: SparkSession, pages: bool) -> None:
    """Small Arrow batches for queries that read ``pages`` row by row, else the session's own.

    A size that the user sets on the session is only replaced for the former.
    """
    if pages:
        spark.conf.set(ARROW_BYTES, PAGE_BATCH)
    elif spark.conf.get(ARROW_BYTES, None) == PAGE_BATCH:
        own = spark.sparkContext.getConf().get(ARROW_BYTES)
        spark.conf.set(ARROW_BYTES, own) if own else spark.conf.unset(ARROW_BYTES)


def prepare_session(spark: SparkSession, pages: bool = False) -> SparkSession:
    """Runtime settings the engine relies on; safe to call repeatedly.

    Only settings that change results (the time zone), that let Spark re-plan
    skewed stages or that bound what a Python worker holds of whole ``pages`` are
    touched. Shuffle width stays the cluster's choice.
    """
    ship_package(spark)
    batch_pages(spark, pages)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # Streams keep what they have seen on disk, not in the heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing and all work is done on this machine (a local
    master), a fresh temporary folder is used and remembered on the session. On
    a cluster that would lose rows without an error, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not LOCAL_MASTER.match(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pageloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Used where several steps read the same computed rows: they are computed
    once, and a lost executor costs a file read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
