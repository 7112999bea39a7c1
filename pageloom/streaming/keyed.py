"""Keyed tables kept up to date by batches of changes, log-structured.

A batch of changed rows is written as it is. After ``MERGE_EVERY`` batches the
changes are merged, newest row of a key last, into a base that is cut into
buckets by key; only buckets that changed are written anew. One pointer names the
base's buckets and the batches since (``tables``), so a batch and its merge are
seen at once or not at all, and what a reader opens is bounded by the number of
buckets and ``MERGE_EVERY``, however many batches there were. Every key has one
row in the base: the state grows with the keys, not with time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import tables
from pageloom.session import staged

BUCKETS = 32
MERGE_EVERY = 8


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the last published batch, -1 before the first."""
    return tables.published(spark, path)[1].get("last", -1)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _newest(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of the last frame that holds each key; a frame holds a key once."""
    numbered = [df.withColumn("__at", F.lit(k)) for k, df in enumerate(frames)]
    rows = reduce(DataFrame.unionByName, numbered)
    rest = [c for c in rows.columns if c not in (*keys, "__at")]
    newest = F.max_by(F.struct(*rest), "__at").alias("__newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "__newest.*")


def _frames(spark: SparkSession, path: str, facts: dict, buckets: Sequence[str] | None = None) -> list[DataFrame]:
    """The base, or some of its buckets, and then each batch since."""
    reader = spark.read.schema(T.StructType.fromJson(facts["schema"]))
    base = [f"{path}/{folder}" for b, folder in sorted(facts["base"].items()) if buckets is None or b in buckets]
    return ([reader.parquet(*base)] if base else []) + [reader.parquet(f"{path}/{f}") for f in facts["batches"]]


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row of each key, as of the last published batch."""
    _, facts = tables.published(spark, path)
    if not facts:
        raise ValueError(f"no published table at {path}")
    frames = _frames(spark, path, facts)
    return frames[0] if len(frames) == 1 else _newest(frames, keys)


def write_changes(
    changes: DataFrame, path: str, keys: Sequence[str], batch: int, buckets: int = BUCKETS, every: int = MERGE_EVERY
) -> None:
    """Publish the changed rows of a batch, one row a key, null keys among them.

    A batch that was published before is left alone; one that died half way is
    written again. Folders that a merge replaced are deleted by the next merge, so
    readers that started before can finish.
    """
    spark = changes.sparkSession
    _, facts = tables.published(spark, path)
    if batch <= facts.get("last", -1):
        return
    facts = {"base": {}, "batches": [], "dead": [], **facts, "schema": changes.schema.jsonValue()}
    folder = f"changes-{batch}"
    changes.write.mode("overwrite").parquet(f"{path}/{folder}")
    facts["batches"] = [*facts["batches"], folder]
    gone: list[str] = []
    if len(facts["batches"]) >= every:
        gone, facts = facts["dead"], _merged(spark, path, facts, keys, batch, buckets)
    tables.publish(spark, path, {**facts, "last": batch})
    for name in gone:
        _delete(spark, f"{path}/{name}")


def _merged(spark: SparkSession, path: str, facts: dict, keys: Sequence[str], batch: int, buckets: int) -> dict:
    """Facts after the batches have been merged into the buckets that they change."""
    recent = _newest(_frames(spark, path, {**facts, "base": {}}), keys)
    recent = staged(recent.withColumn("__bucket", _bucket(keys, buckets)), "changes")
    touched = [str(r[0]) for r in recent.select("__bucket").distinct().collect()]  # at most ``buckets``
    old = _frames(spark, path, {**facts, "batches": []}, touched)
    frames = [*old, recent.drop("__bucket")]
    merged = _newest(frames, keys).withColumn("__bucket", _bucket(keys, buckets))
    folder = f"base-{batch}"
    (
        merged.repartition("__bucket")
        .write.mode("overwrite")
        .partitionBy("__bucket")
        .parquet(f"{path}/{folder}")
    )
    dead = [*facts["batches"], *(facts["base"][b] for b in touched if b in facts["base"])]
    base = {**facts["base"], **{b: f"{folder}/__bucket={b}" for b in touched}}
    return {**facts, "base": base, "batches": [], "dead": dead}


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the table, in whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
