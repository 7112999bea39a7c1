"""Tables published by a pointer: a reader sees a whole version or the one before.

A table is a folder. Its rows lie in parts, folders that are never changed once
they are named; which parts count, and how they are dealt, is one JSON row, the
pointer. It is written to two slots in turn, so that while one slot is replaced
the other still holds the version before, and a pointer is two small files however
many versions there have been. A writer that dies half way leaves parts that
nothing names.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version bigint, facts string"


def published(spark: SparkSession, path: str) -> tuple[int, dict]:
    """``(version, facts)`` of the newest published version; version 0 has none."""
    newest: tuple[int, dict] = (0, {})
    for slot in (0, 1):
        try:
            rows = spark.read.schema(_POINTER).parquet(f"{path}/pointer/slot-{slot}").collect()
        except AnalysisException:  # never written, or being replaced
            continue
        except PySparkException as e:  # replaced between listing and reading
            if "FILE_NOT_EXIST" not in str(e) and "FileNotFound" not in str(e):
                raise
            continue
        for version, facts in rows:
            if version > newest[0]:
                newest = (version, json.loads(facts))
    return newest


def publish(spark: SparkSession, path: str, facts: dict) -> int:
    """Make ``facts`` the newest version; one writer at a time. The version's number."""
    version = published(spark, path)[0] + 1
    row = spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"), F.lit(json.dumps(facts)).alias("facts")
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer/slot-{version % 2}")
    return version


def part_name(spark: SparkSession, path: str) -> str:
    """Folder name for the next part; a writer that starts again after a failure gets it anew."""
    return f"part-{published(spark, path)[0] + 1}"


def read_parts(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    """Rows of the given parts, which need not have the same columns."""
    frames = [spark.read.parquet(f"{path}/{part['folder']}") for part in parts]
    if not frames:
        raise ValueError(f"no published table at {path}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
