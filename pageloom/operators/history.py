"""Crawl history and batch offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls


def history_rollup(log: DataFrame) -> DataFrame:
    """Use count and last use per URL."""
    return log.groupBy("url").agg(
        F.count(F.lit(1)).alias("used"), F.max("ts").alias("last")
    )


def distinct_history(history: DataFrame) -> DataFrame:
    """Normalised distinct blog URLs."""
    return history.select(urls.blog_of(F.col("url")).alias("url")).distinct()


def append_history(history: DataFrame, new: DataFrame) -> DataFrame:
    """History plus the URLs it does not hold yet (K4, U4)."""
    fresh = new.filter(F.col("url") != "").select("url").distinct()
    return history.select("url").unionByName(fresh.join(history, "url", "left_anti"))


def next_offset(config: DataFrame) -> DataFrame:
    """``(blog, limit, skip)`` strings to the next batch's ``next_skip``.

    Without a positive limit the skip stays as it is.
    """
    limit = urls.parse_limit(F.col("limit"))
    skip = F.coalesce(urls.parse_skip(F.col("skip")), F.lit(0))
    return config.withColumn(
        "next_skip",
        F.when(limit > 0, limit + skip).otherwise(skip).cast("bigint"),
    )
