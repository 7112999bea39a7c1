"""Comment rows and tag counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.config import JobConfig


def comment_roles(texts: DataFrame, cfg: JobConfig | None = None) -> DataFrame:
    """``(page, pos, text)`` of comment blocks to rows with their role.

    The reset caption closes a comment; the first kept text after it is the
    author, the rest are bodies. The window spans one page, never a blog.
    """
    cfg = cfg or JobConfig()
    in_page = Window.partitionBy("page").orderBy("pos")
    grouped = texts.withColumn(
        "comment",
        F.sum((F.col("text") == cfg.comment_reset).cast("bigint")).over(in_page),
    )
    kept = grouped.filter(~F.col("text").isin(*cfg.comment_noise) & (F.col("text") != ""))
    in_comment = Window.partitionBy("page", "comment").orderBy("pos")
    return kept.withColumn(
        "role", F.when(F.row_number().over(in_comment) == 1, "author").otherwise("body")
    )


def comment_rows(texts: DataFrame, cfg: JobConfig | None = None) -> DataFrame:
    """One row per comment: ``page, comment, author, content``."""
    roles = comment_roles(texts, cfg)
    bodies = F.array_sort(
        F.collect_list(F.when(F.col("role") == "body", F.struct("pos", "text")))
    )
    return roles.groupBy("page", "comment").agg(
        F.min(F.when(F.col("role") == "author", F.col("text"))).alias("author"),
        F.array_join(F.transform(bodies, lambda b: b["text"]), "\n").alias("content"),
    )


def tag_counts(articles: DataFrame) -> DataFrame:
    """How often each tag is used per blog (A1)."""
    return (
        articles.select("blog", F.explode("tags").alias("tag"))
        .groupBy("blog", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )
