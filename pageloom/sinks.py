"""Parquet and text sinks (K1-K3).

Tables are partitioned by a bucket of the blog, not by the blog itself: the
number of folders stays fixed however many blogs there are, and a reader of one
blog still prunes to one bucket. The rebalance step lets adaptive execution
join small buckets and split the bucket of a very large blog over tasks. Rows are
sorted by blog inside a file, so that its row groups prune too. A write is
published at once, together with its bucket count and order (``tables``), so a
reader needs to know the folder only and never sees half a write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import tables

BUCKETS = 64


def blog_bucket(blog: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(blog), F.lit(buckets)).cast("int")


def _write(
    df: DataFrame, path: str, buckets: int, mode: str, order: Sequence[str] = ("blog",), form: str = "parquet"
) -> None:
    """Write a part, then publish it with its bucket count and order."""
    spark = df.sparkSession
    folder = tables.part_name(spark, path)
    (
        df.withColumn("blog_bucket", blog_bucket(F.col("blog"), buckets))
        .hint("rebalance", "blog_bucket")
        .sortWithinPartitions("blog_bucket", *order)
        .drop(*(c for c in order if form == "text"))
        .write.mode("overwrite")
        .partitionBy("blog_bucket")
        .format(form)
        .save(f"{path}/{folder}")
    )
    before = tables.published(spark, path)[1].get("parts", []) if mode == "append" else []
    part = {"folder": folder, "buckets": buckets, "order": list(order)}
    tables.publish(spark, path, {"parts": [*before, part]})


def write_table(
    table: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite"
) -> None:
    """Any table with a ``blog``."""
    _write(table, path, buckets, mode)


def write_articles(
    articles: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite"
) -> None:
    """Article table (K1)."""
    _write(articles, path, buckets, mode)


def write_book(
    books: DataFrame,
    chapters: DataFrame,
    images: DataFrame,
    path: str,
    buckets: int = BUCKETS,
    mode: str = "overwrite",
) -> None:
    """Book, chapter and image-manifest tables below one folder (K2)."""
    for name, table in (("books", books), ("chapters", chapters), ("images", images)):
        _write(table, f"{path}/{name}", buckets, mode)


def write_chapters_text(
    chapters: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite"
) -> None:
    """Chapter XHTML, one chapter per line, led by its blog and file, in chapter order (K3)."""
    line = F.concat_ws(
        "\t", "blog", "href", F.regexp_replace("xhtml", r"\s*[\r\n\t]\s*", " ")
    )
    lines = chapters.select(line.alias("value"), "blog", "number")
    _write(lines, path, buckets, mode, ("blog", "number"), "text")


def _parts(spark: SparkSession, path: str) -> list[dict]:
    parts = tables.published(spark, path)[1].get("parts")
    if parts is None:
        raise ValueError(f"no published table at {path}")
    return parts


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the published version of a table."""
    return tables.read_parts(spark, path, _parts(spark, path)).drop("blog_bucket")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a published text table."""
    return spark.read.text([f"{path}/{p['folder']}" for p in _parts(spark, path)]).select("value")


def read_blog(spark: SparkSession, path: str, blog: str) -> DataFrame:
    """Rows of one blog; of each part only the blog's bucket is read.

    A part's own bucket count is used, as kept with the table.
    """
    parts = _parts(spark, path)
    frames = []
    for part in parts:
        bucket = spark.range(1).select(blog_bucket(F.lit(blog), part["buckets"])).first()[0]
        rows = tables.read_parts(spark, path, [part])
        frames.append(rows.filter((F.col("blog_bucket") == bucket) & (F.col("blog") == blog)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.drop("blog_bucket")
