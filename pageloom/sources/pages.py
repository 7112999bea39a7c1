"""Page and seed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import text, urls


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The stored page table as it is: ``page_id, url, html``."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page store keyed by the hash of the URL."""
    return read_pages(spark, path).withColumn("url_md5", urls.url_md5(F.col("url")))


def blog_pages(pages: DataFrame) -> DataFrame:
    """``blog, seq, url, html``: pages in stored order, per blog."""
    return pages.select(
        urls.blog_of(F.col("url")).alias("blog"), F.col("page_id").alias("seq"), "url", "html"
    )


# The last hash-like part of a path: the file's own name, or its folder.
_PATH_HASH = r"^.*(?<![0-9a-f])([0-9a-f]{32})(?![0-9a-f])"


def scan_html_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached page files, plain or gzip, found by the hash in their path.

    The hash may be the file's name or the folder it lies in.
    """
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{html,txt,gz}")
        .text(folder, wholetext=True)
    )
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), _PATH_HASH, 1).alias("url_md5"),
        F.col("value").alias("html"),
    )


def scan_html_cache_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Plain cached files whose bytes may not be UTF-8 (S2 with X13)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.html").load(folder)
    )
    return files.select(
        F.regexp_extract("path", _PATH_HASH, 1).alias("url_md5"),
        text.clever_decode(F.col("content")).alias("html"),
    )


#: Leading hash digits that name a shard of a page cache: 256 shards of many pages each.
SHARD_DIGITS = 2


def write_html_shards(pages: DataFrame, folder: str) -> None:
    """Pages cached by the hash of their URL, many to a file.

    One folder per leading hash digits, however many pages there are; inside,
    rows are sorted by hash, so a reader of one page skips most of its shard.
    """
    (
        pages.select("url_md5", "html")
        .withColumn("shard", F.substring("url_md5", 1, SHARD_DIGITS))
        .hint("rebalance", "shard")
        .sortWithinPartitions("shard", "url_md5")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(folder)
    )


def scan_html_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``url_md5, html`` of a sharded page cache."""
    stored = "url_md5 string, html string, shard string"
    return spark.read.schema(stored).parquet(folder).select("url_md5", "html")


def normalize_seeds(seeds: DataFrame) -> DataFrame:
    """Seed rows with blog key and port, one per blog and setting."""
    return (
        seeds.withColumn("norm", urls.normalize_blog_url(F.col("url")))
        .select(F.col("norm.url").alias("blog"), F.col("norm.port").alias("port"), "limit", "skip")
        .distinct()
    )


def scan_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed list from CSV (with header) or Parquet."""
    reader = spark.read.schema(schemas.SEEDS)
    raw = reader.csv(path, header=True) if path.endswith(".csv") else reader.parquet(path)
    return normalize_seeds(raw)
