"""The page store: one row a page, bucketed and sorted by the hash of its URL.

The store is written once with one shuffle of the bodies. From then on a lookup
joins bucket by bucket: wanted rows, which are narrow, go to the store's buckets
and are built into a hash table there, while bodies stream past where they lie;
none is shuffled or sorted. What decides about a page without its body, whether it
can be read and has a title, are columns of their own, so choosing pages reads no
body at all.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import schemas, tables
from pageloom.functions import text, urls

#: Buckets of a store: some 100 MB of bodies each is a good size.
BUCKETS = 64
#: Wanted rows of one page that one task joins.
HOT_ROWS = 100_000


def store_columns(pages: DataFrame) -> DataFrame:
    """``schemas.PAGE_STORE`` rows of ``pages(url, html)``, or of a cache with ``url_md5`` and ``html``.

    Missing columns are null, one beside the known ones is left out.
    """
    known = set(pages.columns)
    rows = pages
    if "url" not in known:
        rows = rows.withColumn("url", F.lit(None).cast("string"))
    if "url_md5" not in known:
        rows = rows.withColumn("url_md5", urls.url_md5(F.col("url")))
    if "page_id" not in known:
        rows = rows.withColumn("page_id", F.lit(None).cast("bigint"))
    if "blog" not in known:
        rows = rows.withColumn("blog", urls.blog_of(F.col("url")))
    readable = text.is_parseable(F.col("html"))
    return rows.select(
        "url_md5",
        "page_id",
        "blog",
        "url",
        readable.alias("readable"),
        (readable & (text.title_tag(F.col("html")) != "")).alias("titled"),
        "html",
    )


def one_copy(pages: DataFrame) -> DataFrame:
    """One row per ``url_md5``: the copy of the smallest id, null first, then of the smallest hash.

    Copies are combined before the shuffle, so a page stored very often is one row a task.
    """
    rest = [c for c in pages.columns if c != "url_md5"]
    copy = F.struct(*(F.col(c) for c in rest))
    order = F.struct("page_id", F.xxhash64(*rest))
    return pages.groupBy("url_md5").agg(F.min_by(copy, order).alias("__one")).select("url_md5", "__one.*")


def write_store(pages: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write a store of ``pages`` below ``path``, publish it, and open it.

    ``buckets`` is kept with the table. Pages without a URL are kept under a null key.
    Null bodies stay; they are not readable.
    """
    spark = pages.sparkSession
    folder = tables.part_name(spark, path)
    width = spark.conf.get("spark.sql.shuffle.partitions")
    # As many shuffle partitions as buckets, so that a bucket is one file.
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    try:
        (
            one_copy(store_columns(pages))
            .write.bucketBy(buckets, "url_md5")
            .sortBy("url_md5")
            .format("parquet")
            .mode("overwrite")
            .option("parquet.bloom.filter.enabled#url_md5", "true")
            .option("path", f"{path}/{folder}")
            .saveAsTable(_name(path, folder))
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    tables.publish(spark, path, {"folder": folder, "buckets": buckets})
    return open_store(spark, path)


def _name(path: str, folder: str) -> str:
    return f"page_store_{hashlib.md5(f'{path}/{folder}'.encode()).hexdigest()}"


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The published store at ``path``: ``schemas.PAGE_STORE``, one row per ``url_md5``.

    A session that doesn't know the table yet is told its buckets by the pointer.
    """
    version, facts = tables.published(spark, path)
    if not version:
        raise ValueError(f"no page store at {path}")
    name = _name(path, facts["folder"])
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.PAGE_STORE)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (url_md5) SORTED BY (url_md5) "
            f"INTO {facts['buckets']} BUCKETS LOCATION '{path}/{facts['folder']}'"
        )
    return spark.table(name)


def fetch_bodies(wanted: DataFrame, store: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with ``url_md5`` and, from an opened store, their ``page_id`` and ``html``.

    ``wanted`` should be staged: it is read twice, the first time to find pages asked
    for more than ``HOT_ROWS`` times. Those are at most rows / ``HOT_ROWS``; their rows
    are salted and their bodies copied to each salt. All others are joined in the
    store's own buckets.
    """
    bodies = store.select("url_md5", "page_id", "html")
    rows = wanted.drop("page_id", "html")
    hot = [
        (r["url_md5"], -(-r["n"] // HOT_ROWS))
        for r in rows.groupBy("url_md5").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).collect()
        if r["url_md5"] is not None
    ]
    if not hot:
        return rows.hint("shuffle_hash").join(bodies, "url_md5", how)
    spark = wanted.sparkSession
    salts = F.broadcast(spark.createDataFrame(hot, "url_md5 string, salts int"))
    marked = rows.join(salts, "url_md5", "left")
    cold = marked.filter("salts is null").drop("salts")
    salted = marked.filter("salts is not null").withColumn("salt", (F.rand(7) * F.col("salts")).cast("int"))
    copies = bodies.join(salts, "url_md5").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    spread = salted.drop("salts").join(copies.drop("salts"), ["url_md5", "salt"], how).drop("salt")
    return cold.hint("shuffle_hash").join(bodies, "url_md5", how).unionByName(spread)
