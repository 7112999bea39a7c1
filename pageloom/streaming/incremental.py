"""Incremental runs over newly stored pages.

Every stream reads new page files, keeps its progress in a checkpoint folder
and stops when it has caught up. Results are Parquet tables; nothing is
gathered on the driver. A batch that is repeated after a failure overwrites its
own output, so results do not depend on retries. Tables that a batch changes are
published at once (``keyed``, ``seen``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.config import JobConfig
from pageloom.functions import text, urls
from pageloom.operators.extract import extract_articles
from pageloom.operators.ranking import rank_by_seq
from pageloom.session import scratch_path, staged
from pageloom.streaming import keyed, seen


def stream_pages(
    spark: SparkSession, folder: str, glob: str = "*.parquet", max_files: int | None = None
) -> DataFrame:
    """Stream of stored pages with blog and position."""
    reader = spark.readStream.schema(schemas.PAGES).option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder).select(
        urls.blog_of(F.col("url")).alias("blog"),
        F.col("page_id").alias("seq"),
        "url",
        urls.url_md5(F.col("url")).alias("url_md5"),
        "html",
    )


def stream_articles(pages: DataFrame, cfg: JobConfig) -> DataFrame:
    """Article rows of a page stream; the batch extraction, unchanged."""
    return extract_articles(pages, cfg)


def stream_dedupe(pages: DataFrame, event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """First arrival of every page.

    With an event time the seen-set is bounded by the watermark. Without one the
    stream's state would be a row a page for ever: use :func:`run_dedupe`, which
    asks a Bloom filter and the published rows instead; this form is for short
    streams.
    """
    if event_time is None:
        return pages.dropDuplicates(["url_md5"])
    return pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url_md5"])


def stream_tag_counts(articles: DataFrame) -> DataFrame:
    """Running tag counts; partial sums are combined before the shuffle (T4)."""
    return (
        articles.select("blog", F.explode("tags").alias("tag"))
        .groupBy("blog", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stream_span(articles: DataFrame) -> DataFrame:
    """Running article count and date span per blog (T5)."""
    return articles.groupBy("blog").agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
    )


def run_append(df: DataFrame, out: str, checkpoint: str) -> None:
    """Run an append stream to its end into a Parquet table."""
    query = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _run_batches(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str
) -> None:
    query = (
        df.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_latest(df: DataFrame, out: str, checkpoint: str, keys: Sequence[str]) -> None:
    """Run a running aggregate into a keyed table at ``out``.

    Each batch writes the rows it changed and publishes them; see ``keyed`` for how
    they are merged. ``read_latest`` gives the newest row of each key.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        keyed.write_changes(batch, out, keys, batch_id)

    _run_batches(df, handle, checkpoint, "update")


def run_dedupe(pages: DataFrame, out: str, checkpoint: str) -> None:
    """First arrival of every page, exact and without an event time.

    Published rows are read with ``seen.published_rows``.
    """
    _run_batches(pages, lambda batch, batch_id: seen.add_batch(batch, out, batch_id), checkpoint, "append")


def run_limit(
    pages: DataFrame, limit: str, out: str, checkpoint: str, cfg: JobConfig | None = None
) -> None:
    """First ``limit`` parseable pages of every blog over all batches.

    With ``cfg`` their articles are extracted too, from the same batch; other pages
    never reach Python. The state is a keyed table of pages kept per blog, one row a
    blog. Inside a batch rows are numbered by chunks, so a blog with most of the
    pages is not one task's work; earlier batches only shift its numbers. The
    state's pointer publishes a batch's rows and articles too: ``read_limit`` never
    sees part of a batch, and a repeated batch writes the same rows again.
    """
    spark = pages.sparkSession
    state_path = f"{out}/state"
    n = F.greatest(urls.parse_limit(F.lit(limit)), F.lit(1))

    def handle(batch: DataFrame, batch_id: int) -> None:
        last = keyed.last_batch(spark, state_path)
        if batch_id <= last:
            return
        narrow = batch.filter(text.is_parseable(F.col("html"))).select(
            "blog", "seq", "url", "url_md5"
        )
        numbered = rank_by_seq(staged(narrow, "batch"), "blog", "seq", "number")
        before = spark.createDataFrame([], "blog string, n bigint")
        if last >= 0:
            before = keyed.read_latest(spark, state_path, ["blog"])
        numbered = numbered.join(before.withColumnRenamed("n", "before"), "blog", "left").withColumn(
            "number", F.col("number") + F.coalesce("before", F.lit(0))
        )
        if limit.isdigit():
            numbered = numbered.filter(F.col("number") <= n)
        target = f"{out}/rows/batch={batch_id}"
        numbered.write.mode("overwrite").parquet(target)
        kept = spark.read.schema(numbered.schema).parquet(target)
        if cfg is not None:
            wanted = batch.join(kept.select("blog", "seq", "url_md5"), ["blog", "seq", "url_md5"], "left_semi")
            extract_articles(wanted.drop("url_md5"), cfg).write.mode("overwrite").parquet(
                f"{out}/articles/batch={batch_id}"
            )
        totals = kept.groupBy("blog").agg(F.max("number").cast("bigint").alias("n"))
        keyed.write_changes(totals, state_path, ["blog"], batch_id)

    _run_batches(pages, handle, checkpoint, "append")


def read_limit(spark: SparkSession, out: str, table: str = "rows") -> DataFrame:
    """``rows`` or ``articles`` of published batches, with their ``batch``."""
    last = keyed.last_batch(spark, f"{out}/state")
    if last < 0:
        raise ValueError(f"no published batch at {out}")
    return spark.read.parquet(f"{out}/{table}").filter(F.col("batch") <= last)


def new_run(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh output and checkpoint folders in the shared folder."""
    return scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")


