"""A whole run: numbered inventory to chapters, for all blogs at once.

Everything that orders, skips, limits and numbers happens on narrow rows. Page
bodies are then fetched once for the pages that are really wanted, extracted
row by row and turned into chapters in the same stage: one wide shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom import sinks
from pageloom.config import JobConfig
from pageloom.functions import markup, urls
from pageloom.operators import books, comments, extract, images
from pageloom.session import staged
from pageloom.sources.store import fetch_bodies

def blog_settings(seeds: DataFrame) -> DataFrame:
    """``(blog, first, most)`` of each blog's typed skip and limit.

    ``seeds(blog, limit, skip)`` are strings; of several settings of a blog the
    smallest pair counts.
    """
    one = seeds.groupBy("blog").agg(F.min(F.struct("limit", "skip")).alias("s"))
    return one.select(
        "blog",
        urls.parse_skip(F.col("s.skip")).alias("first"),
        urls.parse_limit(F.col("s.limit")).alias("most"),
    )


def chapter_plan(
    pages: DataFrame,
    store: DataFrame,
    cfg: JobConfig,
    blogs: DataFrame | None = None,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """``blog, seq, url, url_md5, page_id`` of every chapter with its number and places.

    ``pages(blog, seq, url, url_md5)`` is the numbered inventory, ``store`` an opened
    page store. Pages that are
    missing or unreadable never count towards the limit (W1, F5, W2, W3, W4).
    ``seeds`` gives blogs a skip and a limit of their own, in place of those of
    the job. ``blogs`` adds each blog's title and language while rows are still
    narrow.
    """
    wanted = pages.select("blog", "seq", "url", "url_md5")
    first = urls.parse_skip(F.lit(cfg.skip))
    most = urls.parse_limit(F.lit(cfg.limit))
    if seeds is None:
        wanted = wanted.withColumns({"first": first, "most": most})
    else:
        own = blog_settings(seeds).withColumn("seeded", F.lit(True))
        pick = F.when(F.col("seeded"), F.col("first")).otherwise(first)
        limit = F.when(F.col("seeded"), F.col("most")).otherwise(most)
        wanted = wanted.join(own, "blog", "left").withColumns({"first": pick, "most": limit}).drop("seeded")
    wanted = wanted.filter(F.col("seq") > F.coalesce("first", F.lit(0))).drop("first")
    # Written once: ranking reads these rows twice. No body is read for them.
    readable = store.filter("readable").select("url_md5", "page_id")
    found = staged(wanted.join(readable, "url_md5"), "readable")
    limit = F.greatest("most", F.lit(1))  # checked after a page has been read
    numbered = books.number_chapters(found)
    kept = numbered.filter(F.col("most").isNull() | (F.col("number") <= limit)).withColumn(
        "n_chapters", F.when(F.col("most").isNull(), F.col("n_chapters")).otherwise(F.least("n_chapters", limit))
    )
    plan = books.toc_spine(kept.drop("most"))
    return plan if blogs is None else extract.with_blog_meta(plan, blogs)


def chapter_rows(plan: DataFrame, store: DataFrame, cfg: JobConfig) -> DataFrame:
    """Article and chapter columns of a (staged) chapter plan."""
    places = ("number", "uid", "href", "toc_pos", "spine_pos")
    pages = fetch_bodies(plan, store).withColumn("place", F.struct(*places))
    articles = extract.extract_articles(pages, cfg, keep=("place",))
    return articles.withColumn(
        "xhtml",
        markup.chapter_xhtml(
            *(
                F.col(c)
                for c in ("title", "tags", "date", "accessed", "url", "content", "comments")
            )
        ),
    ).select("*", "place.*").drop("place")


def book_rows(chapters: DataFrame, blogs: DataFrame) -> DataFrame:
    """Book table of a written chapter table, with file names made unique."""
    return books.dedupe_names(books.assemble_books(chapters, blogs))


def image_rows(articles: DataFrame) -> DataFrame:
    """Images of extracted articles; ``pos`` is the article's and the image's place in it."""
    return images.article_images(articles).withColumn("pos", F.struct("seq", "pos"))


def header_rows(pages: DataFrame) -> DataFrame:
    """Header images of each blog's chosen page, as ``blog, url, description``."""
    return pages.select("blog", F.explode("header_images").alias("url")).select(
        "blog",
        urls.absolute_image_url(F.col("url"), F.col("blog")).alias("url"),
        F.lit("").alias("description"),
    )


def write_run(articles: DataFrame, blogs: DataFrame, cfg: JobConfig, path: str) -> None:
    """All tables of a run, made of its extracted articles, below ``path``.

    ``books``, ``chapters``, ``images`` (the manifest), ``image_set`` (article and
    header images, distinct), ``covers`` (cover slots) and ``tags`` (counts).
    ``blogs`` is the metadata that extraction found. Both are staged once: every
    table reads the written rows, no page is extracted again.
    """
    articles, blogs = staged(articles, "articles"), staged(blogs, "blogs")
    found = staged(image_rows(articles), "images")
    shown = found if cfg.include_images else found.filter("false")
    chapters = books.build_chapters(articles, cfg)
    manifest = images.manifest_images(shown)
    sinks.write_book(book_rows(articles, blogs), chapters, manifest, path)
    book_set = images.book_image_set(
        shown.select("blog", "url", "description"), header_rows(blogs)
    )
    sinks.write_table(book_set, f"{path}/image_set")
    sinks.write_table(images.cover_slots(shown), f"{path}/covers")
    sinks.write_table(comments.tag_counts(articles), f"{path}/tags")
