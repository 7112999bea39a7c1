"""Book assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import JobConfig
from pageloom.functions import dates, markup, urls
from pageloom.operators.ranking import chunk_of, nth_position, rank_by_seq, rank_within
from pageloom.session import staged


def limit_articles(pages: DataFrame, limit: Column) -> DataFrame:
    """First ``limit`` parseable rows of every blog.

    Only an all-digit limit counts, and at least one row stays: the limit is
    checked after a page has been read. Run it on pages that are known to parse
    (F5): then the limit cuts pages before any body is extracted. Only
    ``blog, seq``, staged, are ranked; the rows themselves meet one cut per blog.
    """
    n = urls.parse_limit(limit)
    at_least_one = F.when(n.isNotNull(), F.greatest(n, F.lit(1)))
    positions = staged(pages.select("blog", "seq"), "positions")
    cuts = nth_position(positions, at_least_one).withColumnRenamed("blog", "__blog")
    kept = pages.join(cuts, F.col("blog").eqNullSafe(F.col("__blog")), "left").filter(
        F.col("cut").isNull() | (F.col("seq") <= F.col("cut"))
    )
    return kept.drop("cut", "__blog")


def date_span(articles: DataFrame) -> DataFrame:
    """Earliest and latest known date per blog (A3)."""
    return articles.groupBy("blog").agg(F.min("date").alias("start"), F.max("date").alias("end"))


def crawl_span(articles: DataFrame) -> DataFrame:
    """First known date in reading order, and the date of the last article
    after it, which may be missing or earlier (A4)."""
    dated_seq = F.when(F.col("date").isNotNull(), F.col("seq"))
    return (
        articles.groupBy("blog")
        .agg(
            F.min(dated_seq).alias("first_seq"),
            F.min_by("date", dated_seq).alias("start"),
            F.max("seq").alias("last_seq"),
            F.max_by("date", "seq").alias("last_date"),
        )
        .select(
            "blog",
            "start",
            F.when(F.col("last_seq") > F.col("first_seq"), F.col("last_date")).alias("end"),
        )
    )


def article_counts(articles: DataFrame) -> DataFrame:
    """Articles per blog."""
    return articles.groupBy("blog").agg(F.count(F.lit(1)).alias("n_articles"))


def selected_count(selection: DataFrame) -> DataFrame:
    """Ticked rows per blog (A10)."""
    return selection.groupBy("blog").agg(F.count_if("selected").alias("n_selected"))


def select_articles(articles: DataFrame, selection: DataFrame) -> DataFrame:
    """Articles ticked by position."""
    ticked = selection.filter("selected").select("blog", "seq")
    return articles.join(ticked, ["blog", "seq"], "left_semi")


def assemble_books(articles: DataFrame, blogs: DataFrame) -> DataFrame:
    """One book row per blog from narrow aggregates.

    ``blogs(blog, title, description, file_prefix)``. Articles stay rows; no
    book gathers its chapters into one value.
    """
    spans = articles.groupBy("blog").agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count(F.lit(1)).alias("n_articles"),
    )
    # The prefix follows from the URL, so a blog without metadata has its book too.
    prefix = F.coalesce("file_prefix", urls.file_prefix(F.col("blog")))
    return spans.join(blogs, "blog", "left").select(
        "blog",
        "title",
        dates.book_subtitle(F.col("start"), F.col("end")).alias("subtitle"),
        "description",
        "start",
        "end",
        "n_articles",
        dates.book_file_name(prefix, F.col("start"), F.col("end")).alias("file_name"),
        F.concat_ws(", ", F.nullif("title", F.lit("")), prefix).alias("author"),
    )


def number_chapters(articles: DataFrame) -> DataFrame:
    """Chapter number, id and file of every article in reading order.

    ``n_chapters`` of the blog comes along, as the ranking knows it anyway.
    """
    numbered = rank_by_seq(articles, "blog", "seq", "number", "n_chapters")
    uid = F.concat(F.lit("chapter_"), F.col("number").cast("string"))
    return numbered.withColumn("uid", uid).withColumn(
        "href", F.concat(uid, F.lit(".xhtml"))
    )


def order_chapters(articles: DataFrame, by: str = "date", large: int | None = None) -> DataFrame:
    """Chapter order ``number`` by date, oldest first, or by reversed sitemap
    order (O1). Undated articles come last, later sitemap entries first.

    Ranking reads its rows several times, so they are staged first. Blogs of more
    than ``large`` rows are ranked in chunks (``ranking.LARGE_KEY``).
    """
    articles = staged(articles, "to-order")
    latest_first = F.col("seq").desc()
    back = -chunk_of(F.col("seq"))
    if by == "sitemap":
        return rank_within(articles, ["blog"], [latest_first], [back], "number", large=large)
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    known = F.coalesce(F.col("date").cast("timestamp"), never)
    # Hours per blog, seconds per hour and instants per second are all bounded.
    instant = F.struct(known.alias("known"), back.alias("back"))
    levels = [F.date_trunc("hour", known), F.date_trunc("second", known), instant]
    return rank_within(
        articles,
        ["blog"],
        [F.col("date").asc_nulls_last(), latest_first],
        levels,
        "number",
        large=large,
    )


def toc_spine(chapters: DataFrame) -> DataFrame:
    """Table-of-contents and spine positions of numbered chapters: backwards,
    the spine led by cover and navigation (W4)."""
    position = F.col("n_chapters") - F.col("number") + 1
    return (
        chapters.withColumn("toc_pos", position)
        .withColumn("spine_pos", position + 2)
        .drop("n_chapters")
    )


def build_chapters(articles: DataFrame, cfg: JobConfig) -> DataFrame:
    """Chapter rows with their XHTML.

    Numbers are made on ``blog, seq``; each article's text then moves once, to
    meet its number. Articles are staged, as they are read for both.
    """
    articles = staged(articles, "to-number")
    places = toc_spine(number_chapters(articles.select("blog", "seq")))
    return articles.join(places, ["blog", "seq"]).select(
        "blog",
        "number",
        "uid",
        "href",
        "title",
        F.lit(cfg.language).alias("lang"),
        "toc_pos",
        "spine_pos",
        markup.chapter_xhtml(
            F.col("title"),
            F.col("tags"),
            F.col("date"),
            F.col("accessed"),
            F.col("url"),
            F.col("content"),
            F.col("comments"),
        ).alias("xhtml"),
    )


def dedupe_names(books: DataFrame) -> DataFrame:
    """Distinct file names: the first taker of a name keeps it, later ones get
    the first free of ``_[1]``, ``_[2]`` … on the same stem (W6).

    Takers are ordered by the hash of their blog, which also splits a name that
    very many blogs share. ``books`` has one row per ``blog``; it and the ranks
    are staged, and only clashing names go on from there.
    """
    books = staged(books, "books")
    suffix = r"(?:_\[[0-9]+\])?\.epub$"
    key = F.md5("blog")
    names = books.select(
        "blog",
        "file_name",
        F.regexp_replace("file_name", suffix, "").alias("stem"),
        F.regexp_extract("file_name", r"_\[([1-9][0-9]*)\]\.epub$", 1)
        .try_cast("bigint")
        .alias("taken"),
    )
    ranked = staged(
        rank_within(names, ["file_name"], [key], [F.substring(key, 1, 3)], "taker"), "takers"
    )
    first, later = ranked.filter("taker = 1"), ranked.filter("taker > 1")

    # The k-th free number of a stem is its place among k and the taken numbers,
    # each of those put where as many free numbers lie below it.
    clashing = later.select("stem").distinct()
    waiting = rank_within(later, ["stem"], [key], [F.substring(key, 1, 3)], "k").select(
        "stem", "blog", F.col("k").alias("place"), F.lit(0).alias("kind")
    )
    numbers = first.filter("taken IS NOT NULL").join(clashing, "stem", "left_semi")
    taken = rank_by_seq(numbers, "stem", "taken", "j").select(
        "stem",
        F.lit(None).cast("string").alias("blog"),
        (F.col("taken") - F.col("j")).alias("place"),
        F.lit(1).alias("kind"),
    )
    numbered = rank_within(
        staged(waiting.unionByName(taken), "places"),
        ["stem"],
        [F.col("place"), F.col("kind")],
        [chunk_of(F.col("place"))],
        "number",
    ).filter("kind = 0")
    renamed = numbered.select(
        "blog",
        F.concat(
            "stem", F.lit("_["), F.col("number").cast("string"), F.lit("].epub")
        ).alias("free_name"),
    )
    return (
        books.join(renamed, "blog", "left")
        .withColumn("file_name", F.coalesce("free_name", "file_name"))
        .drop("free_name")
    )


def compose_book(spec: DataFrame, articles: DataFrame) -> DataFrame:
    """Composed books: ordered chapter list with the articles it names.

    ``spec(book, position, url, chapter_title)``; a chapter without an article
    stays, with nulls.
    """
    return spec.join(
        articles.select("url", "title", "date", "content"), "url", "left"
    ).withColumn("title", F.coalesce("chapter_title", "title"))
