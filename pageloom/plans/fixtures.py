"""Inputs the page table lacks, derived by Spark from the given tables.

Posts, comment pages, image references, sitemaps, robots files and feeds are
built from whole tables. Documents that list rows (sitemaps, feeds, comment
pages) hold a bounded number of them each, as their formats require, so no
group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import dates, text, urls
from pageloom.sources.pages import read_pages

# List lengths of paged documents.
SITEMAP_ENTRIES = 50_000
FEED_IDS = 500
COMMENTS_PER_PAGE = 200

_GERMAN = {english: german for german, english in dates.GERMAN_MONTHS.items()}
POLISH_MONTHS = ",".join(dates.POLISH_MONTHS)
GERMAN_MONTHS = ",".join(_GERMAN.get(m.lower(), m).capitalize() for m in dates.ENGLISH_MONTHS)
IMAGE_SUFFIXES = ".jpg,.JPEG,.png,.svg,.gif,.webp,.tiff,.bmp,.heic"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def post_keys(docs: DataFrame) -> DataFrame:
    """Documents with the blog, URL, date parts and language of their post."""
    blog = F.concat(F.lit("https://"), F.col("source"), F.lit(".blogspot.com"))
    keyed = docs.withColumns(
        {
            "blog": blog,
            "y": (2010 + F.col("doc_id") % 10).cast("int"),
            "m": F.expr("cast(1 + (doc_id div 3) % 12 as int)"),
            "d": (1 + F.col("doc_id") % 28).cast("int"),
        }
    )
    return keyed.withColumns(
        {
            "url": F.format_string(
                "%s/%d/%02d/p%d.html", F.col("blog"), F.col("y"), F.col("m"), F.col("doc_id")
            ),
            "post_lang": F.expr(
                "CASE doc_id % 4 WHEN 1 THEN 'pl' WHEN 3 THEN 'de' ELSE 'en' END"
            ),
            "date_text": F.expr(
                f"""CASE
                  WHEN doc_id % 10 = 9 THEN NULL
                  WHEN doc_id % 4 = 1 THEN
                    concat('wtorek, ', d, ' ', split('{POLISH_MONTHS}', ',')[m - 1], ' ', y)
                  WHEN doc_id % 4 = 3 THEN
                    concat(d, '. ', split('{GERMAN_MONTHS}', ',')[m - 1], ' ', y)
                  ELSE format_string('%d-%02d-%02dT08:30:00+02:00', y, m, d) END"""
            ),
            "first_line": F.trim(F.split_part("text", F.lit("\n"), F.lit(1))),
            "tags": F.expr(
                "CASE WHEN doc_id % 7 = 0 THEN cast(array() AS array<string>)"
                " ELSE array(source, lang) END"
            ),
        }
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blog posts made of documents: ``blog, seq, url, html`` and the parts."""
    keyed = post_keys(documents(spark, sf_dir))
    title = F.when(
        F.col("doc_id") % 25 != 7,
        F.concat(
            F.lit('<h3 class="post-title entry-title"> '),
            text.escape_html(F.col("first_line")),
            F.lit(" </h3>"),
        ),
    ).otherwise("")
    date = (
        F.when(F.col("date_text").isNull(), "")
        .when(
            F.col("doc_id") % 4 % 2 == 0,
            F.concat(
                F.lit('<meta property="article:published_time" content="'),
                F.col("date_text"),
                F.lit('"/>'),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('<h2 class="date-header"><span>'), F.col("date_text"), F.lit("</span></h2>")
            )
        )
    )
    tags = F.array_join(
        F.transform(
            "tags", lambda t: F.concat(F.lit('<a rel="tag" href="/label"> '), t, F.lit(" </a>"))
        ),
        ", ",
    )
    image = F.expr(
        """CASE doc_id % 3
             WHEN 0 THEN concat('<img src="/img', doc_id % 50, '.jpg" alt="pic ', doc_id % 50, '">')
             WHEN 1 THEN '<img src="/pic.svg">' ELSE '' END"""
    )
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="'),
        F.col("post_lang"),
        F.lit('"><head><title>'),
        F.col("source"),
        F.lit(" blog</title></head><body>"),
        F.lit('<div id="header"><div><div><div><p class="description"><span>About '),
        F.col("source"),
        F.lit('<img src="/head-'),
        F.col("source"),
        F.lit('.png"></span></p></div></div></div></div>'),
        date,
        title,
        F.lit('<div class="entry-content">'),
        text.escape_html(F.col("text")),
        image,
        F.lit('<div class="post-footer">Posted by <em>me</em></div></div>'),
        tags,
        F.lit("</body></html>"),
    )
    return keyed.withColumn("seq", F.col("doc_id")).withColumn("html", html)


def comment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows ``page, pos, text`` of comment pages, captions included."""
    turns = table(spark, sf_dir, "conversations")
    captions = F.when(
        F.col("role") == "assistant", F.array(F.col("text"), F.lit("Odpowiedz"), F.lit("Usuń"))
    ).otherwise(F.array("text"))
    return turns.select(
        F.concat_ws("-", "conv_id", F.expr(f"turn div {COMMENTS_PER_PAGE}")).alias("page"),
        "turn",
        F.posexplode(captions).alias("at", "text"),
    ).select(
        "page",
        (F.col("turn") * 3 + F.col("at")).alias("pos"),
        text.strip(F.col("text")).alias("text"),
    )


def comment_pages(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """Comment pages of at most ``COMMENTS_PER_PAGE`` turns of a conversation.

    ``layout`` is ``block`` or ``list``.
    """
    turns = table(spark, sf_dir, "conversations").withColumns(
        {
            "page": F.concat_ws("-", "conv_id", F.expr(f"turn div {COMMENTS_PER_PAGE}")),
            "body": text.escape_html(F.col("text")),
        }
    )
    if layout == "block":
        piece = F.concat(
            F.lit("<p>"),
            F.col("body"),
            F.lit("</p>\n"),
            F.when(
                F.col("role") == "assistant", "<span>Odpowiedz</span> <a>Usuń</a>"
            ).otherwise(""),
        )
        opening, closing = '<div class="comment-block">', "</div>"
    else:
        piece = F.when(
            F.col("role") == "user",
            F.concat(F.lit('<dt class="comment-author">'), F.col("body"), F.lit("</dt>")),
        ).otherwise(F.concat(F.lit('<dd class="comment-body"><p>'), F.col("body"), F.lit("</p></dd>")))
        opening, closing = '<dl id="comments-block">', "</dl>"
    listed = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece")))),
            lambda t: t["piece"],
        ),
        "",
    )
    return turns.groupBy("page").agg(
        F.concat(
            F.lit("<html><body><div id='comments'><h4>"),
            F.count(F.lit(1)).cast("string"),
            F.lit(" comments</h4></div>" + opening),
            listed,
            F.lit(closing + "</body></html>"),
        ).alias("html")
    ).select(
        F.lit("https://talk.blogspot.com").alias("blog"),
        F.concat(F.lit("https://talk.blogspot.com/"), F.col("page")).alias("url"),
        "page",
        "html",
    )


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references of posts: ``blog, article_url, pos, src, alt, w, h``."""
    keyed = post_keys(documents(spark, sf_dir))
    src = F.expr(
        f"""CASE
          WHEN doc_id % 11 = 0 THEN concat('https://zblogowani.pl/button', doc_id % 5, '.png')
          WHEN doc_id % 13 = 0 THEN 'https://resources.blogblog.com/img/icon18_edit.gif'
          ELSE concat(
            CASE doc_id % 4 WHEN 0 THEN 'https://cdn.example.com/a/' WHEN 1 THEN '/up/'
              WHEN 2 THEN '//cdn.example.com/b/' ELSE 'img/' END,
            'img', doc_id % 50, split('{IMAGE_SUFFIXES}', ',')[cast(doc_id % 9 AS int)],
            CASE WHEN doc_id % 5 = 0 THEN '?w=1' ELSE '' END) END"""
    )
    return keyed.select(
        "blog",
        F.col("url").alias("article_url"),
        F.col("doc_id").alias("pos"),
        src.alias("src"),
        F.concat(F.lit("pic "), (F.col("doc_id") % 50).cast("string")).alias("alt"),
        (F.col("doc_id") * 37 % 300).alias("w"),
        (F.col("doc_id") * 53 % 300).alias("h"),
    )


def resolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references with absolute URL and hash."""
    refs = image_refs(spark, sf_dir).withColumn(
        "url", urls.absolute_image_url(F.col("src"), F.col("blog"))
    )
    return refs.withColumn("hash", F.md5("url"))


def dated_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated posts; every seventh has no date."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("blog"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp")).alias("date"),
    )


def _xml_text(c: Column) -> Column:
    return text.escape_html(c)


def _listed(order: str, piece: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order, piece.alias("piece")))),
            lambda e: e["piece"],
        ),
        "",
    )


def page_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urlset files of every blog in ``pages``: ``blog, part, doc_url, body``.

    Each starts with the blog's root and lists at most ``SITEMAP_ENTRIES`` pages.
    """
    entries = pages(spark, sf_dir).select(
        urls.blog_of(F.col("url")).alias("blog"),
        F.expr(f"page_id div {SITEMAP_ENTRIES}").alias("part"),
        "page_id",
        F.concat(
            F.lit("<url><loc>"),
            _xml_text(F.col("url")),
            F.lit("</loc>"),
            F.when(
                F.col("page_id") % 2 == 0, "<lastmod>2024-01-01T00:00:00+00:00</lastmod>"
            ).otherwise(""),
            F.lit("</url>"),
        ).alias("piece"),
    )
    return entries.groupBy("blog", "part").agg(
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
            F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'),
            F.col("blog"),
            F.lit("/</loc></url>"),
            _listed("page_id", F.col("piece")),
            F.lit("</urlset>"),
        ).alias("body")
    ).withColumn(
        "doc_url",
        F.concat("blog", F.lit("/sitemap.xml?page="), (F.col("part") + 1).cast("string")),
    )


def sitemap_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index per blog: its urlset files, then a taxonomy map."""
    parts = (
        pages(spark, sf_dir)
        .select(
            urls.blog_of(F.col("url")).alias("blog"),
            F.expr(f"page_id div {SITEMAP_ENTRIES}").alias("part"),
        )
        .distinct()
        .withColumn(
            "piece",
            F.concat(
                F.lit("<sitemap><loc>"),
                F.col("blog"),
                F.lit("/sitemap.xml?page="),
                (F.col("part") + 1).cast("string"),
                F.lit("</loc></sitemap>"),
            ),
        )
    )
    return parts.groupBy("blog").agg(
        F.concat(
            F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            _listed("part", F.col("piece")),
            F.lit("<sitemap><loc>"),
            F.col("blog"),
            F.lit("/wp-sitemap-taxonomies-category-1.xml</loc></sitemap></sitemapindex>"),
        ).alias("body")
    ).withColumn("doc_url", F.concat("blog", F.lit("/sitemap.xml")))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom feed pages of every source, ``FEED_IDS`` document ids wide."""
    keyed = post_keys(documents(spark, sf_dir)).withColumn(
        "part", F.expr(f"doc_id div {FEED_IDS}")
    )
    piece = F.concat(
        F.lit('<entry><title type="text">'),
        _xml_text(F.col("first_line")),
        F.lit('</title><link rel="replies" href="#"/><link rel="alternate" href="'),
        F.col("url"),
        F.lit('"/><published>'),
        F.format_string("%d-%02d-%02dT00:00:00Z", "y", "m", "d"),
        F.lit('</published><content type="html">'),
        _xml_text(F.col("text")),
        F.lit("</content></entry>"),
    )
    return (
        keyed.withColumn("piece", piece)
        .groupBy("blog", "part")
        .agg(
            F.concat(
                F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>x</title>'),
                _listed("doc_id", F.col("piece")),
                F.lit("</feed>"),
            ).alias("body")
        )
        .withColumn("doc_url", F.concat("blog", F.lit("/feeds/posts/default")))
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file per document; every third names no sitemap."""
    blog = F.concat(
        F.lit("https://"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"),
        F.lit(".example.com"),
    )
    body = F.when(
        F.col("doc_id") % 3 == 0, F.lit("User-agent: *\nDisallow: /search # Sitemap: no\nAllow: /\n")
    ).otherwise(
        F.concat(
            F.lit("User-agent: *\r\nAllow: /\r\nsitemap:  "),
            blog,
            F.lit("/wp%20sitemap.xml # first\r\nSitemap: "),
            blog,
            F.lit("/other.xml\r\n"),
        )
    )
    return documents(spark, sf_dir).select(blog.alias("blog"), body.alias("body"))


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages with an archive widget, ``FEED_IDS`` document ids each.

    Every link is listed twice; odd ids use a link below ``index.html``.
    """
    keyed = post_keys(documents(spark, sf_dir)).withColumn(
        "part", F.expr(f"doc_id div {FEED_IDS}")
    )
    href = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit(".."), F.regexp_replace("url", r"^https://[^/]+", "")),
    ).otherwise(F.concat(F.lit("old-"), F.col("doc_id").cast("string"), F.lit(".html")))
    link = F.concat(F.lit('<li><a href="'), href, F.lit('">x</a></li>'))
    return (
        keyed.withColumn("piece", F.concat(link, link))
        .groupBy("blog", "part")
        .agg(
            F.concat(
                F.lit("<html><body><a href='/outside'>o</a><div class='widget BlogArchive'><ul>"),
                _listed("doc_id", F.col("piece")),
                F.lit("</ul></div></body></html>"),
            ).alias("html")
        )
        .select(
            "blog",
            F.col("part").alias("seq"),
            F.concat("blog", F.lit("/arch/index.html")).alias("page_url"),
            "html",
        )
    )


def blog_kind() -> Column:
    """How a blog of the discovery check can be found, 0 to 4."""
    return F.length("blog") % 5


def discovery_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Seeds, robots files, sitemaps and root or archive pages of all page blogs.

    By kind: robots name an index; robots name nothing and the usual place holds an
    index; no robots and the usual place lists pages; robots name a sitemap that is
    not stored, so an archive widget is left, which links every page twice; nothing.
    """
    stored = pages(spark, sf_dir).select(urls.blog_of(F.col("url")).alias("blog"), "page_id")
    blogs = stored.select("blog").distinct()
    named = F.concat(F.lit("Allow: /\nSitemap: "), "blog", F.lit("/custom.xml\n"))
    robots = blogs.filter(blog_kind().isin(0, 1, 3)).select(
        "blog", F.when(blog_kind() == 1, "User-agent: *\n").otherwise(named).alias("body")
    )
    indexes = sitemap_indexes(spark, sf_dir)
    lists = page_sitemaps(spark, sf_dir)
    first = lists.filter(blog_kind() == 2).groupBy("blog").agg(F.min_by("body", "part").alias("body"))
    custom = F.concat("blog", F.lit("/custom.xml"))
    usual = F.concat("blog", F.lit("/sitemap.xml"))
    docs = (
        indexes.filter(blog_kind() == 0)
        .withColumn("doc_url", custom)
        .unionByName(indexes.filter(blog_kind() == 1))
        .unionByName(lists.filter(blog_kind() < 2).drop("part"))
        .unionByName(first.withColumn("doc_url", usual))
        .unionByName(
            blogs.filter(blog_kind() == 3).select(
                "blog", F.lit(None).cast("string").alias("body"), custom.alias("doc_url")
            )
        )
    )
    link = F.format_string('<li><a href="p%d.html">x</a><a href=\'p%d.html\'>y</a></li>', "page_id", "page_id")
    widgets = (
        stored.filter(blog_kind() == 3)
        .withColumn("piece", link)
        .groupBy("blog")
        .agg(F.concat(F.lit('<div class="BlogArchive">'), _listed("page_id", F.col("piece")), F.lit("</div>")).alias("html"))
        .select(F.concat("blog", F.lit("/pl/index.html")).alias("url"), "html")
    )
    refresh = '<meta http-equiv="refresh" content="0; url=pl/index.html">'
    roots = blogs.filter(blog_kind() > 2).select(
        F.concat("blog", F.lit("/")).alias("url"),
        F.when(blog_kind() == 3, refresh).otherwise("<p>nothing").alias("html"),
    )
    return blogs, robots, docs, roots.unionByName(widgets)
