"""One query per operator, each with its check SQL where SQL can say it.

Keys start with the operator's id in the blueprint. Every query reads whole
tables; limits appear only where the operator itself is a limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import sinks
from pageloom.config import JobConfig
from pageloom.functions import dates, markup, text, urls
from pageloom.functions.nodes import html_nodes
from pageloom.operators import books, comments, extract, history, images, inventory
from pageloom.plans import fixtures as fx
from pageloom.plans import discovery, run
from pageloom.plans import sqltext as q
from pageloom.profiles import BLOGSPOT, override, site_patterns, with_profile
from pageloom.session import prepare_session, scratch_path, staged
from pageloom.sources import images as image_source
from pageloom.sources import pages as page_source
from pageloom.sources import sitemaps
from pageloom.sources import store as page_store
from pageloom.streaming import incremental, keyed, seen

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_XHTML_SQL = """'<div><h2>' || first_line || '</h2>' ||
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE '<h5><span epub:type="keyword">' || source
        || '</span>, <span epub:type="keyword">' || lang || '</span></h5>' END
      || '<p><i>Created: ' || strftime(date, '%d %B %Y, %H:%M')
      || '</i><br/><i>Accessed: 31 January 2024, 00:00</i></p><p><i><a href="' || url || '">' || url
      || '</a></i></p><p>' || {} || '</div>'""".format(q.ESCAPED.format("text"))

CFG = JobConfig()


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its check SQL."""

    def register(fn: Query) -> Query:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare_session(spark, pages=True), sf_dir)

        call.__doc__ = fn.__doc__
        call.__name__ = name
        QUERIES[name] = call
        if sql is not None:
            ORACLES[name] = sql
        return call

    return register


def stamp(c: Column | str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def big(c: Column | str) -> Column:
    return F.col(c).cast("bigint").alias(c) if isinstance(c, str) else c.cast("bigint")


def blank(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bool_text(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def blog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source.blog_pages(fx.pages(spark, sf_dir))


def post_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.posts(spark, sf_dir).select("blog", "seq", "url", "html")


def post_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without their pages: what extraction yields, known beforehand."""
    return fx.post_keys(fx.documents(spark, sf_dir)).withColumns(
        {
            "seq": F.col("doc_id"),
            "date": dates.article_date(
                F.col("date_text"), F.col("post_lang"), F.col("url"), CFG.as_of
            ),
        }
    )


# --- flagship -------------------------------------------------------------


@query(
    "flagship_blog_summary",
    f"""WITH {q.PAGES}
    SELECT blog, arg_min(lang, page_id) AS language, count(*) AS n_articles,
      CAST(sum(length(content)) AS BIGINT) AS content_chars,
      regexp_replace(regexp_replace(blog, 'https?://', ''), '[/,.]', '_', 'g') AS file_prefix
    FROM (SELECT *, coalesce(nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), ''), 'en') AS lang
      FROM pg) GROUP BY blog""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per blog: language of its first page, articles, content size, prefix.

    One pass over the pages and one combinable aggregate; no Python.
    """
    article = F.regexp_extract("html", r"(?s)(<article(?:\s[^>]*)?>.*</article>)", 1)
    return (
        blog_pages(spark, sf_dir)
        .filter(F.col("html").isNotNull())
        .select(
            "blog",
            "seq",
            text.detect_language(F.col("html")).alias("language"),
            F.length(markup.reduce_markup(article)).alias("chars"),
        )
        .groupBy("blog")
        .agg(
            F.min_by("language", "seq").alias("language"),
            F.count(F.lit(1)).alias("n_articles"),
            big(F.sum("chars")).alias("content_chars"),
        )
        .withColumn("file_prefix", urls.file_prefix(F.col("blog")))
    )


# --- scans ----------------------------------------------------------------


@query(
    "s1_scan_pages",
    "SELECT page_id, url, md5(url) AS url_md5, md5(html) AS html_md5 FROM pages",
)
def s1(spark, sf_dir):
    pages = page_source.scan_pages(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", "url_md5", F.md5("html").alias("html_md5"))


@query("s2_scan_html_cache", "SELECT md5(url) AS url_md5, md5(html) AS html_md5 FROM pages")
def s2(spark, sf_dir):
    folder = scratch_path(spark, "html-cache")
    page_source.write_html_shards(
        page_source.scan_pages(spark, f"{sf_dir}/pages.parquet"), folder
    )
    cached = page_source.scan_html_shards(spark, folder)
    # The text writer ends every file with one line break of its own.
    return cached.select("url_md5", F.md5(F.regexp_replace("html", r"\n\z", "")).alias("html_md5"))


@query(
    "s3_scan_robots",
    """SELECT 'https://' || source || '-' || doc_id || '.example.com' AS blog,
      'https://' || source || '-' || doc_id || '.example.com' ||
        CASE WHEN doc_id % 3 = 0 THEN '/sitemap.xml' ELSE '/wp sitemap.xml' END AS sitemap_url
    FROM documents""",
)
def s3(spark, sf_dir):
    return sitemaps.scan_robots(fx.robots(spark, sf_dir))


@query(
    "s4_scan_sitemap",
    f"""WITH {q.LISTED}
    SELECT blog, part + 1 AS part, pos, url AS loc, lastmod FROM listed
    UNION ALL SELECT DISTINCT blog, part + 1, 0, blog || '/', '' FROM listed""",
)
def s4(spark, sf_dir):
    rows = sitemaps.scan_sitemap(fx.page_sitemaps(spark, sf_dir))
    part = F.regexp_extract("doc_url", r"page=(\d+)$", 1).cast("bigint")
    return rows.select("blog", part.alias("part"), "pos", "loc", blank("lastmod").alias("lastmod"))


@query(
    "s5_scan_sitemap_index",
    f"""WITH {q.LISTED}, parts AS (SELECT DISTINCT blog, part FROM listed), numbered AS (
      SELECT blog, row_number() OVER (PARTITION BY blog ORDER BY part) - 1 AS pos,
        blog || '/sitemap.xml?page=' || (part + 1) AS loc FROM parts)
    SELECT * FROM numbered
    UNION ALL SELECT blog, count(*), blog || '/wp-sitemap-taxonomies-category-1.xml'
      FROM parts GROUP BY blog""",
)
def s5(spark, sf_dir):
    return sitemaps.scan_sitemap_index(fx.sitemap_indexes(spark, sf_dir)).select(
        "blog", "pos", "loc"
    )


@query(
    "s6_scan_atom",
    f"""WITH {q.POSTS}
    SELECT blog, url AS link, first_line AS title,
      y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') || 'T00:00:00Z'
        AS published,
      row_number() OVER (PARTITION BY blog, {q.FEED_PARTS} ORDER BY doc_id) - 1 AS pos,
      md5(regexp_replace(text, '\\s+', '', 'g')) AS content_md5
    FROM posts""",
)
def s6(spark, sf_dir):
    entries = sitemaps.scan_atom(fx.feeds(spark, sf_dir))
    return entries.select(
        "blog",
        "link",
        F.trim("title").alias("title"),
        "published",
        "pos",
        F.md5(F.regexp_replace("content", r"\s+", "")).alias("content_md5"),
    )


@query(
    "s7_scan_archive_links",
    f"""WITH {q.POSTS}, numbered AS (
      SELECT *, row_number() OVER (PARTITION BY blog, {q.FEED_PARTS} ORDER BY doc_id) AS n FROM posts)
    SELECT blog, {q.FEED_PARTS} AS seq, (n - 1) * 2 AS pos,
      CASE WHEN doc_id % 2 = 0 THEN url ELSE blog || '/arch/old-' || doc_id || '.html' END AS url
    FROM numbered""",
)
def s7(spark, sf_dir):
    return sitemaps.scan_archive_links(fx.archive_pages(spark, sf_dir))


@query(
    "s7_nav_links",
    f"""SELECT {q.BLOG} AS blog, page_id AS seq, unnest(range(len(h))) AS pos, unnest(h) AS href
    FROM (SELECT *, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""",
)
def s7_nav(spark, sf_dir):
    links = sitemaps.nav_links(fx.pages(spark, sf_dir))
    return links.select("blog", "seq", big("pos"), "href")


@query(
    "s8_scan_seeds",
    f"""SELECT DISTINCT {q.BLOG} AS blog,
      CAST(CASE WHEN url LIKE 'http://%' THEN 80 ELSE 443 END AS BIGINT) AS port FROM pages""",
)
def s8(spark, sf_dir):
    seeds = fx.pages(spark, sf_dir).select(
        F.col("url"), F.lit("").alias("limit"), F.lit("").alias("skip")
    )
    return page_source.normalize_seeds(seeds).select("blog", big("port"))


_IMAGE_KINDS = "png,gif,bmp,jpeg,webp,heic,png,jpeg,none"


@query(
    "s9_scan_images",
    f"""SELECT md5(doc_id::VARCHAR) AS hash,
      CASE WHEN k < 6 THEN w END AS w, CASE WHEN k < 6 THEN h END AS h,
      'image/' || split_part('{_IMAGE_KINDS}', ',', k + 1) AS mime
    FROM (SELECT doc_id, (doc_id % 9)::INTEGER AS k, (doc_id * 37 % 9000 + 1)::INTEGER AS w,
      (doc_id * 11 % 7000 + 1)::INTEGER AS h FROM documents) WHERE k < 8""",
)
def s9(spark, sf_dir):
    """Headers of six types with sizes made of each id; a cut, a broken and a foreign file."""
    wide = {n: F.lpad(F.hex(n), 8, "0") for n in ("w", "h")}
    short = {n: F.right(c, F.lit(4)) for n, c in wide.items()}

    def little(c: Column, size: int) -> Column:
        return F.concat(*(F.substring(c, 2 * k + 1, 2) for k in reversed(range(size))))

    less = {n: F.right(F.lpad(F.hex(F.col(n) - 1), 8, "0"), F.lit(6)) for n in ("w", "h")}
    png = ("89504E470D0A1A0A0000000D49484452", wide["w"], wide["h"], "0802000000")
    kinds = (
        png,
        ("474946383961", little(short["w"], 2), little(short["h"], 2), "F70000"),
        ("424D00000000000000003600000028000000", little(wide["w"], 4), little(wide["h"], 4), "01001800"),
        # An application segment and a comment stand before the frame.
        ("FFD8FFE000064A464946FFFE0004AAAAFFFFC2001108", short["h"], short["w"], "03011100FFD9"),
        ("524946460000000057454250565038580A00000000000000", little(less["w"], 3), little(less["h"], 3)),
        ("0000001866747970686569630000000068656963", "6D696631", "000000406D65746100000000",
         "000000346970727000", "00002C6970636F", "0000001469737065", "00000000", "0000000100000001",
         "0000001469737065", "00000000", wide["w"], wide["h"]),
        (*png[:2], "0000"),
        ("FFD8FFE000064A464946FFDA0002", short["h"]),
        ("3C68746D6C3E", short["h"]),
    )
    parts = [F.concat(*(F.lit(p) if isinstance(p, str) else p for p in kind)) for kind in kinds]
    sizes = fx.documents(spark, sf_dir).select(
        "doc_id",
        (F.col("doc_id") * 37 % 9000 + 1).cast("int").alias("w"),
        (F.col("doc_id") * 11 % 7000 + 1).cast("int").alias("h"),
    )
    files = sizes.select(
        F.concat(F.lit("/images/"), F.md5(F.col("doc_id").cast("string")), F.lit("_600.img")).alias("path"),
        F.unhex(F.array(*parts)[(F.col("doc_id") % 9).cast("int")]).alias("content"),
    )
    return image_source.sized_images(staged(files, "image-files")).select("hash", "w", "h", "mime")


# --- sinks ----------------------------------------------------------------


@query(
    "k1_article_sink",
    f"""WITH {q.PAGES} SELECT blog, page_id AS seq, url, title, md5(content) AS content_md5 FROM pt""",
)
def k1(spark, sf_dir):
    folder = scratch_path(spark, "articles")
    sinks.write_articles(extract.extract_articles(blog_pages(spark, sf_dir), CFG), folder)
    rows = sinks.read_table(spark, folder)
    return rows.select("blog", "seq", "url", "title", F.md5("content").alias("content_md5"))


def _post_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows of posts, straight from their parts."""
    return post_rows(spark, sf_dir).select(
        "blog",
        "seq",
        "url",
        F.col("first_line").alias("title"),
        "date",
        F.lit(CFG.accessed_at).alias("accessed"),
        F.col("post_lang").alias("language"),
        "tags",
        F.concat(F.lit("<p>"), text.escape_html(F.col("text"))).alias("content"),
        F.lit("").alias("comments"),
    )


def _post_blogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fx.documents(spark, sf_dir)
        .select("source")
        .distinct()
        .select(
            F.concat(F.lit("https://"), "source", F.lit(".blogspot.com")).alias("blog"),
            F.concat("source", F.lit(" blog")).alias("title"),
            F.concat(F.lit("About "), "source").alias("description"),
            F.concat("source", F.lit("_blogspot_com")).alias("file_prefix"),
        )
    )


_BOOK_SQL = """SELECT blog, source || ' blog' AS title, CASE
        WHEN year(min(date)) = year(max(date)) THEN strftime(min(date), '%d %B')
        ELSE strftime(min(date), '%d %B %Y') END || ' - '
        || strftime(max(date), '%d %B %Y') AS subtitle, 'About ' || source AS description,
      strftime(min(date), '%Y-%m-%d %H:%M:%S') AS start,
      strftime(max(date), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n_articles,
      source || '_blogspot_com_' || strftime(min(date), '%Y.%m.%d') || '-'
        || strftime(max(date), '%Y.%m.%d') || '.epub' AS file_name,
      source || ' blog, ' || source || '_blogspot_com' AS author
    FROM posts GROUP BY blog, source"""


@query(
    "k2_book_sink",
    f"""WITH {q.POSTS}, b AS ({_BOOK_SQL})
    SELECT b.blog, b.title, b.file_name, b.n_articles,
      (SELECT count(*) FROM posts c WHERE c.blog = b.blog) AS n_chapters,
      (SELECT count(DISTINCT image_url) FROM posts i WHERE i.blog = b.blog) AS n_images
    FROM b""",
)
def k2(spark, sf_dir):
    folder = scratch_path(spark, "book")
    articles = _post_articles(spark, sf_dir)
    shown = post_rows(spark, sf_dir).filter(F.col("doc_id") % 3 == 0).select(
        "blog",
        F.col("seq").alias("pos"),
        F.md5(F.format_string("%s/img%d.jpg", F.col("blog"), F.col("doc_id") % 50)).alias("hash"),
    )
    manifest = images.manifest_images(
        shown.withColumn("resized_fn", urls.resized_fn(F.col("hash"), CFG))
    )
    sinks.write_book(
        books.assemble_books(articles, _post_blogs(spark, sf_dir)),
        books.build_chapters(articles, CFG),
        manifest,
        folder,
    )
    counts = (
        sinks.read_table(spark, f"{folder}/chapters").groupBy("blog").agg(F.count("*").alias("n_chapters"))
    )
    n_images = (
        sinks.read_table(spark, f"{folder}/images").groupBy("blog").agg(F.count("*").alias("n_images"))
    )
    return (
        sinks.read_table(spark, f"{folder}/books")
        .join(counts, "blog")
        .join(n_images, "blog")
        .select("blog", "title", "file_name", "n_articles", "n_chapters", "n_images")
    )


@query(
    "k3_chapter_text_sink",
    f"""WITH {q.POSTS} SELECT blog, 'chapter_' || row_number() OVER (PARTITION BY blog ORDER BY seq)
      || '.xhtml' AS href,
      md5(regexp_replace({_XHTML_SQL}, '\\s*[\\r\\n\\t]\\s*', ' ', 'g')) AS text_md5 FROM posts""",
)
def k3(spark, sf_dir):
    folder = scratch_path(spark, "chapters-text")
    sinks.write_chapters_text(books.build_chapters(_post_articles(spark, sf_dir), CFG), folder)
    parts = F.split("value", "\t")
    return sinks.read_text(spark, folder).select(
        parts[0].alias("blog"), parts[1].alias("href"), F.md5(parts[2]).alias("text_md5")
    )


@query(
    "k4_append_history",
    f"""SELECT DISTINCT {q.BLOG} AS url FROM pages""",
)
def k4(spark, sf_dir):
    blogs = history.distinct_history(fx.pages(spark, sf_dir).select("url"))
    old = blogs.filter(F.col("url").startswith("http://"))
    return history.append_history(old, blogs)


# --- field extraction -------------------------------------------------------


def _post_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_fields(post_pages(spark, sf_dir), CFG)


@query("e1_title", f"WITH {q.PAGES} SELECT page_id, title FROM pt")
def e1(spark, sf_dir):
    found = extract.with_matches(blog_pages(spark, sf_dir))
    return found.select(F.col("seq").alias("page_id"), extract.title_column().alias("title"))


@query(
    "e1_title_of_posts",
    f"""WITH {q.POSTS} SELECT doc_id,
      CASE WHEN doc_id % 25 = 7 THEN source || ' blog' ELSE first_line END AS title FROM posts""",
)
def e1_posts(spark, sf_dir):
    found = extract.with_matches(post_pages(spark, sf_dir))
    return found.select(F.col("seq").alias("doc_id"), extract.title_column().alias("title"))


@query("e2_date_raw", f"WITH {q.POSTS} SELECT doc_id, coalesce(date_text, '') AS date_raw FROM posts")
def e2(spark, sf_dir):
    found = extract.with_matches(post_pages(spark, sf_dir))
    return found.select(
        F.col("seq").alias("doc_id"), blank(extract.date_raw_column()).alias("date_raw")
    )


@query(
    "e2_date_regex",
    """SELECT doc_id, (1 + doc_id % 28) || ' ' || ['Mai', 'Juni', 'April'][doc_id % 3 + 1] || ' '
      || (2000 + doc_id % 20) AS date_raw FROM documents""",
)
def e2_regex(spark, sf_dir):
    """Dates of the one profile that finds them by expressions of three groups, in whole texts."""
    lead = F.array(*(F.lit(t) for t in ("letzte Änderung: ", "letzte Aktualisierung ", "last update:  ")))
    month = F.array(*(F.lit(m) for m in ("Mai", "Juni", "April")))
    k = (F.col("doc_id") % 3).cast("int")
    day, year = (1 + F.col("doc_id") % 28).cast("string"), (2000 + F.col("doc_id") % 20).cast("string")
    pages = fx.documents(spark, sf_dir).select(
        F.lit("https://zeissikonveb.de").alias("blog"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://zeissikonveb.de/p"), "doc_id").alias("url"),
        F.concat(
            F.lit('<div id="Section1">'), text.escape_html(F.col("text")), F.lit("</div><p>"), lead[k], day,
            F.lit(". "), month[k], F.lit(" "), year, F.lit("</p>"),
        ).alias("html"),
    )
    found = extract.with_matches(pages)
    return found.select(F.col("seq").alias("doc_id"), extract.date_raw_column().alias("date_raw"))


@query("e3_content", f"WITH {q.PAGES} SELECT page_id, content FROM pg")
def e3(spark, sf_dir):
    fields = extract.extract_fields(blog_pages(spark, sf_dir), CFG)
    return fields.select(F.col("seq").alias("page_id"), "content")


@query(
    "e3_content_of_posts",
    f"WITH {q.ARTICLES} SELECT doc_id, content FROM arts",
)
def e3_posts(spark, sf_dir):
    return _post_fields(spark, sf_dir).select(F.col("seq").alias("doc_id"), "content")


@query("e4_tags", f"WITH {q.POSTS} SELECT doc_id, tags FROM posts")
def e4(spark, sf_dir):
    found = extract.with_matches(post_pages(spark, sf_dir))
    return found.select(
        F.col("seq").alias("doc_id"), joined(extract.tags_column()).alias("tags")
    )


def _comment_markup(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    pages = fx.comment_pages(spark, sf_dir, layout)
    found = extract.with_matches(pages).withColumn(
        "comment_texts", extract.comment_texts_column()
    )
    return found.select("page", extract.comments_column(CFG).alias("comments"))


@query(
    "e5_block_comments",
    f"""WITH {q.TURNS}
    SELECT page, '<hr/><h3>' || count(*) || ' comments</h3>' || string_agg(
      CASE role_of WHEN 'author' THEN '<h4>' || body || '</h4>' ELSE '<p>' || body || '</p>' END,
      '' ORDER BY turn) AS comments FROM roles GROUP BY page""",
)
def e5(spark, sf_dir):
    return _comment_markup(spark, sf_dir, "block")


@query(
    "e6_listed_comments",
    f"""WITH {q.TURNS}, n AS (
      SELECT *, role = 'user' AS is_author,
        row_number() OVER (PARTITION BY page, role = 'user' ORDER BY turn) AS i FROM turns
    ), sizes AS (SELECT page, count(*) AS n_turns FROM turns GROUP BY page)
    SELECT s.page, coalesce('<hr/><h3>' || s.n_turns || ' comments</h3>' || p.body, '') AS comments
    FROM sizes s LEFT JOIN (
      SELECT a.page, string_agg('<h4>' || replace(a.body, chr(10), ' ') || '</h4><p>' || b.body
        || '</p>', '' ORDER BY a.i) AS body
      FROM n a JOIN n b ON a.page = b.page AND a.i = b.i AND a.is_author AND NOT b.is_author
      GROUP BY a.page) p ON s.page = p.page""",
)
def e6(spark, sf_dir):
    return _comment_markup(spark, sf_dir, "list")


@query(
    "e7_article_images",
    f"""WITH {q.POSTS} SELECT doc_id,
      CASE doc_id % 3 WHEN 0 THEN '/img' || (doc_id % 50) || '.jpg=pic ' || (doc_id % 50)
        WHEN 1 THEN '/pic.svg=' ELSE '' END AS images,
      CASE doc_id % 3 WHEN 0 THEN md5(image_url) || '{q.RESIZED}' ELSE '' END AS resized
    FROM posts""",
)
def e7(spark, sf_dir):
    fields = _post_fields(spark, sf_dir)
    refs = F.transform("image_refs", lambda r: F.concat(r["src"], F.lit("="), r["alt"]))
    return fields.select(
        F.col("seq").alias("doc_id"),
        joined(refs).alias("images"),
        joined(F.transform("images", lambda i: i["resized_fn"])).alias("resized"),
    )


@query(
    "e8_header_images",
    "SELECT doc_id, '/head-' || source || '.png' AS header_images FROM documents",
)
def e8(spark, sf_dir):
    return extract.with_matches(post_pages(spark, sf_dir)).select(
        F.col("seq").alias("doc_id"),
        joined(extract.header_images_column()).alias("header_images"),
    )


@query("e9_description", "SELECT doc_id, 'About ' || source AS description FROM documents")
def e9(spark, sf_dir):
    return extract.with_matches(post_pages(spark, sf_dir)).select(
        F.col("seq").alias("doc_id"), extract.description_column().alias("description")
    )




def _shown(articles: DataFrame) -> DataFrame:
    return articles.select(
        "blog",
        "seq",
        "url",
        blank("title").alias("title"),
        stamp("date").alias("date"),
        "language",
        joined("tags").alias("tags"),
        F.md5("content").alias("content_md5"),
        "comments",
    )


@query(
    "e10_articles",
    f"""WITH {q.PAGES} SELECT blog, page_id AS seq, url, title, '' AS date,
      coalesce(nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), ''), 'en') AS language,
      '' AS tags, md5(content) AS content_md5, '' AS comments FROM pt""",
)
def e10(spark, sf_dir):
    return _shown(extract.extract_articles(blog_pages(spark, sf_dir), CFG))


@query(
    "e10_articles_of_posts",
    f"""WITH {q.ARTICLES} SELECT blog, seq, url, title, {q.stamp("date")} AS date,
      post_lang AS language, tags, md5(content) AS content_md5, '' AS comments FROM arts""",
)
def e10_posts(spark, sf_dir):
    pages = post_pages(spark, sf_dir)
    titles = _post_blogs(spark, sf_dir).select(
        "blog", "title", F.lit(None).cast("string").alias("language")
    )
    return _shown(extract.extract_articles(pages, CFG, titles))


@query(
    "e11_blog_metadata",
    f"""WITH {q.PAGES}, lt AS (
      SELECT blog, page_id, CASE WHEN length(blog) % 3 = 0 THEN '' ELSE title END AS title,
        coalesce(nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), ''), 'en') AS lang FROM pt
    ) SELECT blog, coalesce(arg_min(title, page_id) FILTER (title <> ''), '') AS title,
      coalesce(arg_min(lang, page_id) FILTER (title <> ''), arg_max(lang, page_id)) AS language,
      '' AS description, '' AS header_images,
      regexp_replace(regexp_replace(blog, 'https?://', ''), '[/,.]', '_', 'g') AS file_prefix
    FROM lt GROUP BY blog""",
)
def e11(spark, sf_dir):
    """Every blog; those of some hosts have no title on any page."""
    pages = _partly_titled(spark, sf_dir).withColumnRenamed("seq", "page_id")
    store = page_store.write_store(pages, scratch_path(spark, "page-store"))
    meta = extract.store_metadata(store)
    return meta.select(
        "blog",
        "title",
        "language",
        "description",
        joined("header_images").alias("header_images"),
        "file_prefix",
    )


# --- filters ----------------------------------------------------------------


@query("f1_drop_root", f"SELECT {q.BLOG} AS blog, url FROM pages")
def f1(spark, sf_dir):
    pages = fx.pages(spark, sf_dir).select(urls.blog_of(F.col("url")).alias("blog"), "url")
    roots = pages.select("blog").distinct().withColumn("url", F.concat("blog", F.lit("/")))
    return inventory.drop_root(pages.unionByName(roots))


_MAP_NAMES = (
    "/sitemap.xml?page=1,/wp-sitemap-posts-post-1.xml,/wp-sitemap-posts-page-2.xml,"
    "/post-sitemap.xml,/page-sitemap2.xml,/wp-sitemap-taxonomies-category-1.xml,"
    "/wp-sitemap-users-1.xml,/sitemap.xml?page=x,/about.html"
)


def _map_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(f"split('{_MAP_NAMES}', ',')[cast(doc_id % 9 AS int)]")
    return fx.documents(spark, sf_dir).select("doc_id", F.concat("source", name).alias("loc"))


_MAP_SQL = "['" + "', '".join(_MAP_NAMES.split(",")) + "']"


@query(
    "f2_sub_sitemap",
    f"""SELECT doc_id, source || {_MAP_SQL}[doc_id % 9 + 1] AS loc,
      CASE WHEN doc_id % 9 < 7 THEN 'yes' ELSE 'no' END AS is_sub FROM documents""",
)
def f2(spark, sf_dir):
    return _map_urls(spark, sf_dir).withColumn(
        "is_sub", bool_text(inventory.is_sub_sitemap(F.col("loc")))
    )


@query(
    "f3_post_sitemap",
    f"""SELECT doc_id, source || {_MAP_SQL}[doc_id % 9 + 1] AS loc FROM documents
    WHERE doc_id % 9 < 5""",
)
def f3(spark, sf_dir):
    return _map_urls(spark, sf_dir).filter(inventory.is_post_sitemap(F.col("loc")))


@query(
    "f4_drop_ignored",
    f"""WITH {q.REFS} SELECT blog, pos, url FROM refs
    WHERE pos % 11 <> 0 AND pos % 13 <> 0""",
)
def f4(spark, sf_dir):
    kept = images.drop_ignored(fx.resolved_refs(spark, sf_dir), BLOGSPOT.ignored_urls)
    return kept.select("blog", "pos", "url")


@query("f5_drop_unparsed", "SELECT page_id FROM pages WHERE page_id % 10 <> 3 AND page_id % 10 <> 7")
def f5(spark, sf_dir):
    """Bodies of ids ending in 3 are taken away, in 7 spoilt by a control mark."""
    pages = fx.pages(spark, sf_dir).withColumn(
        "html",
        F.when(F.col("page_id") % 10 == 3, F.lit(None))
        .when(F.col("page_id") % 10 == 7, F.concat("html", F.lit("\x01")))
        .otherwise(F.col("html")),
    )
    return extract.drop_unparsed(pages).select("page_id")


@query(
    "f6_supported_images",
    f"WITH {q.REFS} SELECT pos, url, ext FROM typed WHERE ext IN {q.SUPPORTED}",
)
def f6(spark, sf_dir):
    kept = images.drop_unsupported(fx.resolved_refs(spark, sf_dir))
    return kept.select("pos", "url", urls.image_ext(F.col("url")).alias("ext"))


@query("f7_min_dims", f"WITH {q.REFS} SELECT pos, w, h FROM refs WHERE w + h >= 100")
def f7(spark, sf_dir):
    return image_source.min_dims(fx.image_refs(spark, sf_dir)).select("pos", "w", "h")


_MAGIC_HEX = "FFD8FFE0,89504E470D0A1A0A,474946383961,424D,524946460000000057454250,3C68746D6C3E"
_MAGIC_MIME = "image/jpeg,image/png,image/gif,image/bmp,image/webp"


@query(
    "f8_image_mime",
    f"""SELECT doc_id, ['{"', '".join(_MAGIC_MIME.split(","))}'][doc_id % 6 + 1] AS mime
    FROM documents WHERE doc_id % 6 < 5""",
)
def f8(spark, sf_dir):
    """Leading bytes of real files in front of every document's own bytes."""
    magic = F.unhex(F.expr(f"split('{_MAGIC_HEX}', ',')[cast(doc_id % 6 AS int)]"))
    blobs = fx.documents(spark, sf_dir).select(
        "doc_id", F.concat(magic, F.col("text").cast("binary")).alias("content")
    )
    return image_source.is_image_mime(blobs).select("doc_id", "mime")


@query(
    "f9_cover_candidates",
    f"WITH {q.REFS} SELECT pos, w, h FROM refs WHERE w >= 100 AND h >= 100",
)
def f9(spark, sf_dir):
    return image_source.cover_candidates(fx.image_refs(spark, sf_dir)).select("pos", "w", "h")


@query("f10_include_images", f"WITH {q.REFS} SELECT 'on' AS switch, pos FROM refs")
def f10(spark, sf_dir):
    refs = fx.image_refs(spark, sf_dir).select("pos")
    on = images.include_images(refs, JobConfig(include_images=True))
    off = images.include_images(refs, JobConfig(include_images=False))
    return on.select(F.lit("on").alias("switch"), "pos").unionByName(
        off.select(F.lit("off").alias("switch"), "pos")
    )


@query(
    "f11_interstitial",
    """SELECT page_id, 'tok' || page_id AS token FROM pages WHERE page_id % 4 = 0""",
)
def f11(spark, sf_dir):
    """Every fourth page gets a redirect link, as interstitial pages carry."""
    link = F.concat(F.lit('<a href="/?interstitial=tok'), F.col("page_id").cast("string"), F.lit('">'))
    pages = fx.pages(spark, sf_dir).withColumn(
        "html", F.when(F.col("page_id") % 4 == 0, F.concat("html", link)).otherwise(F.col("html"))
    )
    return extract.interstitials(pages).select("page_id", "token")


# --- joins --------------------------------------------------------------------


def _partly_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blog pages, of which all pages of some blogs have lost their title."""
    bare = F.regexp_replace("html", "<title>[^<]*</title>", "<title></title>")
    return blog_pages(spark, sf_dir).withColumn(
        "html", F.when(F.length("blog") % 3 == 0, bare).otherwise(F.col("html"))
    )


def _page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = sitemaps.scan_sitemap_index(fx.sitemap_indexes(spark, sf_dir)).withColumn(
        "lastmod", F.lit(None).cast("string")
    )
    entries = sitemaps.scan_sitemap(fx.page_sitemaps(spark, sf_dir))
    return inventory.build_inventory(top, entries)


def _stored(spark: SparkSession, sf_dir: str, missing: int | None = None) -> DataFrame:
    """A page store of all pages, or without every ``missing``-th as the frontier."""
    pages = page_source.read_pages(spark, f"{sf_dir}/pages.parquet")
    if missing is not None:
        pages = pages.filter(F.col("page_id") % missing != 0)
    return page_store.write_store(pages, scratch_path(spark, "page-store"))


def _known_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.pages(spark, sf_dir).select(
        urls.blog_of(F.col("url")).alias("blog"),
        F.col("page_id").alias("seq"),
        "url",
        urls.url_md5(F.col("url")).alias("url_md5"),
    )


@query(
    "j1_lookup_pages",
    f"""SELECT {q.BLOG} AS blog, page_id AS seq, url,
      CASE WHEN page_id % 5 = 0 THEN '' ELSE md5(html) END AS html_md5 FROM pages""",
)
def j1(spark, sf_dir):
    found = inventory.lookup_pages(_known_inventory(spark, sf_dir), _stored(spark, sf_dir, missing=5))
    return found.select("blog", "seq", "url", blank(F.md5("html")).alias("html_md5"))


@query(
    "j1_lookup_from_cache",
    f"""SELECT {q.BLOG} AS blog, page_id AS seq, url,
      CASE WHEN page_id % 5 = 0 THEN '' ELSE md5(html) END AS html_md5 FROM pages""",
)
def j1_from_cache(spark, sf_dir):
    """The same from a page cache, which knows pages by their URL's hash only."""
    folder = scratch_path(spark, "page-cache")
    stored = page_source.scan_pages(spark, f"{sf_dir}/pages.parquet").filter(F.col("page_id") % 5 != 0)
    page_source.write_html_shards(stored, folder)
    cache = page_source.scan_html_shards(spark, folder)
    store = page_store.write_store(cache, scratch_path(spark, "page-store"))
    found = inventory.lookup_pages(_known_inventory(spark, sf_dir), store)
    return found.select("blog", "seq", "url", blank(F.md5("html")).alias("html_md5"))


@query("j2_frontier", f"SELECT {q.BLOG} AS blog, url FROM pages WHERE page_id % 5 = 0")
def j2(spark, sf_dir):
    store = _stored(spark, sf_dir, missing=5)
    return inventory.frontier(_known_inventory(spark, sf_dir), store).select("blog", "url")


@query(
    "j3_expand_index",
    f"""WITH {q.LISTED}, parts AS (
      SELECT blog, part, row_number() OVER (PARTITION BY blog ORDER BY part) - 1 AS index_pos
      FROM (SELECT DISTINCT blog, part FROM listed))
    SELECT l.blog, p.index_pos, l.pos AS entry_seq, l.url FROM listed l
      JOIN parts p ON l.blog = p.blog AND l.part = p.part
    UNION ALL SELECT blog, index_pos, 0, blog || '/' FROM parts""",
)
def j3(spark, sf_dir):
    index = sitemaps.scan_sitemap_index(fx.sitemap_indexes(spark, sf_dir))
    entries = sitemaps.scan_sitemap(fx.page_sitemaps(spark, sf_dir))
    return inventory.expand_index(index, entries).select("blog", "index_pos", "entry_seq", "url")


@query(
    "j4_ignore_rules_table",
    f"""WITH {q.REFS} SELECT blog, pos, url FROM refs
    WHERE pos % 11 <> 0 AND pos % 13 <> 0""",
)
def j4(spark, sf_dir):
    rules = (
        site_patterns(spark)
        .filter("field = 'ignored_urls' AND profile = 'blogspot'")
        .select(F.col("expr").alias("pattern"))
    )
    kept = images.drop_ignored_by_table(fx.resolved_refs(spark, sf_dir), rules)
    return kept.select("blog", "pos", "url")


@query(
    "j5_drop_skipped",
    f"""WITH {q.REFS} SELECT pos, url FROM refs
    WHERE url NOT IN (SELECT url FROM refs WHERE w + h < 100)""",
)
def j5(spark, sf_dir):
    refs = fx.resolved_refs(spark, sf_dir)
    small = refs.filter(F.col("w") + F.col("h") < image_source.MIN_DIMS_SUM)
    return images.drop_skipped(refs, small).select("pos", "url")


@query(
    "j6_stored_only",
    f"""WITH {q.REFS} SELECT pos, url, hash FROM refs
    WHERE hash IN (SELECT hash FROM refs WHERE pos % 6 = 0)""",
)
def j6(spark, sf_dir):
    refs = fx.resolved_refs(spark, sf_dir)
    return images.stored_only(refs, refs.filter("pos % 6 = 0")).select("pos", "url", "hash")


@query(
    "j7_compose_book",
    f"""WITH {q.POSTS} SELECT 'best of ' || lang AS book, 1000000000 - doc_id AS position,
      CASE WHEN doc_id % 9 = 0 THEN url || '#gone' ELSE url END AS url,
      CASE WHEN doc_id % 4 = 0 THEN 'Chapter ' || doc_id WHEN doc_id % 9 = 0 THEN ''
        ELSE first_line END AS title,
      CASE WHEN doc_id % 9 = 0 THEN '' ELSE strftime(date, '%Y-%m-%d %H:%M:%S') END AS date
    FROM posts""",
)
def j7(spark, sf_dir):
    """Every document is a chapter of its language's book, last one first."""
    spec = post_rows(spark, sf_dir).select(
        F.concat(F.lit("best of "), "lang").alias("book"),
        (F.lit(1_000_000_000) - F.col("doc_id")).alias("position"),
        F.when(F.col("doc_id") % 9 == 0, F.concat("url", F.lit("#gone")))
        .otherwise(F.col("url"))
        .alias("url"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")))
        .alias("chapter_title"),
    )
    composed = books.compose_book(spec, _post_articles(spark, sf_dir))
    return composed.select(
        "book", "position", "url", blank("title").alias("title"), stamp("date").alias("date")
    )


# Patterns of each profile, counted by hand. Image patterns that are
# regexes are ignored and not counted.
_PATTERN_FIELDS = ("content", "content_cleanup", "title", "date", "images", "ignored_urls")
_PATTERN_COUNTS = {
    "default": (7, 5, 7, 6, 10, 1),
    "blogspot": (9, 5, 7, 6, 11, 7),
    "wordpress": (9, 5, 8, 6, 15, 1),
    "nrdblog": (7, 6, 1, 6, 10, 1),
    "zeissikonveb": (1, 7, 7, 3, 1, 1),
}
_PATTERN_VALUES = ", ".join(
    f"('{profile}', '{field}', {n})"
    for profile, counts in _PATTERN_COUNTS.items()
    for field, n in zip(_PATTERN_FIELDS, counts)
)


@query(
    "j8_site_profile_join",
    f"""SELECT v.profile, v.field, p.n * v.n AS n
    FROM (VALUES {_PATTERN_VALUES}) AS v(profile, field, n)
    JOIN (SELECT 'default' AS profile, count(*) AS n FROM pages
      UNION ALL SELECT 'blogspot', count(*) FROM documents) p ON p.profile = v.profile""",
)
def j8(spark, sf_dir):
    all_urls = fx.pages(spark, sf_dir).select("url").unionByName(
        fx.post_keys(fx.documents(spark, sf_dir)).select("url")
    )
    joined_rows = with_profile(all_urls, site_patterns(spark))
    return joined_rows.groupBy("profile", "field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j9_select_articles",
    f"WITH {q.POSTS} SELECT blog, seq, first_line AS title FROM posts WHERE doc_id % 3 <> 1",
)
def j9(spark, sf_dir):
    rows = post_rows(spark, sf_dir)
    ticks = rows.select("blog", "seq", (F.col("doc_id") % 3 != 1).alias("selected"))
    return books.select_articles(rows, ticks).select("blog", "seq", F.col("first_line").alias("title"))


# --- aggregations ---------------------------------------------------------------


@query(
    "a1_tag_counts",
    f"""WITH {q.POSTS}, t AS (SELECT blog, unnest([source, lang]) AS tag FROM posts
      WHERE doc_id % 7 <> 0)
    SELECT blog, tag, count(*) AS n FROM t GROUP BY blog, tag""",
)
def a1(spark, sf_dir):
    return comments.tag_counts(post_rows(spark, sf_dir))


@query("a2_page_counts", f"SELECT {q.BLOG} AS blog, count(*) AS pages FROM pages GROUP BY 1")
def a2(spark, sf_dir):
    return inventory.page_counts(_known_inventory(spark, sf_dir))


@query(
    "a3_date_span",
    f"""WITH {q.EVENTS} SELECT blog, {q.stamp("min(date)")} AS start, {q.stamp("max(date)")} AS "end"
    FROM ev GROUP BY blog""",
)
def a3(spark, sf_dir):
    span = books.date_span(fx.dated_posts(spark, sf_dir))
    return span.select("blog", stamp("start").alias("start"), stamp("end").alias("end"))


@query(
    "a4_crawl_span",
    f"""WITH {q.EVENTS}, f AS (
      SELECT blog, min(seq) FILTER (WHERE date IS NOT NULL) AS first_seq, max(seq) AS last_seq
      FROM ev GROUP BY blog)
    SELECT f.blog, {q.stamp("a.date")} AS start, {q.stamp("b.date")} AS "end" FROM f
    LEFT JOIN ev a ON a.blog = f.blog AND a.seq = f.first_seq
    LEFT JOIN ev b ON b.blog = f.blog AND b.seq = f.last_seq AND f.last_seq > f.first_seq""",
)
def a4(spark, sf_dir):
    span = books.crawl_span(fx.dated_posts(spark, sf_dir))
    return span.select("blog", stamp("start").alias("start"), stamp("end").alias("end"))


@query(
    "a5_book_image_set",
    f"""WITH {q.REFS} SELECT DISTINCT blog, url, alt AS description FROM refs
    UNION SELECT blog, blog || '/head-' || source || '.png', '' FROM posts""",
)
def a5(spark, sf_dir):
    refs = fx.resolved_refs(spark, sf_dir).select("blog", "url", F.col("alt").alias("description"))
    header = fx.post_keys(fx.documents(spark, sf_dir)).select(
        "blog",
        F.concat("blog", F.lit("/head-"), "source", F.lit(".png")).alias("url"),
        F.lit("").alias("description"),
    )
    return images.book_image_set(refs, header)


@query(
    "a6_manifest_images",
    f"""WITH {q.REFS}, n AS (
      SELECT blog, hash, row_number() OVER (PARTITION BY blog ORDER BY pos) AS number FROM refs)
    SELECT blog, 'img' || min(number) AS uid, 'images/' || hash || '{q.RESIZED}' AS href, hash
    FROM n GROUP BY blog, hash""",
)
def a6(spark, sf_dir):
    refs = fx.resolved_refs(spark, sf_dir)
    return images.manifest_images(
        refs.withColumn("resized_fn", urls.resized_fn(F.col("hash"), CFG))
    )


@query("a7_assemble_books", f"WITH {q.POSTS} {_BOOK_SQL}")
def a7(spark, sf_dir):
    made = books.assemble_books(_post_articles(spark, sf_dir), _post_blogs(spark, sf_dir))
    return made.withColumn("start", stamp("start")).withColumn("end", stamp("end"))


@query(
    "a7_untitled_books",
    f"""WITH {q.PAGES}, lt AS (
      SELECT *, CASE WHEN length(blog) % 3 = 0 THEN '' ELSE title END AS shown,
        regexp_replace(regexp_replace(blog, 'https?://', ''), '[/,.]', '_', 'g') AS prefix FROM pt
    ), b AS (
      SELECT blog, prefix, count(*) AS n_articles,
        coalesce(arg_min(shown, page_id) FILTER (shown <> ''), '') AS title
      FROM lt GROUP BY blog, prefix
    ) SELECT blog, title, n_articles, prefix || '.epub' AS file_name,
      CASE WHEN title = '' THEN '' ELSE title || ', ' END || prefix AS author FROM b""",
)
def a7_untitled(spark, sf_dir):
    """Books of extracted articles; blogs without a title have their book too."""
    pages = _partly_titled(spark, sf_dir)
    made = books.assemble_books(extract.extract_articles(pages, CFG), extract.blog_metadata(pages))
    return made.select("blog", blank("title").alias("title"), "n_articles", "file_name", "author")


@query(
    "a8_history_rollup",
    """SELECT 'https://user' || user_id || '.example.com' AS url, count(*) AS used,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY user_id""",
)
def a8(spark, sf_dir):
    log = fx.table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://user"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("url"),
        "ts",
    )
    return history.history_rollup(log).withColumn("last", stamp("last"))


@query("a9_distinct_history", f"SELECT DISTINCT {q.BLOG} AS url FROM pages")
def a9(spark, sf_dir):
    return history.distinct_history(fx.pages(spark, sf_dir).select("url"))


@query(
    "a10_selected_count",
    f"""WITH {q.POSTS} SELECT blog, count(*) FILTER (WHERE doc_id % 3 <> 1) AS n_selected
    FROM posts GROUP BY blog""",
)
def a10(spark, sf_dir):
    rows = fx.post_keys(fx.documents(spark, sf_dir))
    return books.selected_count(rows.select("blog", (F.col("doc_id") % 3 != 1).alias("selected")))


@query("a11_article_counts", f"SELECT {q.BLOG} AS blog, count(*) AS n_articles FROM pages GROUP BY 1")
def a11(spark, sf_dir):
    return books.article_counts(extract.drop_unparsed(blog_pages(spark, sf_dir)))


# --- windows ------------------------------------------------------------------


@query(
    "w1_skip_pages",
    f"""SELECT blog, url FROM (SELECT {q.BLOG} AS blog, url,
      row_number() OVER (PARTITION BY {q.BLOG} ORDER BY page_id) AS n FROM pages) WHERE n > 2""",
)
def w1(spark, sf_dir):
    return inventory.skip_pages(_known_inventory(spark, sf_dir), F.lit("2")).select("blog", "url")


@query(
    "w2_limit_articles",
    f"""SELECT blog, seq, html_md5 FROM (SELECT {q.BLOG} AS blog, page_id AS seq,
      md5(html) AS html_md5,
      row_number() OVER (PARTITION BY {q.BLOG} ORDER BY page_id) AS n FROM pages) WHERE n <= 3""",
)
def w2(spark, sf_dir):
    kept = books.limit_articles(extract.drop_unparsed(blog_pages(spark, sf_dir)), F.lit("3"))
    return kept.select("blog", "seq", F.md5("html").alias("html_md5"))


@query(
    "w3_number_chapters",
    f"""SELECT *, 'chapter_' || number AS uid, 'chapter_' || number || '.xhtml' AS href FROM (
      SELECT {q.BLOG} AS blog, page_id AS seq,
        row_number() OVER (PARTITION BY {q.BLOG} ORDER BY page_id) AS number FROM pages)""",
)
def w3(spark, sf_dir):
    numbered = books.number_chapters(_known_inventory(spark, sf_dir).select("blog", "seq"))
    return numbered.select("blog", "seq", "number", "uid", "href")


@query(
    "w4_toc_spine",
    f"""SELECT blog, number, n - number + 1 AS toc_pos, n - number + 3 AS spine_pos FROM (
      SELECT {q.BLOG} AS blog, row_number() OVER (PARTITION BY {q.BLOG} ORDER BY page_id) AS number,
        count(*) OVER (PARTITION BY {q.BLOG}) AS n FROM pages)""",
)
def w4(spark, sf_dir):
    numbered = books.number_chapters(_known_inventory(spark, sf_dir).select("blog", "seq"))
    return books.toc_spine(numbered).select("blog", "number", "toc_pos", "spine_pos")


@query(
    "w5_comment_roles",
    f"WITH {q.TURNS} SELECT page, turn * 3 AS pos, role_of AS role, md5(body) AS text_md5 FROM roles",
)
def w5(spark, sf_dir):
    roles = comments.comment_roles(fx.comment_texts(spark, sf_dir), CFG)
    return roles.select("page", "pos", "role", F.md5("text").alias("text_md5"))


@query(
    "w5_comment_rows",
    f"""WITH {q.TURNS} SELECT page, min(body) FILTER (WHERE role_of = 'author') AS author,
      coalesce(string_agg(body, chr(10) ORDER BY turn) FILTER (WHERE role_of = 'body'), '') AS content
    FROM roles GROUP BY page, g""",
)
def w5_rows(spark, sf_dir):
    rows = comments.comment_rows(fx.comment_texts(spark, sf_dir), CFG)
    return rows.select("page", "author", "content")


@query(
    "w5_rows_of_pages",
    f"""WITH {q.TURNS} SELECT page, min(body) FILTER (WHERE role_of = 'author') AS author,
      coalesce(string_agg(body, chr(10) ORDER BY turn) FILTER (WHERE role_of = 'body'), '') AS content
    FROM roles GROUP BY page, g""",
)
def w5_of_pages(spark, sf_dir):
    """Comment rows of the texts that extraction finds on comment pages."""
    texts = extract.comment_texts(fx.comment_pages(spark, sf_dir, "block"), "page")
    return comments.comment_rows(texts, CFG).select("page", "author", "content")


@query(
    "w6_dedupe_names",
    f"""WITH b AS (SELECT DISTINCT {q.BLOG} AS blog FROM pages), n AS (
      SELECT blog, regexp_extract(blog, '([a-z]+)$', 1) AS stem,
        row_number() OVER (PARTITION BY regexp_extract(blog, '([a-z]+)$', 1) ORDER BY md5(blog)) AS rn
      FROM b)
    SELECT blog, stem || CASE WHEN rn = 1 THEN '' ELSE '_[' || (rn - 1) || ']' END || '.epub'
      AS file_name FROM n""",
)
def w6(spark, sf_dir):
    """Blogs named by their top-level domain, so that names clash a lot."""
    named = (
        _known_inventory(spark, sf_dir)
        .select("blog")
        .distinct()
        .withColumn("file_name", F.concat(F.regexp_extract("blog", r"([a-z]+)$", 1), F.lit(".epub")))
    )
    return books.dedupe_names(named)


@query(
    "w7_first_seen_images",
    f"""WITH {q.REFS} SELECT blog, hash, min(pos) AS pos, arg_min(article_url, pos) AS article_url
    FROM refs GROUP BY blog, hash""",
)
def w7(spark, sf_dir):
    refs = fx.resolved_refs(spark, sf_dir)
    return images.first_seen(refs.select("blog", "hash", "pos", "article_url"))


@query(
    "w8_next_offset",
    """SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 OR doc_id % 4 = 1 THEN
        CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END
      ELSE 1 + doc_id % 20 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END END AS BIGINT)
      AS next_skip FROM documents""",
)
def w8(spark, sf_dir):
    config = fx.documents(spark, sf_dir).select(
        "doc_id",
        F.expr(
            "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE cast(1 + doc_id % 20 AS string) END"
        ).alias("limit"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE cast(doc_id % 50 AS string) END").alias(
            "skip"
        ),
    )
    return history.next_offset(config).select("doc_id", "next_skip")


# --- sorts, limits, sets --------------------------------------------------------


@query(
    "o1_order_by_date",
    f"""WITH {q.EVENTS} SELECT blog, seq, row_number() OVER (
      PARTITION BY blog ORDER BY date ASC NULLS LAST, seq DESC) AS number FROM ev""",
)
def o1(spark, sf_dir):
    return books.order_chapters(fx.dated_posts(spark, sf_dir)).select("blog", "seq", "number")


@query(
    "o1_chunked",
    f"""WITH {q.EVENTS} SELECT blog, seq, row_number() OVER (
      PARTITION BY blog ORDER BY date ASC NULLS LAST, seq DESC) AS number FROM ev""",
)
def o1_chunked(spark, sf_dir):
    """The same order with every blog cut into chunks, as only very large ones are."""
    ordered = books.order_chapters(fx.dated_posts(spark, sf_dir), large=0)
    return ordered.select("blog", "seq", "number")


@query(
    "o1_order_by_sitemap",
    f"""WITH {q.EVENTS} SELECT blog, seq, row_number() OVER (
      PARTITION BY blog ORDER BY seq DESC) AS number FROM ev""",
)
def o1_sitemap(spark, sf_dir):
    rows = fx.dated_posts(spark, sf_dir).select("blog", "seq")
    return books.order_chapters(rows, by="sitemap")


@query(
    "o2_inventory_order",
    f"WITH {q.LISTED} SELECT blog, part + 1 AS sitemap_seq, pos AS entry_seq, url FROM listed",
)
def o2(spark, sf_dir):
    return inventory.inventory_order(_page_inventory(spark, sf_dir)).select(
        "blog", "sitemap_seq", "entry_seq", "url"
    )


@query(
    "o3_cover_slots",
    f"""WITH {q.REFS}, d AS (SELECT DISTINCT blog, hash FROM typed WHERE ext IN {q.SUPPORTED}),
    r AS (SELECT *, row_number() OVER (PARTITION BY blog ORDER BY md5('cover' || hash)) AS rk FROM d),
    t AS (SELECT *, max(rk) OVER (PARTITION BY blog) AS n FROM r WHERE rk <= 35)
    SELECT t.blog, s.slot, t.hash FROM t
    JOIN (SELECT unnest(range(35)) AS slot) s ON s.slot % t.n = t.rk - 1""",
)
def o3(spark, sf_dir):
    usable = images.drop_unsupported(fx.resolved_refs(spark, sf_dir))
    return images.cover_slots(usable, seed="cover")


@query(
    "u1_build_inventory",
    f"""WITH {q.LISTED} SELECT blog, part + 1 AS sitemap_seq, pos AS entry_seq, url,
      md5(url) AS url_md5, lastmod FROM listed
    UNION ALL SELECT 'https://' || source || '.blogspot.com', 0, doc_id,
      'https://' || source || '.blogspot.com/d' || doc_id,
      md5('https://' || source || '.blogspot.com/d' || doc_id), '' FROM documents""",
)
def u1(spark, sf_dir):
    """Index files of page blogs and flat sitemaps of document blogs."""
    nested = sitemaps.scan_sitemap_index(fx.sitemap_indexes(spark, sf_dir)).withColumn(
        "lastmod", F.lit(None).cast("string")
    )
    flat = fx.post_keys(fx.documents(spark, sf_dir)).select(
        "blog",
        F.lit("").alias("doc_url"),
        F.col("doc_id").alias("pos"),
        F.concat("blog", F.lit("/d"), F.col("doc_id").cast("string")).alias("loc"),
        F.lit(None).cast("string").alias("lastmod"),
    )
    entries = sitemaps.scan_sitemap(fx.page_sitemaps(spark, sf_dir))
    built = inventory.build_inventory(nested.unionByName(flat), entries)
    return built.withColumn("lastmod", blank("lastmod"))


@query(
    "u2_article_and_header_images",
    f"""WITH {q.REFS} SELECT blog, url FROM refs
    UNION ALL SELECT blog, blog || '/head-' || source || '.png' FROM posts""",
)
def u2(spark, sf_dir):
    refs = fx.resolved_refs(spark, sf_dir).select("blog", "url")
    header = fx.post_keys(fx.documents(spark, sf_dir)).select(
        "blog", F.concat("blog", F.lit("/head-"), "source", F.lit(".png")).alias("url")
    )
    return images.with_header_images(refs, header)


@query(
    "u3_first_seen_links",
    f"""WITH h AS (SELECT {q.BLOG} AS blog, page_id, unnest(range(len(a))) AS i, unnest(a) AS url
      FROM (SELECT *, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages))
    SELECT blog, url, min(page_id * 100000 + i) AS pos FROM h GROUP BY blog, url""",
)
def u3(spark, sf_dir):
    links = sitemaps.nav_links(fx.pages(spark, sf_dir)).select(
        "blog",
        F.col("href").alias("url"),
        (F.col("seq") * 100000 + F.col("pos")).alias("pos"),
    )
    return inventory.first_seen_links(links)


@query(
    "u4_append_new_urls",
    """SELECT DISTINCT url FROM pages""",
)
def u4(spark, sf_dir):
    known = fx.pages(spark, sf_dir).select("url")
    old = known.filter(F.length("url") % 2 == 0).distinct()
    return history.append_history(old, known)


# --- scalar functions -------------------------------------------------------------


@query(
    "x1_normalize_blog_url",
    f"""SELECT page_id, CAST(CASE page_id % 4 WHEN 1 THEN 8443 WHEN 2 THEN 80 ELSE 443 END AS BIGINT)
        AS port,
      CASE page_id % 4 WHEN 2 THEN 'http' ELSE 'https' END || '://' || {q.HOST} AS url FROM pages""",
)
def x1(spark, sf_dir):
    """Page URLs as users type them: bare, with port, user, blanks, upper case."""
    typed = F.expr(
        """CASE page_id % 4
          WHEN 0 THEN concat('  ', upper(regexp_replace(url, '^https?://', '')), ' ')
          WHEN 1 THEN concat('https://u:p@', regexp_replace(url, '^https?://([^/]*)', '$1:8443'))
          WHEN 2 THEN regexp_replace(url, '^https?:', 'http:')
          ELSE regexp_replace(url, '^https?:', 'https:') END"""
    )
    rows = fx.pages(spark, sf_dir).select("page_id", typed.alias("seed"))
    norm = urls.normalize_blog_url(F.col("seed"))
    return rows.select("page_id", big(norm["port"]).alias("port"), norm["url"].alias("url"))


@query(
    "x2_file_prefix",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'named' || page_id
      ELSE regexp_replace(regexp_replace(lower(url), 'https?://', '', 'g'), '[/,.]', '_', 'g')
      END AS prefix FROM pages""",
)
def x2(spark, sf_dir):
    name = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("named"), F.col("page_id").cast("string")))
    return fx.pages(spark, sf_dir).select("page_id", urls.file_prefix(F.col("url"), name).alias("prefix"))


@query("x3_url_md5", "SELECT page_id, md5(url) AS url_md5 FROM pages")
def x3(spark, sf_dir):
    return fx.pages(spark, sf_dir).select("page_id", urls.url_md5(F.col("url")).alias("url_md5"))


@query(
    "x4_storage_paths",
    f"""WITH b AS (SELECT page_id, url, 'cache/' || regexp_replace({q.BLOG}, 'https?://', '') AS dir
      FROM pages)
    SELECT page_id, dir AS dir_path, dir || '/html' AS html_dir, dir || '/images' AS images_dir,
      dir || '/originals' AS originals_dir, dir || '/html/' || md5(url) || '.html' AS page_path FROM b""",
)
def x4(spark, sf_dir):
    paths = urls.storage_paths(urls.blog_of(F.col("url")), F.col("url"), "cache")
    return fx.pages(spark, sf_dir).select("page_id", paths.alias("p")).select("page_id", "p.*")


@query("x5_absolute_image_url", f"WITH {q.REFS} SELECT pos, src, url FROM refs")
def x5(spark, sf_dir):
    return fx.resolved_refs(spark, sf_dir).select("pos", "src", "url")


@query("x6_image_ext", f"WITH {q.REFS} SELECT pos, ext FROM typed")
def x6(spark, sf_dir):
    refs = fx.resolved_refs(spark, sf_dir)
    return refs.select("pos", urls.image_ext(F.col("url")).alias("ext"))


@query(
    "x7_resized_fn",
    f"""WITH {q.REFS} SELECT pos, hash || '{q.RESIZED}' AS resized_fn,
      hash || '_640_960_75.jpg' AS colour_fn, hash || '.jpg' AS original_fn FROM refs""",
)
def x7(spark, sf_dir):
    colour = JobConfig(images_size=(640, 960), images_quality=75, images_bw=False)
    refs = fx.resolved_refs(spark, sf_dir)
    return refs.select(
        "pos",
        urls.resized_fn(F.col("hash"), CFG).alias("resized_fn"),
        urls.resized_fn(F.col("hash"), colour).alias("colour_fn"),
        urls.original_fn(F.col("hash")).alias("original_fn"),
    )


@query(
    "x8_url_segment",
    """SELECT page_id, coalesce(str_split(url, '/')[4], '') AS segment_3,
      coalesce(str_split(url, '/')[5], '') AS segment_4 FROM pages""",
)
def x8(spark, sf_dir):
    return fx.pages(spark, sf_dir).select(
        "page_id",
        blank(urls.url_segment(F.col("url"), 3)).alias("segment_3"),
        blank(urls.url_segment(F.col("url"), 4)).alias("segment_4"),
    )


@query(
    "x9_detect_language",
    """SELECT page_id, coalesce(nullif(regexp_extract(html, '''lang'':[\\s]*''([a-z^'']+)''', 1), ''),
      nullif(regexp_extract(html, 'lang=[''"]([a-z]+)[''"]', 1), ''),
      nullif(regexp_extract(html, 'locale[''"]:[\\s]*[''"]([a-z]+)[''"]', 1), ''), 'en') AS language
    FROM pages""",
)
def x9(spark, sf_dir):
    return fx.pages(spark, sf_dir).select(
        "page_id", text.detect_language(F.col("html")).alias("language")
    )


@query("x10_blog_title", f"WITH {q.PAGES} SELECT page_id, title FROM pt")
def x10(spark, sf_dir):
    return fx.pages(spark, sf_dir).select(
        "page_id", text.blog_title(F.col("html"), F.lit("default")).alias("title")
    )


@query(
    "x10_long_blog_title",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' blog – ' || lang
      WHEN doc_id % 3 = 1 THEN source || repeat(' blog', 15)
      ELSE source || repeat(' blog', 15) || ' – ' || lang END AS title FROM documents""",
)
def x10_long(spark, sf_dir):
    """Short titles stay whole; long ones are cut, except for one profile."""
    tail = F.concat(F.lit(" &#8211; "), F.col("lang"))
    rows = fx.documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 2, "nrdblog").otherwise("default").alias("profile"),
        F.concat(
            F.lit("<title> "),
            "source",
            F.when(F.col("doc_id") % 3 == 0, F.lit(" blog")).otherwise(F.lit(" blog" * 15)),
            tail,
            F.lit("</title>"),
        ).alias("html"),
    )
    return rows.select("doc_id", text.blog_title(F.col("html"), F.col("profile")).alias("title"))


@query(
    "x11_html_unescape",
    "SELECT doc_id, md5(text || ' <&>\"– é') AS text_md5 FROM documents",
)
def x11(spark, sf_dir):
    escaped = F.concat(
        text.escape_html(F.col("text")), F.lit(" &lt;&amp;&gt;&quot;&#8211;&nbsp;&eacute;")
    )
    plain = F.replace(text.html_unescape(escaped), F.lit(" "), F.lit(" "))
    return fx.documents(spark, sf_dir).select("doc_id", F.md5(plain).alias("text_md5"))


@query(
    "x12_fix_html_tags",
    r"""SELECT page_id, md5(replace(replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(html, '(href|charset)="([^"]*)"', '\1=\2', 'g'),
        '([a-zA-Z0-9\-]+)=([a-zA-Z0-9\./\-:#_]+)([>\s])', '\1="\2"\3', 'g'),
      '<meta content=([^>]+)>', '<meta content=\1 />', 'g'),
      '<link href=([^>]+)>', '<link href=\1 />', 'g'),
      '<img ([^>]+)>', '<img \1 />', 'g'), '//>', '/>'), '<br>', '<br/>')) AS fixed_md5,
      len(regexp_extract_all(html, 'href="[a-zA-Z0-9./#:_-]+">'))::BIGINT AS mended
    FROM (SELECT page_id, replace(html, '</head>', '<meta content=0;url=x><link href=a.css>'
      || '<img src=b.png></head>') AS html FROM pages)""",
)
def x12(spark, sf_dir):
    """Whole pages whose attributes have lost their quotes."""
    planted = F.replace(
        "html", F.lit("</head>"), F.lit("<meta content=0;url=x><link href=a.css><img src=b.png></head>")
    )
    bare = F.regexp_replace(planted, r'(href|charset)="([^"]*)"', "$1=$2")
    fixed = text.fix_html_tags(bare)
    mended = F.regexp_count(fixed, F.lit('<a href="[a-zA-Z0-9./#:_-]+">'))
    return fx.pages(spark, sf_dir).select(
        "page_id", F.md5(fixed).alias("fixed_md5"), mended.cast("bigint").alias("mended")
    )


@query(
    "x13_clever_decode",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE md5(source || 'é') END AS text_md5
    FROM documents""",
)
def x13(spark, sf_dir):
    """UTF-8 bytes of even documents, Latin-1 bytes for the others."""
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(
        F.concat(F.encode("source", "UTF-8"), F.unhex(F.lit("E9")))
    )
    return fx.documents(spark, sf_dir).select(
        "doc_id", F.md5(text.clever_decode(content)).alias("text_md5")
    )


@query(
    "x14_content_cleanup",
    "SELECT page_id, md5(html) AS cleaned_md5 FROM pages",
)
def x14(spark, sf_dir):
    """Whole pages with an advert block of one to three parts in the article; it goes, the page stays."""
    begin = '<div style="x"> <br/> <span style="y"><i>Dyskretna Reklama</i></span>'
    end = '<span style="z"><br /><i>Koniec Dyskretnej Reklamy</i></span></div> + <br>'
    block = F.expr(f"repeat('{begin}{end}', cast(1 + page_id % 3 AS int))")
    raw = F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), block))
    rules = [p.regex for p in BLOGSPOT.content_cleanup if p.regex]
    return fx.pages(spark, sf_dir).select(
        "page_id", F.md5(markup.remove_patterns(raw, rules)).alias("cleaned_md5")
    )


@query(
    "x15_reduce_markup",
    f"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(replace(regexp_extract(html, '(?s)<body>(.*)</body>', 1), chr(10), ''),
        '<!--.*?-->', '', 'g'),
      '<div[^>]*>', '<p>', 'g'),
      '</?(div|nav|article|h1|footer)[^>]*>', '', 'g'), '[ \\t\\r\\f]+', ' ', 'g'))) AS body_md5
    FROM pages""",
)
def x15(spark, sf_dir):
    body = F.regexp_extract("html", r"(?s)<body>(.*)</body>", 1)
    return fx.pages(spark, sf_dir).select(
        "page_id", F.md5(markup.reduce_markup(body)).alias("body_md5")
    )


@query(
    "x16_image_placeholders",
    f"""WITH {q.REFS} SELECT pos, 'see #pageimage#' || hash || '# there' AS marked,
      'see {q.TABLE_OPEN}' || hash || '{q.RESIZED}{q.TABLE_MID}' || alt || '{q.TABLE_END} there'
        AS shown FROM refs""",
)
def x16(spark, sf_dir):
    refs = fx.resolved_refs(spark, sf_dir).withColumn(
        "img", F.concat(F.lit('<img src="'), "src", F.lit('">'))
    )
    listed = F.array(
        F.struct(
            F.col("img").alias("html"),
            "hash",
            urls.resized_fn(F.col("hash"), CFG).alias("resized_fn"),
            F.col("alt").alias("description"),
        )
    )
    marked = refs.withColumn("images", listed).withColumn(
        "marked",
        markup.placeholder_images(
            F.concat(F.lit("see "), "img", F.lit(" there")), F.col("images")
        ),
    )
    return marked.select(
        "pos", "marked", markup.insert_images(F.col("marked"), F.col("images")).alias("shown")
    )


@query("x17_cut_title_suffix", "SELECT doc_id, split_part(text, '|', 1) AS title FROM documents")
def x17(spark, sf_dir):
    return fx.documents(spark, sf_dir).select(
        "doc_id", text.cut_title_suffix(F.col("text")).alias("title")
    )


@query(
    "x18_parse_limit_skip",
    """SELECT doc_id, CAST(CASE doc_id % 7 WHEN 0 THEN doc_id WHEN 3 THEN 0 WHEN 5 THEN 3000000000
        + doc_id WHEN 6 THEN 4611686018427387904 ELSE -1 END AS BIGINT) AS limit_n,
      CAST(CASE doc_id % 7 WHEN 0 THEN CASE WHEN doc_id = 0 THEN -1 ELSE doc_id END
        WHEN 5 THEN 3000000000 + doc_id WHEN 6 THEN 4611686018427387904 ELSE -1 END
        AS BIGINT) AS skip_n FROM documents""",
)
def x18(spark, sf_dir):
    """Strings as users give them; -1 shows "no limit" and "no skip"."""
    given = F.expr(
        """CASE doc_id % 7 WHEN 0 THEN cast(doc_id AS string) WHEN 1 THEN 'None' WHEN 2 THEN ''
             WHEN 3 THEN '0' WHEN 4 THEN '-7' WHEN 5 THEN cast(3000000000 + doc_id AS string)
             ELSE concat('99999999999999999999', doc_id) END"""
    )
    return fx.documents(spark, sf_dir).select(
        "doc_id",
        big(F.coalesce(urls.parse_limit(given), F.lit(-1))).alias("limit_n"),
        big(F.coalesce(urls.parse_skip(given), F.lit(-1))).alias("skip_n"),
    )


@query(
    "x19_tags_html",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE '<h5><span epub:type="keyword">' || source
      || '</span>, <span epub:type="keyword">' || lang || '</span></h5>' END AS tag_line FROM documents""",
)
def x19(spark, sf_dir):
    rows = fx.post_keys(fx.documents(spark, sf_dir))
    return rows.select("doc_id", markup.tags_html(F.col("tags")).alias("tag_line"))


_SPANS = """spans AS (
  SELECT event_id, ts AS a, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ts
    WHEN 2 THEN ts + INTERVAL 3 HOUR WHEN 3 THEN ts + INTERVAL 60 DAY
    ELSE ts + INTERVAL 400 DAY END AS b FROM events)"""


def _date_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("a"),
        F.expr(
            """cast(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ts WHEN 2 THEN ts + INTERVAL 3 HOUR
               WHEN 3 THEN ts + INTERVAL 60 DAY ELSE ts + INTERVAL 400 DAY END AS timestamp)"""
        ).alias("b"),
    )


@query(
    "x20_book_subtitle",
    f"""WITH {_SPANS} SELECT event_id, CASE
      WHEN b IS NULL THEN strftime(a, '%d %B %Y')
      WHEN strftime(a, '%Y.%m') = strftime(b, '%Y.%m') THEN
        strftime(a, '%d') || '-' || strftime(b, '%d %B %Y')
      WHEN year(a) = year(b) THEN strftime(a, '%d %B') || ' - ' || strftime(b, '%d %B %Y')
      ELSE strftime(a, '%d %B %Y') || ' - ' || strftime(b, '%d %B %Y') END AS subtitle FROM spans""",
)
def x20(spark, sf_dir):
    pairs = _date_pairs(spark, sf_dir)
    return pairs.select("event_id", dates.book_subtitle(F.col("a"), F.col("b")).alias("subtitle"))



@query(
    "x21_chapter_xhtml",
    f"WITH {q.POSTS} SELECT doc_id, md5({_XHTML_SQL}) AS xhtml_md5 FROM posts",
)
def x21(spark, sf_dir):
    rows = _post_articles(spark, sf_dir)
    body = markup.chapter_xhtml(
        *(F.col(c) for c in ("title", "tags", "date", "accessed", "url", "content", "comments"))
    )
    return rows.select(F.col("seq").alias("doc_id"), F.md5(body).alias("xhtml_md5"))


@query(
    "x21_build_chapters",
    f"""WITH {q.POSTS}, n AS (SELECT *, row_number() OVER (PARTITION BY blog ORDER BY seq) AS number,
      count(*) OVER (PARTITION BY blog) AS total FROM posts)
    SELECT blog, number, 'chapter_' || number AS uid, first_line AS title, total - number + 1 AS toc_pos,
      total - number + 3 AS spine_pos, md5({_XHTML_SQL}) AS xhtml_md5 FROM n""",
)
def x21_chapters(spark, sf_dir):
    made = books.build_chapters(_post_articles(spark, sf_dir), CFG)
    return made.select(
        "blog", "number", "uid", "title", "toc_pos", "spine_pos", F.md5("xhtml").alias("xhtml_md5")
    )


@query(
    "x22_book_file_name",
    f"""WITH {_SPANS} SELECT event_id, 'u' || CASE WHEN event_id % 11 = 0 THEN '' ELSE
      '_' || strftime(a, '%Y.%m.%d') || CASE WHEN b IS NULL OR a = b THEN ''
        ELSE '-' || strftime(b, '%Y.%m.%d') END END || '.epub' AS file_name FROM spans""",
)
def x22(spark, sf_dir):
    pairs = _date_pairs(spark, sf_dir).withColumn(
        "a", F.when(F.col("event_id") % 11 != 0, F.col("a"))
    )
    name = dates.book_file_name(F.lit("u"), F.col("a"), F.col("b"))
    return pairs.select("event_id", name.alias("file_name"))


# --- dates ------------------------------------------------------------------------


_EN_MONTHS = "['" + "', '".join(dates.ENGLISH_MONTHS) + "']"
_RU_MONTHS = ",".join(dates.RUSSIAN_MONTHS)


@query(
    "d1_translate_month",
    f"""SELECT doc_id, CASE doc_id % 3
      WHEN 0 THEN (1 + doc_id % 28) || ' ' || {_EN_MONTHS}[1 + doc_id % 12] || ' 2012'
      WHEN 1 THEN ' ' || (1 + doc_id % 28) || ' ' || {_EN_MONTHS}[1 + doc_id % 12] || ' 2012'
      ELSE (1 + doc_id % 28) || '. ' || {_EN_MONTHS}[1 + doc_id % 12] || ' 2012' END AS translated
    FROM documents""",
)
def d1(spark, sf_dir):
    raw = F.expr(
        f"""CASE doc_id % 3
          WHEN 0 THEN concat('Środa, ', 1 + doc_id % 28, ' ',
            split('{fx.POLISH_MONTHS}', ',')[cast(doc_id % 12 AS int)], ' 2012')
          WHEN 1 THEN concat('среда, ', 1 + doc_id % 28, ' ',
            split('{_RU_MONTHS}', ',')[cast(doc_id % 12 AS int)], ' 2012 г.')
          ELSE concat(1 + doc_id % 28, '. ',
            split('{fx.GERMAN_MONTHS}', ',')[cast(doc_id % 12 AS int)], ' 2012') END"""
    )
    language = F.expr("split('pl,ru,de', ',')[cast(doc_id % 3 AS int)]")
    return fx.documents(spark, sf_dir).select(
        "doc_id", dates.translate_month(raw, language).alias("translated")
    )


@query(
    "d2_parse_date",
    """SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN '' ELSE strftime(make_timestamp(
        2010 + doc_id % 10, 1 + doc_id % 12, 1 + doc_id % 12,
        CAST(CASE doc_id % 8 WHEN 0 THEN 6 WHEN 3 THEN 10 WHEN 6 THEN 13 ELSE 0 END AS BIGINT),
        CAST(CASE doc_id % 8 WHEN 0 THEN 30 WHEN 3 THEN 45 WHEN 6 THEN 5 ELSE 0 END AS BIGINT), 0),
      '%Y-%m-%d %H:%M:%S') END AS date FROM documents""",
)
def d2(spark, sf_dir):
    raw = F.expr(
        f"""CASE doc_id % 8
          WHEN 0 THEN format_string('%d-%02d-%02dt08:30:00+02:00', y, m, m)
          WHEN 1 THEN concat(m, ' ', mon, ' ', y) WHEN 2 THEN concat(m, '. ', mon, ' ', y)
          WHEN 3 THEN concat('tuesday, ', mon, ' ', m, ', ', y, ' 10:45')
          WHEN 4 THEN concat(substr(mon, 1, 3), ' ', m, ', ', y) WHEN 5 THEN concat(m, '/', m, '/', y)
          WHEN 6 THEN concat(mon, ' ', m, 'th, ', y, ' 1:05 pm') ELSE 'soon' END"""
    )
    rows = fx.documents(spark, sf_dir).select(
        "doc_id",
        (2010 + F.col("doc_id") % 10).alias("y"),
        (1 + F.col("doc_id") % 12).alias("m"),
        F.expr(
            f"split('{','.join(dates.ENGLISH_MONTHS)}', ',')[cast(doc_id % 12 AS int)]"
        ).alias("mon"),
    )
    return rows.select("doc_id", stamp(dates.parse_article_date(raw)).alias("date"))


@query(
    "d2_date_losses",
    """SELECT unnest(['articles', 'dates_from_url', 'empty', 'missing', 'pages', 'unknown_dates',
        'unreadable']) AS counter,
      unnest([count(*) FILTER (k NOT IN (3, 7)), count(*) FILTER (k = 5), 0,
        count(*) FILTER (k = 3), count(*), count(*) FILTER (k = 1), count(*) FILTER (k = 7)])::BIGINT AS n
    FROM (SELECT doc_id % 10 AS k FROM documents)""",
)
def d2_losses(spark, sf_dir):
    """What an extraction of whole texts loses, counted while its rows are written."""
    k = F.col("doc_id") % 10
    date = F.when(k == 5, "").otherwise(
        F.concat(
            F.lit('<meta property="article:published_time" content="'),
            F.when(k == 1, "some day").otherwise("2020-05-06"),
            F.lit('"/>'),
        )
    )
    body = F.concat(date, F.lit("<article><p>x</p>"), text.escape_html(F.col("text")), F.lit("</article>"))
    pages = fx.documents(spark, sf_dir).select(
        F.lit("https://a.example.com").alias("blog"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://a.example.com/2020/05/p"), "doc_id").alias("url"),
        F.when(k == 7, F.concat(F.lit("\x01"), body)).when(k != 3, body).alias("html"),
    )
    losses = extract.Losses()
    staged(extract.extract_articles(pages, CFG, losses=losses), "articles")
    counts = sorted(losses.counts().items())
    return spark.createDataFrame(counts, "counter string, n bigint")


@query(
    "d3_date_from_url",
    f"""WITH {q.POSTS} SELECT url, strftime(make_timestamp(y, m, 1, 0, 0, 0), '%Y-%m-%d %H:%M:%S') AS date
      FROM posts
    UNION ALL SELECT url, '' FROM pages
    UNION ALL SELECT DISTINCT blog, '2024-01-31 00:00:00' FROM posts""",
)
def d3(spark, sf_dir):
    """Dated post URLs, page URLs without a date, and short blog URLs."""
    keyed = fx.post_keys(fx.documents(spark, sf_dir))
    all_urls = (
        keyed.select("url")
        .unionByName(fx.pages(spark, sf_dir).select("url"))
        .unionByName(keyed.select(F.col("blog").alias("url")).distinct())
    )
    return all_urls.withColumn("date", stamp(dates.date_from_url(F.col("url"), CFG.as_of)))


@query("d4_strip_weekday", "SELECT doc_id, regexp_replace(text, '[^\\,]*, ', '', 'g') AS stripped FROM documents")
def d4(spark, sf_dir):
    return fx.documents(spark, sf_dir).select(
        "doc_id", dates.strip_weekday(F.col("text")).alias("stripped")
    )


@query(
    "d5_title_or_date",
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN event_type
      ELSE strftime(ts, '%A, %d %B %Y, %H:%M') END AS title FROM events""",
)
def d5(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    title = F.expr("CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'blog' ELSE event_type END")
    return events.select(
        "event_id",
        dates.title_or_date(title, F.lit("blog"), F.col("ts").cast("timestamp")).alias("title"),
    )


# --- streaming ----------------------------------------------------------------------


@query(
    "t1_stream_articles",
    f"WITH {q.PAGES} SELECT blog, page_id AS seq, title, md5(content) AS content_md5 FROM pt",
)
def t1(spark, sf_dir):
    """Articles of pages that arrive in three parts."""
    out, checkpoint = incremental.new_run(spark, "stream-articles")

    def process(folder: str) -> None:
        pages = incremental.stream_pages(spark, folder)
        incremental.run_append(incremental.stream_articles(pages, CFG), out, checkpoint)

    _arriving(spark, sf_dir, "pages", "page_id", process)
    return spark.read.parquet(out).select("blog", "seq", "title", F.md5("content").alias("content_md5"))


@query("t2_stream_dedupe", "SELECT DISTINCT md5(url) AS url_md5 FROM pages")
def t2(spark, sf_dir):
    """Pages arrive in three parts, twice in each and again in the part after; each passes once."""
    out, checkpoint = incremental.new_run(spark, "stream-dedupe")

    def process(folder: str) -> None:
        pages = incremental.stream_pages(spark, folder).drop("html")
        twice = pages.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
        incremental.run_dedupe(twice, out, checkpoint)

    _arriving(spark, sf_dir, "pages", "page_id", process, again=True)
    return seen.published_rows(spark, out).select("url_md5")


@query(
    "t3_stream_limit",
    f"""WITH {q.PAGES} SELECT blog, seq, title FROM (SELECT blog, page_id AS seq, title,
      row_number() OVER (PARTITION BY blog ORDER BY page_id) AS n FROM pt) WHERE n <= 3""",
)
def t3(spark, sf_dir):
    """The first articles of every blog, as pages arrive in three parts."""
    out, checkpoint = incremental.new_run(spark, "stream-limit")

    def process(folder: str) -> None:
        pages = incremental.stream_pages(spark, folder)
        incremental.run_limit(pages, "3", out, checkpoint, CFG)

    _arriving(spark, sf_dir, "pages", "page_id", process)
    return incremental.read_limit(spark, out, "articles").select("blog", "seq", "title")


def _arriving(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    order: str,
    process: Callable[[str], None],
    again: bool = False,
) -> None:
    """A table that arrives in three parts by an id; a stream goes on after each.

    With ``again`` the rows of the part before arrive once more.
    """
    folder = scratch_path(spark, f"arriving-{name}")
    whole = fx.table(spark, sf_dir, name)
    low, high = whole.agg(F.min(order), F.max(order)).first()
    for k in range(3):
        place = (F.col(order) - low) * 3
        first = (k - 1 if again else k) * (high - low + 1)
        part = whole.filter((place >= first) & (place < (k + 1) * (high - low + 1)))
        part.write.mode("append").parquet(folder)
        process(folder)


@query(
    "t4_stream_tag_counts",
    f"""WITH {q.POSTS}, t AS (SELECT blog, unnest([source, lang]) AS tag FROM posts
      WHERE doc_id % 7 <> 0)
    SELECT blog, tag, count(*) AS n FROM t GROUP BY blog, tag""",
)
def t4(spark, sf_dir):
    """Counts carried on as documents arrive in three parts."""
    out, checkpoint = incremental.new_run(spark, "stream-tags")
    schema = fx.table(spark, sf_dir, "documents").schema

    def process(folder: str) -> None:
        posts = fx.post_keys(spark.readStream.schema(schema).parquet(folder))
        incremental.run_latest(incremental.stream_tag_counts(posts), out, checkpoint, ["blog", "tag"])

    _arriving(spark, sf_dir, "documents", "doc_id", process)
    return keyed.read_latest(spark, out, ["blog", "tag"])


@query(
    "t5_stream_span",
    f"""WITH {q.EVENTS} SELECT blog, count(*) AS n_articles, {q.stamp("min(date)")} AS start,
      {q.stamp("max(date)")} AS "end" FROM ev GROUP BY blog""",
)
def t5(spark, sf_dir):
    """Spans carried on as events arrive in three parts."""
    out, checkpoint = incremental.new_run(spark, "stream-span")
    schema = fx.table(spark, sf_dir, "events").schema

    def process(folder: str) -> None:
        dated = spark.readStream.schema(schema).parquet(folder).select(
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("blog"),
            F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp")).alias("date"),
        )
        incremental.run_latest(incremental.stream_span(dated), out, checkpoint, ["blog"])

    _arriving(spark, sf_dir, "events", "event_id", process)
    span = keyed.read_latest(spark, out, ["blog"])
    return span.withColumn("start", stamp("start")).withColumn("end", stamp("end"))


# --- profiles ---------------------------------------------------------------------


_HOSTS = (
    "example.com,x.blogspot.com,x.wordpress.com,nrdblog.cmosnet.eu,zeissikonveb.de,"
    "x.blogspot.com/zeissikonveb.de"
)
_PROFILE_SQL = (
    "['default', 'blogspot', 'wordpress', 'nrdblog', 'zeissikonveb', 'zeissikonveb'][doc_id % 6 + 1]"
)


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(
        F.lit("https://"),
        F.expr(f"split('{_HOSTS}', ',')[cast(doc_id % 6 AS int)]"),
        F.lit("/p"),
        F.col("doc_id").cast("string"),
    )
    return fx.documents(spark, sf_dir).withColumn("url", url).withColumn(
        "profile", urls.profile_of(F.col("url"))
    )


@query(
    "v1_profile_registry",
    f"""SELECT v.profile, v.field, d.n * v.n AS n FROM (VALUES {_PATTERN_VALUES}) AS v(profile, field, n)
    JOIN (SELECT {_PROFILE_SQL} AS profile, count(*) AS n FROM documents GROUP BY 1) d
      ON d.profile = v.profile""",
)
def v1(spark, sf_dir):
    rows = with_profile(_profiled(spark, sf_dir).drop("profile"), site_patterns(spark))
    return rows.groupBy("profile", "field").agg(F.count(F.lit(1)).alias("n"))


@query("v2_profile_dispatch", f"SELECT doc_id, {_PROFILE_SQL} AS profile FROM documents")
def v2(spark, sf_dir):
    return _profiled(spark, sf_dir).select("doc_id", "profile")


@query(
    "v3_field_overrides",
    """SELECT doc_id, CASE WHEN doc_id % 6 >= 4 THEN split_part(text, '|', 1) ELSE text END AS title,
      CASE WHEN doc_id % 6 >= 4 THEN 'de' ELSE lang END AS language FROM documents""",
)
def v3(spark, sf_dir):
    rows = _profiled(spark, sf_dir)
    profile = F.col("profile")
    return rows.select(
        "doc_id",
        override(F.col("text"), profile, "title_override").alias("title"),
        override(F.col("lang"), profile, "language_override").alias("language"),
    )


def _node_facts(pages: DataFrame, key: str, wanted: tuple[str, ...]) -> DataFrame:
    """Per page and tag: number, source by range, parents, inner nodes and attributes."""
    rows = pages.withColumn("nodes", html_nodes(F.col("html"))).withColumn(
        "tag", F.explode(F.array(*(F.lit(t) for t in wanted)))
    )
    rows = rows.withColumn("own", F.expr("filter(nodes, n -> n.tag = tag)")).filter("size(own) > 0")
    parent = "CASE WHEN n.parent < 0 THEN cast(n.parent AS string) ELSE nodes[n.parent].tag END"
    return rows.select(
        F.col(key),
        "tag",
        F.expr("cast(size(own) AS bigint)").alias("n"),
        F.expr(
            "md5(array_join(transform(own, n -> substring(html, n.start, n.stop - n.start)), ''))"
        ).alias("source_md5"),
        F.expr(f"array_join(array_sort(array_distinct(transform(own, n -> {parent}))), ',')").alias("parents"),
        F.expr("cast(aggregate(own, 0, (s, n) -> s + n.last - n.pos) AS bigint)").alias("inner_nodes"),
        F.expr(
            "array_join(transform(own, n -> array_join(transform(array_sort(map_entries(n.attrs)),"
            " e -> concat(e.key, '=', e.value)), ' ')), '|')"
        ).alias("attributes"),
    )


@query(
    "v4_html_nodes",
    r"""SELECT page_id, tag, CAST(len(found) AS BIGINT) AS n, md5(array_to_string(found, '')) AS source_md5,
      parents, CAST(len(found) * within AS BIGINT) AS inner_nodes,
      CASE WHEN attr = '' THEN repeat('|', len(found) - 1)
        ELSE array_to_string(list_transform(found, lambda x: attr || '='
          || regexp_extract(x, attr || '="([^"]*)"', 1)), '|') END AS attributes
    FROM (SELECT page_id, tag, parents, within, attr, regexp_extract_all(html, pattern) AS found
      FROM pages, (VALUES ('a', '<a [^>]*>[^<]*</a>', '-2', 0, 'href'),
        ('article', '(?s)<article>.*</article>', '-2', 2, ''),
        ('div', '<div [^>]*>[^<]*</div>', '-2', 0, 'class'),
        ('h1', '<h1>[^<]*</h1>', 'article', 1, ''),
        ('script', '(?s)<script>.*?</script>', '-2', 0, '')) AS t(tag, pattern, parents, within, attr))
    WHERE len(found) > 0""",
)
def v4(spark, sf_dir):
    return _node_facts(fx.pages(spark, sf_dir), "page_id", ("a", "article", "div", "h1", "script"))


@query(
    "v4_nodes_of_posts",
    f"""WITH {q.POSTS} SELECT doc_id, tag, n::BIGINT AS n, parents, inner_nodes::BIGINT AS inner_nodes, attributes
    FROM (SELECT doc_id, 'span' AS tag,
        CASE WHEN date_text IS NULL OR doc_id % 4 % 2 = 0 THEN 1 ELSE 2 END AS n,
        CASE WHEN date_text IS NULL OR doc_id % 4 % 2 = 0 THEN 'p' ELSE 'h2,p' END AS parents,
        CASE WHEN date_text IS NULL OR doc_id % 4 % 2 = 0 THEN 2 ELSE 3 END AS inner_nodes,
        CASE WHEN date_text IS NULL OR doc_id % 4 % 2 = 0 THEN '' ELSE '|' END AS attributes FROM posts
      UNION ALL SELECT doc_id, 'p', 1, 'div', 3, 'class=description' FROM posts
      UNION ALL SELECT doc_id, 'img', CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 2 END,
        CASE WHEN doc_id % 3 = 2 THEN 'span' ELSE 'div,span' END, 0,
        'src=/head-' || source || '.png' || CASE doc_id % 3
          WHEN 0 THEN '|alt=pic ' || doc_id % 50 || ' src=/img' || doc_id % 50 || '.jpg'
          WHEN 1 THEN '|src=/pic.svg' ELSE '' END FROM posts)""",
)
def v4_posts(spark, sf_dir):
    """Nested nodes: a parent, the last descendant and the attributes of each."""
    posts = post_pages(spark, sf_dir).withColumnRenamed("seq", "doc_id")
    return _node_facts(posts, "doc_id", ("span", "p", "img")).drop("source_md5")


@query(
    "run_discovery",
    f"""WITH {q.LISTED}, parts AS (
      SELECT blog, part, row_number() OVER (PARTITION BY blog ORDER BY part) AS step
      FROM (SELECT DISTINCT blog, part FROM listed)
    ), k AS (SELECT l.*, p.step, length(l.blog) % 5 AS kind FROM listed l
      JOIN parts p ON l.blog = p.blog AND l.part = p.part
    ), found AS (
      SELECT blog, CASE kind WHEN 0 THEN 'robots' ELSE 'default' END AS origin, step, pos, url
      FROM k WHERE kind < 2 OR (kind = 2 AND step = 1)
      UNION ALL SELECT DISTINCT blog, 'default', 0, 0, blog || '/' FROM k WHERE kind = 2
      UNION ALL SELECT blog, 'widget', 0, page_id, blog || '/pl/p' || page_id || '.html' FROM k WHERE kind = 3)
    SELECT blog, origin, row_number() OVER (PARTITION BY blog ORDER BY step, pos) AS seq, url FROM found""",
)
def run_discovery(spark, sf_dir):
    """Blogs of all kinds from their seeds to a numbered inventory."""
    blogs, robots, docs, pages = fx.discovery_inputs(spark, sf_dir)
    store = page_store.write_store(pages, scratch_path(spark, "page-store"))
    found = discovery.discover(blogs, robots, docs, store)
    numbered = inventory.number_inventory(staged(found, "discovered"))
    return numbered.select("blog", "origin", "seq", "url")


# --- whole run -----------------------------------------------------------------------


@query(
    "book_run",
    f"""WITH {q.PAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY blog ORDER BY page_id) AS rn
      FROM pt), kept AS (SELECT *, rn - 1 AS number FROM n WHERE rn > 1 AND rn <= 6)
    SELECT blog, number, 'chapter_' || number || '.xhtml' AS href, title,
      count(*) OVER (PARTITION BY blog) - number + 1 AS toc_pos, md5(content) AS content_md5
    FROM kept""",
)
def book_run(spark, sf_dir):
    """Sitemaps to chapters: inventory, skip 1, lookup, limit 5, extraction."""
    pages = staged(inventory.number_inventory(_page_inventory(spark, sf_dir)), "inventory")
    store = _stored(spark, sf_dir)
    cfg = JobConfig(skip="1", limit="5")
    plan = staged(run.chapter_plan(pages, store, cfg), "chapter-plan")
    made = run.chapter_rows(plan, store, cfg)
    return made.select(
        "blog", "number", "href", "title", "toc_pos", F.md5("content").alias("content_md5")
    )


# --- whole runs to book tables, made of extracted rows ---------------------------


def _written_run(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """All posts extracted, and one table of the run read back."""
    folder = scratch_path(spark, "run")
    pages = post_pages(spark, sf_dir)
    articles = extract.extract_articles(pages, CFG)
    run.write_run(articles, extract.blog_metadata(pages), CFG, folder)
    return sinks.read_table(spark, f"{folder}/{table}")


@query(
    "run_books",
    f"""WITH {q.POSTS} SELECT blog, CASE
        WHEN year(min(date)) = year(max(date)) THEN strftime(min(date), '%d %B')
        ELSE strftime(min(date), '%d %B %Y') END || ' - '
        || strftime(max(date), '%d %B %Y') AS subtitle, 'About ' || source AS description,
      strftime(min(date), '%Y-%m-%d %H:%M:%S') AS start,
      strftime(max(date), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n_articles,
      source || '_blogspot_com_' || strftime(min(date), '%Y.%m.%d') || '-'
        || strftime(max(date), '%Y.%m.%d') || '.epub' AS file_name
    FROM posts GROUP BY blog, source""",
)
def run_books(spark, sf_dir):
    """Book rows of a run over all posts."""
    made = _written_run(spark, sf_dir, "books")
    return made.select(
        "blog", "subtitle", "description", stamp("start").alias("start"),
        stamp("end").alias("end"), "n_articles", "file_name",
    )


@query(
    "run_images",
    f"""WITH {q.POSTS}, i AS (
      SELECT blog, seq, md5(image_url) AS hash,
        row_number() OVER (PARTITION BY blog ORDER BY seq) AS n
      FROM posts WHERE doc_id % 3 = 0
    ) SELECT blog, hash, 'img' || min(n) AS uid, 'images/' || hash || '{q.RESIZED}' AS href
    FROM i GROUP BY blog, hash""",
)
def run_images(spark, sf_dir):
    """Image manifest of a run over all posts."""
    return _written_run(spark, sf_dir, "images").select("blog", "hash", "uid", "href")


@query(
    "run_tags",
    f"""WITH {q.POSTS}, t AS (SELECT blog, unnest([source, lang]) AS tag FROM posts
      WHERE doc_id % 7 <> 0) SELECT blog, tag, count(*) AS n FROM t GROUP BY blog, tag""",
)
def run_tags(spark, sf_dir):
    """Tag counts of a run over all posts."""
    return _written_run(spark, sf_dir, "tags").select("blog", "tag", "n")


@query(
    "run_own_limits",
    f"""WITH {q.PAGES}, n AS (
      SELECT *, row_number() OVER (PARTITION BY blog ORDER BY page_id) AS rn,
        CASE length(blog) % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1000000 END AS most,
        length(blog) % 2 AS skip FROM pt
    ), k AS (SELECT *, rn - skip AS number FROM n WHERE rn > skip)
    SELECT blog, number, title, count(*) OVER (PARTITION BY blog) - number + 1 AS toc_pos
    FROM k WHERE number <= greatest(most, 1)""",
)
def run_own_limits(spark, sf_dir):
    """A run in which every blog has its own skip and limit, as typed."""
    pages = staged(inventory.number_inventory(_page_inventory(spark, sf_dir)), "inventory")
    store = _stored(spark, sf_dir)
    size = F.length("blog")
    seeds = pages.select("blog").distinct().select(
        "blog",
        F.when(size % 3 == 0, "2").when(size % 3 == 1, "0").otherwise("None").alias("limit"),
        F.when(size % 2 == 1, " 1 ").otherwise("").alias("skip"),
    )
    plan = staged(run.chapter_plan(pages, store, CFG, seeds=seeds), "chapter-plan")
    return run.chapter_rows(plan, store, CFG).select("blog", "number", "title", "toc_pos")
