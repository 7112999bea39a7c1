"""From seeds to a page inventory: robots file, usual sitemap, archive widget.

Sources are tried in a cascade, each for the blogs that those before left over. A
blog whose robots file names a sitemap is looked for there, any other at the
usual place; one whose sitemap isn't stored is read from the archive widget behind
its root page. Documents are parsed where they lie; what is joined is narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators import inventory
from pageloom.session import staged
from pageloom.sources import sitemaps
from pageloom.sources.store import fetch_bodies


def sitemap_places(blogs: DataFrame, robots: DataFrame) -> DataFrame:
    """``(blog, origin, doc_url)``: where each blog's sitemap should be; every blog has a place."""
    named = robots.groupBy("blog").agg(F.min(sitemaps.named_sitemap(F.col("body"))).alias("named"))
    return blogs.select("blog").distinct().join(named, "blog", "left").select(
        "blog",
        F.when(F.col("named").isNotNull(), "robots").otherwise("default").alias("origin"),
        F.coalesce("named", F.concat("blog", F.lit("/sitemap.xml"))).alias("doc_url"),
    )


def root_pages(blogs: DataFrame, store: DataFrame) -> DataFrame:
    """``(blog, html)`` of stored root pages, found with or without the last slash."""
    spelled = blogs.select("blog", F.explode(F.array(F.col("blog"), F.concat("blog", F.lit("/")))).alias("url"))
    found = spelled.withColumn("url_md5", urls.url_md5(F.col("url"))).join(
        store.filter("readable").select("url_md5"), "url_md5", "left_semi"
    )
    one = found.groupBy("blog").agg(F.min("url").alias("url")).withColumn("url_md5", urls.url_md5(F.col("url")))
    return fetch_bodies(staged(one, "root-keys"), store).select("blog", "html")


def discover(blogs: DataFrame, robots: DataFrame, docs: DataFrame, store: DataFrame) -> DataFrame:
    """Inventory rows of all blogs with their ``origin``: robots, default or widget.

    ``blogs(blog)`` are seeds, ``robots(blog, body)`` and ``docs(blog, doc_url, body)``
    the stored robots files and sitemaps, one row per ``doc_url``, ``store`` an opened
    page store. A missing document has no row or a null body; a sitemap that is there
    but empty is not missing. Number the rows with ``inventory.number_inventory``;
    ``undiscovered`` lists blogs that came to nothing.
    """
    docs = docs.filter("body is not null")
    places = staged(sitemap_places(blogs, robots), "sitemap-places")
    found = staged(places.join(docs.select("doc_url").distinct(), "doc_url", "left_semi"), "sitemaps-found")
    entries = sitemaps.scan_sitemap(docs).drop("blog")
    nested = sitemaps.scan_sitemap_index(docs).drop("blog").withColumn("lastmod", F.lit(None).cast("string"))
    top = found.join(entries.unionByName(nested), "doc_url")
    listed = inventory.build_inventory(top, entries, keep=("origin",))
    left = places.join(found, "blog", "left_anti").select("blog")
    index = sitemaps.archive_index_pages(root_pages(left, store), store)
    linked = sitemaps.scan_archive_links(index).select(
        "blog",
        F.lit(0).cast("bigint").alias("sitemap_seq"),
        F.col("pos").alias("entry_seq"),
        "url",
        F.lit(None).cast("string").alias("lastmod"),
        urls.url_md5(F.col("url")).alias("url_md5"),
        F.lit("widget").alias("origin"),
    )
    return listed.unionByName(linked)


def undiscovered(blogs: DataFrame, found: DataFrame) -> DataFrame:
    """Blogs without a single page in the inventory."""
    return blogs.select("blog").distinct().join(found.select("blog").distinct(), "blog", "left_anti")
