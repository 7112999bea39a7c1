"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT, BOOL, TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


IMAGE = _table(
    url=STRING,
    description=STRING,
    hash=STRING,
    ext=STRING,
    is_supported=BOOL,
    resized_fn=STRING,
)

PAGES = _table(page_id=LONG, url=STRING, html=STRING)

PAGE_STORE = _table(
    url_md5=STRING,
    page_id=LONG,
    blog=STRING,
    url=STRING,
    readable=BOOL,
    titled=BOOL,
    html=STRING,
)

SEEDS = _table(url=STRING, limit=STRING, skip=STRING)

PAGE_INVENTORY = _table(
    blog=STRING,
    sitemap_seq=LONG,
    entry_seq=LONG,
    url=STRING,
    url_md5=STRING,
    lastmod=STRING,
)

ARTICLES = _table(
    blog=STRING,
    seq=LONG,
    url=STRING,
    title=STRING,
    date=TS,
    accessed=TS,
    language=STRING,
    tags=T.ArrayType(STRING),
    images=T.ArrayType(IMAGE),
    content=STRING,
    comments=STRING,
)

BOOKS = _table(
    blog=STRING,
    title=STRING,
    subtitle=STRING,
    description=STRING,
    start=TS,
    end=TS,
    n_articles=LONG,
    file_name=STRING,
    author=STRING,
)

CHAPTERS = _table(
    blog=STRING,
    number=LONG,
    uid=STRING,
    href=STRING,
    title=STRING,
    lang=STRING,
    toc_pos=LONG,
    spine_pos=LONG,
    xhtml=STRING,
)

CRAWL_HISTORY = _table(url=STRING, used=LONG, last=TS)

SITE_PATTERNS = _table(
    profile=STRING, field=STRING, seq=INT, kind=STRING, expr=STRING
)

# from_xml schemas: sitemaps (both kinds at once) and Atom feeds.
SITEMAP_XML = "url ARRAY<STRUCT<loc: STRING, lastmod: STRING>>, sitemap ARRAY<STRUCT<loc: STRING>>"
ATOM_XML = (
    "entry ARRAY<STRUCT<title: STRUCT<_VALUE: STRING>,"
    " link: ARRAY<STRUCT<_rel: STRING, _href: STRING>>,"
    " published: STRING, content: STRUCT<_VALUE: STRING>>>"
)
