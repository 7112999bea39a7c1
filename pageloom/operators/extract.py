"""Field extraction (E1-E11, F5, F11): pages in, article rows out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pageloom.config import JobConfig
from pageloom.functions import dates, markup, paths, text, urls
from pageloom.profiles import PROFILES, SiteProfile, override
from pageloom.session import staged
from pageloom.sources.store import fetch_bodies


def drop_unparsed(pages: DataFrame, losses: Observation | None = None) -> DataFrame:
    """Pages the extraction can read; missing and unreadable bodies go.

    ``losses`` counts ``pages``, and those dropped as ``missing`` or ``unreadable``, while
    the rows go by.
    """
    if losses is None:
        return pages.filter(text.is_parseable(F.col("html")))
    read = pages.withColumn("__readable", text.is_parseable(F.col("html"))).observe(
        losses,
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("html").isNull()).alias("missing"),
        F.count_if(F.col("html").isNotNull() & ~F.col("__readable")).alias("unreadable"),
    )
    return read.filter("__readable").drop("__readable")


def count_unparsed(pages: DataFrame) -> DataFrame:
    """Pages and dropped pages per blog, for the run report."""
    return pages.groupBy("blog").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(~text.is_parseable(F.col("html"))).alias("dropped"),
    )


def interstitials(pages: DataFrame) -> DataFrame:
    """Interstitial token of every page that carries one."""
    return pages.withColumn("token", text.interstitial_token(F.col("html"))).filter(
        F.col("token").isNotNull()
    )


def with_matches(
    pages: DataFrame,
    profiles: Sequence[SiteProfile] = PROFILES,
    losses: Observation | None = None,
) -> DataFrame:
    """Parseable pages with their profile and, in ``found``, what its paths select.

    Both Python columns come from one Arrow exchange; everything after it runs
    in the JVM.
    """
    profile = urls.profile_of(F.col("url"))
    return (
        drop_unparsed(pages, losses)
        .withColumn("profile", profile)
        .withColumns(
            {
                "found": paths.page_fields(F.col("html"), F.col("profile"), profiles),
                "title_tag": text.html_unescape(text.title_tag(F.col("html"))),
            }
        )
    )


def title_column(profiles: Sequence[SiteProfile] = PROFILES) -> Column:
    """First pattern whose trimmed text has more than one character."""
    first = text.STRIP_SQL.format("coalesce(t, title_tag)")
    title = F.expr(f"get(filter(transform(found.titles, t -> {first}), t -> length(t) > 1), 0)")
    return override(title, F.col("profile"), "title_override", tuple(profiles))


def date_raw_column(profiles: Sequence[SiteProfile] = PROFILES) -> Column:
    """Date text of the first pattern that matches."""
    raw = F.col("found.date")
    for profile in profiles:
        regexes = [p.regex for p in profile.date if p.regex]
        if regexes:
            hits = [
                F.nullif(
                    F.concat_ws(" ", *(F.regexp_extract(F.col("html"), r, i) for i in (1, 2, 3))),
                    F.lit("  "),
                )
                for r in regexes
            ]
            raw = F.coalesce(raw, F.when(F.col("profile") == profile.name, F.coalesce(*hits)))
    return raw


def tags_column() -> Column:
    """Trimmed text of every tag link; repeats and blanks stay."""
    return F.expr(f"transform(found.tags, t -> {text.STRIP_SQL.format('t')})")


def image_refs_column() -> Column:
    """``ARRAY<STRUCT<src, alt, start, stop>>`` over all image patterns."""
    return F.col("found.images")


def ignored_url_column(url: Column, profiles: Sequence[SiteProfile] = PROFILES) -> Column:
    """True when a rule of the row's profile matches the start of the URL."""
    rules: dict[str, list[str]] = {}
    for profile in profiles:
        for rule in profile.ignored_urls:
            rules.setdefault(rule, []).append(profile.name)
    hit = F.lit(False)
    for rule, users in rules.items():
        applies = F.lit(True) if len(users) == len(profiles) else F.col("profile").isin(*users)
        hit = hit | (applies & url.rlike(f"^(?:{rule})"))
    return hit


def resolved_images(refs: Column, blog: Column, cfg: JobConfig) -> Column:
    """References with absolute URL, hash and file name; unusable ones dropped."""
    full = F.transform(
        refs,
        lambda r: F.struct(
            urls.absolute_image_url(r["src"], blog).alias("url"),
            r["alt"].alias("description"),
            r["start"].alias("start"),
            r["stop"].alias("stop"),
        ),
    )
    usable = F.filter(
        full, lambda i: urls.is_supported_image(i["url"]) & ~ignored_url_column(i["url"])
    )
    return F.transform(
        usable,
        lambda i: F.struct(
            i["url"].alias("url"),
            i["description"].alias("description"),
            F.md5(i["url"]).alias("hash"),
            urls.image_ext(i["url"]).alias("ext"),
            F.lit(True).alias("is_supported"),
            urls.resized_fn(F.md5(i["url"]), cfg).alias("resized_fn"),
            i["start"].alias("start"),
            i["stop"].alias("stop"),
        ),
    )


def _cleanup(c: Column, profiles: Sequence[SiteProfile]) -> Column:
    """Regex cleanup of each row's own profile."""
    chains: dict[tuple[str, ...], list[str]] = {}
    for profile in profiles:
        chain = tuple(p.regex for p in profile.content_cleanup if p.regex)
        chains.setdefault(chain, []).append(profile.name)
    ranked = sorted(chains.items(), key=lambda item: len(item[1]))
    *special, (common, _) = ranked
    result = markup.remove_patterns(c, list(common))
    for chain, users in special:
        result = F.when(
            F.col("profile").isin(*users), markup.remove_patterns(c, list(chain))
        ).otherwise(result)
    return result


def edits_column() -> Column:
    """Character ranges to drop (cleanup elements, scripts) or to turn into
    image placeholders."""
    return F.expr(
        f"""concat(
          transform(found.drops, n -> named_struct('start', n.start, 'stop', n.stop, 'insert', '')),
          transform(found_images, i -> named_struct('start', i.start, 'stop', i.stop,
            'insert', concat('{markup.PLACEHOLDER}', i.hash, '#'))))"""
    )


def content_column(profiles: Sequence[SiteProfile] = PROFILES) -> Column:
    """First candidate that is not blank after cleanup; later ones are not
    even cleaned (E3)."""
    pieces = F.expr(
        f"transform(found.content, c -> {markup.apply_edits_sql('html', 'c.start', 'c.stop', 'edits')})"
    )
    cleaned = F.aggregate(
        pieces,
        F.lit(""),
        lambda best, piece: F.when(best != "", best).otherwise(
            markup.reduce_markup(_cleanup(piece, profiles))
        ),
    )
    return markup.insert_images(cleaned, F.col("found_images"))


def block_comments_sql(texts: str, cfg: JobConfig) -> str:
    """SQL: author and body elements from the texts of the block layout.

    The first kept text is an author, later ones are bodies until the reset
    caption makes the next one an author again.
    """
    noise = ", ".join(f"'{w}'" for w in cfg.comment_noise)
    return f"""aggregate({texts},
        named_struct('tag', 'h4', 'out', ''),
        (s, t) -> CASE
          WHEN t = '{cfg.comment_reset}' THEN named_struct('tag', 'h4', 'out', s.out)
          WHEN t IN ({noise}) THEN s
          ELSE named_struct('tag', 'p',
            'out', concat(s.out, '<', s.tag, '>', t, '</', s.tag, '>')) END,
        s -> s.out)"""


def listed_comments_sql() -> str:
    """SQL: author/body pairs of the list layout, up to the shorter list."""
    author, body = (text.STRIP_SQL.format(c) for c in "ab")
    return rf"""array_join(
        filter(zip_with(found.comment_authors, found.comment_bodies, (a, b) ->
          concat('<h4>', replace({author}, '\n', ' '), '</h4><p>', {body}, '</p>')),
        c -> c IS NOT NULL), '')"""


def comment_texts_column() -> Column:
    """Non-blank texts of the comment blocks."""
    return F.expr(
        f"filter(transform(found.comment_blocks, t -> {text.STRIP_SQL.format('t')}), t -> t <> '')"
    )


def comment_texts(
    pages: DataFrame, page: str, profiles: Sequence[SiteProfile] = PROFILES
) -> DataFrame:
    """``(page, pos, text)`` of the comment blocks of ``pages``, for W5.

    ``page`` names the column that tells pages apart.
    """
    found = with_matches(pages, profiles).withColumn("comment_texts", comment_texts_column())
    return found.select(
        F.col(page).alias("page"), F.posexplode("comment_texts").alias("pos", "text")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def comments_column(cfg: JobConfig) -> Column:
    """Comment markup of a page, with its heading only when there are comments."""
    heading = """(CASE WHEN size(found.comment_heading) = 1
        THEN concat('<hr/><h3>', found.comment_heading[0], '</h3>') ELSE '' END)"""
    return F.expr(
        f"""transform(array(CASE
            WHEN size(comment_texts) > 0 THEN {block_comments_sql("comment_texts", cfg)}
            ELSE {listed_comments_sql()} END),
          b -> CASE WHEN b = '' THEN b ELSE concat({heading}, b) END)[0]"""
    )


def header_images_column() -> Column:
    """Source of every header image."""
    return F.col("found.header_images")


def description_column() -> Column:
    """First text of the header paragraph, blank without one."""
    return F.coalesce(F.col("found.description"), F.lit(""))


def extract_fields(
    pages: DataFrame,
    cfg: JobConfig,
    profiles: Sequence[SiteProfile] = PROFILES,
    losses: Observation | None = None,
) -> DataFrame:
    """Every page field of ``pages(blog, ..., url, html)``; no shuffle."""
    fields = (
        with_matches(pages, profiles, losses)
        .withColumn("image_refs", image_refs_column())
        .withColumn("found_images", resolved_images(F.col("image_refs"), F.col("blog"), cfg))
        .withColumns(
            {
                "edits": edits_column(),
                "comment_texts": comment_texts_column(),
            }
        )
        .withColumns(
            {
                "title": title_column(profiles),
                "date_raw": date_raw_column(profiles),
                "page_language": text.detect_language(F.col("html"), F.col("profile")),
                "tags": tags_column(),
                "content": content_column(profiles),
                "comments": comments_column(cfg),
                "images": F.transform(
                    F.col("found_images"), lambda i: i.dropFields("start", "stop")
                ),
            }
        )
    )
    return fields.drop(
        "found", "title_tag", "edits", "comment_texts", "found_images"
    )


class Losses:
    """Counters of one extraction, filled by the first action on its rows.

    They are taken while rows go by, so nothing is read twice. A task that Spark runs
    again may be counted again.
    """

    def __init__(self) -> None:
        self.pages, self.articles = Observation(), Observation()

    def counts(self) -> dict[str, int]:
        """``pages, missing, unreadable, articles, unknown_dates, dates_from_url, empty``.

        ``unknown_dates`` are date texts that no format reads, ``dates_from_url`` pages
        without any; waits for the action.
        """
        return {**self.pages.get, **self.articles.get}


def with_blog_meta(rows: DataFrame, blogs: DataFrame) -> DataFrame:
    """Rows with their blog's title and language."""
    meta = blogs.select(
        "blog", F.col("title").alias("blog_title"), F.col("language").alias("blog_language")
    )
    return rows.join(meta, "blog", "left")


def extract_articles(
    pages: DataFrame,
    cfg: JobConfig,
    blogs: DataFrame | None = None,
    profiles: Sequence[SiteProfile] = PROFILES,
    keep: Sequence[str] = (),
    losses: Losses | None = None,
) -> DataFrame:
    """Article rows of ``pages(blog, seq, url, html)``.

    Each blog's own title and language come from columns ``blog_title`` and
    ``blog_language`` of the pages, best joined on before bodies are fetched
    (``with_blog_meta``). ``blogs(blog, title, language)`` joins them on here,
    from a table in the shared folder: its size is known then, so Spark broadcasts
    it below its threshold, and only beyond that content is shuffled. Without
    either the page speaks for itself. ``keep`` names further input columns to
    carry along. ``losses`` counts what is lost on the way, in the same pass.
    """
    known = [c for c in ("blog_title", "blog_language") if c in pages.columns]
    fields = extract_fields(
        pages.select("blog", "seq", "url", "html", *known, *keep),
        cfg,
        profiles,
        losses.pages if losses else None,
    ).drop("html")
    if blogs is not None:
        fields = with_blog_meta(
            fields.drop(*known), staged(blogs.select("blog", "title", "language"), "blog-meta")
        )
    elif len(known) < 2:
        unknown = F.lit(None).cast("string")
        fields = fields.drop(*known).withColumns(
            {"blog_title": unknown, "blog_language": unknown}
        )
    fields = fields.withColumn("language", F.coalesce("blog_language", "page_language"))
    date_as_title = [p.name for p in profiles if p.date_as_title]
    date_language = override(F.col("language"), F.col("profile"), "language_override", tuple(profiles))
    dated = fields.withColumn(
        "date", dates.article_date(F.col("date_raw"), date_language, F.col("url"), cfg.as_of)
    )
    if losses is not None:
        dated = dated.observe(
            losses.articles,
            F.count(F.lit(1)).alias("articles"),
            F.count_if(F.col("date_raw").isNotNull() & F.col("date").isNull()).alias("unknown_dates"),
            F.count_if(F.col("date_raw").isNull()).alias("dates_from_url"),
            F.count_if(F.coalesce(F.col("content"), F.lit("")) == "").alias("empty"),
        )
    return (
        dated.withColumn(
            "title",
            F.when(
                F.col("profile").isin(*date_as_title),
                dates.title_or_date(F.col("title"), F.col("blog_title"), F.col("date")),
            ).otherwise(F.col("title")),
        )
        .select(
            "blog",
            "seq",
            "url",
            "title",
            "date",
            F.lit(cfg.accessed_at).alias("accessed"),
            "language",
            "tags",
            "images",
            "content",
            "comments",
            *keep,
        )
    )


def chosen_pages(pages: DataFrame) -> DataFrame:
    """``(blog, seq)`` of the page that speaks for each blog, from narrow rows.

    ``pages(blog, seq, url, readable, titled)``: the root page if it has a title,
    else the first page with one, else the last readable page, else null.
    """
    is_root = F.trim(F.col("url"), F.lit("/")) == F.trim(F.col("blog"), F.lit("/"))
    return pages.groupBy("blog").agg(
        F.coalesce(
            F.min(F.when(F.col("titled") & is_root, F.col("seq"))),
            F.min(F.when(F.col("titled"), F.col("seq"))),
            F.max(F.when(F.col("readable"), F.col("seq"))),
        ).alias("seq")
    )


def page_metadata(picked: DataFrame) -> DataFrame:
    """Metadata rows of ``picked(blog, url, html)``, one per blog; url and html may be null."""
    picked = picked.withColumns(
        {"url": F.coalesce("url", "blog"), "html": F.coalesce("html", F.lit(""))}
    )
    return (
        picked.withColumn("profile", urls.profile_of(F.col("url")))
        .withColumns(
            {
                "found": paths.page_fields(F.col("html"), F.col("profile")),
                "title": text.blog_title(F.col("html"), F.col("profile")),
                "language": text.detect_language(F.col("html"), F.col("profile")),
            }
        )
        .select(
            "blog",
            "profile",
            "language",
            "title",
            description_column().alias("description"),
            header_images_column().alias("header_images"),
            urls.file_prefix(F.col("blog")).alias("file_prefix"),
        )
    )


def blog_metadata(pages: DataFrame) -> DataFrame:
    """One row per blog, from its root page or its first page with a title.

    A blog without a titled page takes language and description from the last
    page that can be read, and one without any such page still has its prefix.
    ``pages(blog, seq, url, html)``. The page is chosen on narrow columns, and the
    choices are staged, so that Spark knows their size: below its threshold they are
    broadcast to where the bodies lie. For a page store, whose bodies never move,
    use :func:`store_metadata`.
    """
    readable = text.is_parseable(F.col("html"))
    titled = readable & (text.title_tag(F.col("html")) != "")
    narrow = pages.select("blog", "seq", "url", readable.alias("readable"), titled.alias("titled"))
    chosen = staged(chosen_pages(narrow), "chosen-pages")
    bodies = pages.join(chosen.filter("seq is not null"), ["blog", "seq"], "left_semi").filter(readable)
    # Of pages that share a place, the first in order of URL and body counts.
    found = bodies.groupBy("blog").agg(F.min(F.struct("url", "html")).alias("one")).select("blog", "one.*")
    return page_metadata(chosen.select("blog").join(found, "blog", "left"))


def store_metadata(store: DataFrame) -> DataFrame:
    """:func:`blog_metadata` of an opened page store, in order of ``page_id``.

    Pages are chosen without reading a body; chosen ones are fetched from their
    buckets.
    """
    narrow = store.select("blog", F.col("page_id").alias("seq"), "url", "readable", "titled")
    chosen = chosen_pages(narrow.filter("blog is not null"))
    keys = store.filter("readable").select("blog", F.col("page_id").alias("seq"), "url", "url_md5")
    wanted = staged(
        chosen.join(keys, ["blog", "seq"], "left")
        .groupBy("blog")
        .agg(F.min(F.struct("url", "url_md5")).alias("one"))
        .select("blog", "one.*"),
        "chosen-pages",
    )
    return page_metadata(fetch_bodies(wanted, store, "left"))
