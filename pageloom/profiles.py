"""Site profiles: ordered pattern lists per field."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import text
from pageloom.functions.urls import PROFILE_URL_FRAGMENTS, profile_of


@dataclass(frozen=True)
class Step:
    """One element step of a path.

    ``op`` is ``contains``, ``equals`` or ``word``; an empty ``attr`` means no
    predicate. ``child`` asks for a direct child instead of any descendant.
    """

    tag: str = "*"
    attr: str = ""
    op: str = "contains"
    value: str = ""
    child: bool = False

    @property
    def expr(self) -> str:
        axis = "/" if self.child else "//"
        if not self.attr:
            return f"{axis}{self.tag}"
        test = {
            "contains": f"contains(@{self.attr}, '{self.value}')",
            "equals": f"@{self.attr}='{self.value}'",
            "word": f"contains(concat(' ',normalize-space(@{self.attr}),' '),'{self.value}')",
        }[self.op]
        return f"{axis}{self.tag}[{test}]"


@dataclass(frozen=True)
class Pattern:
    """Element path or regex.

    ``take`` is ``element``, ``text`` (direct text), ``alltext`` (text at any
    depth) or ``@attribute``.
    """

    steps: tuple[Step, ...] = ()
    take: str = "element"
    regex: str = ""

    @property
    def kind(self) -> str:
        return "regex" if self.regex else "path"

    @property
    def expr(self) -> str:
        if self.regex:
            return self.regex
        tail = {"element": "", "text": "/text()", "alltext": "//text()"}.get(
            self.take, f"/{self.take}"
        )
        return "".join(step.expr for step in self.steps) + tail


def path(*steps: Step, take: str = "element") -> Pattern:
    return Pattern(steps=steps, take=take)


def having(tag: str, attr: str, value: str) -> Step:
    return Step(tag, attr, "contains", value)


def equal(tag: str, attr: str, value: str) -> Step:
    return Step(tag, attr, "equals", value)


def child(tag: str) -> Step:
    return Step(tag, child=True)


_IMG = Step("img")

# The pattern lists, in the order they are tried.
CONTENT = (
    path(having("div", "itemprop", "articleBody")),
    path(having("section", "itemprop", "text")),
    path(having("div", "class", "entry-content")),
    path(having("section", "class", "entry-content")),
    path(equal("div", "id", "content")),
    path(Step("article")),
    path(having("div", "class", "blogcontent")),
)
CONTENT_CLEANUP = (
    Pattern(
        regex=r'<div style="[^"]+">[\s+]*(<br\ ?\/?>)*[\s+]*<span style="[^"]+"><i>Dyskretna Reklama<\/i><\/span>'
    ),
    Pattern(
        regex=r'<span style="[^"]+">(<br\ ?\/?>)*[\s+]*<i>Koniec Dyskretnej Reklamy<\/i><\/span>(<\/div?>)*[\s+]*(<br\ ?\/?>)*'
    ),
    path(equal("div", "class", "post-footer")),
    path(having("*", "class", "entry-title")),
    path(having("*", "class", " post-meta")),
)
TITLE = (
    path(having("*", "class", "entry-title"), take="text"),
    path(having("*", "class", "entry-title"), child("a"), take="text"),
    path(having("*", "class", "post-title"), take="text"),
    path(having("h1", "class", "wp-block-post-title"), take="text"),
    path(equal("meta", "property", "og:title"), take="@content"),
    path(having("div", "class", "entry"), Step("h1"), take="text"),
    Pattern(regex=text.TITLE_TAG_PATTERN),
)
DATE = (
    path(equal("meta", "property", "article:published_time"), take="@content"),
    path(equal("meta", "property", "article:modified_time"), take="@content"),
    path(equal("abbr", "itemprop", "datePublished"), take="@title"),
    path(equal("*", "class", "date-header"), child("span"), take="text"),
    path(equal("time", "property", "datetime"), take="@content"),
    path(Step("time"), take="@text"),
)
IMAGES = (
    path(having("div", "class", "header section"), _IMG),
    path(having("div", "itemprop", "articleBody"), _IMG),
    path(having("figure", "class", "wp-block-post-featured-image"), _IMG),
    path(having("div", "class", "entry-content"), _IMG),
    path(having("section", "class", "entry-content"), _IMG),
    path(having("section", "class", "article-header"), _IMG),
    path(equal("div", "id", "content"), _IMG),
    path(Step("article"), _IMG),
    path(having("img", "class", "wp-post-image")),
    path(Step("a"), _IMG),
)
HEADER_IMAGES = (
    path(having("*", "class", "wp-block-image"), _IMG, take="@src"),
    path(
        equal("div", "id", "header"),
        child("div"),
        child("div"),
        child("div"),
        Step("p", "class", "equals", "description", child=True),
        child("span"),
        child("img"),
        take="@src",
    ),
    path(having("img", "class", "wp-post-image"), take="@src"),
)
DESCRIPTION = (
    path(
        equal("div", "id", "header"),
        child("div"),
        child("div"),
        child("div"),
        Step("p", "class", "equals", "description", child=True),
        child("span"),
        take="text",
    ),
)
TAGS = (path(equal("a", "rel", "tag"), take="alltext"),)
COMMENT_HEADING = (path(equal("div", "id", "comments"), child("h4"), take="text"),)
COMMENT_BLOCKS = (path(equal("div", "class", "comment-block"), take="alltext"),)
COMMENT_AUTHORS = (
    path(equal("dl", "id", "comments-block"), equal("*", "class", "comment-author")),
)
COMMENT_BODIES = (
    path(equal("dl", "id", "comments-block"), equal("*", "class", "comment-body")),
)
ARCHIVE_LINKS = (path(having("div", "class", "BlogArchive"), Step("a"), take="@href"),)
IGNORED_URLS = (r"[http|https]+:\/\/zblogowani.pl[^\s]+",)


@dataclass(frozen=True)
class SiteProfile:
    """Pattern lists of one kind of site, with optional field overrides.

    ``title_override`` maps a title column, ``language_override`` a language
    column; both stay ordinary Column expressions.
    """

    name: str
    content: tuple[Pattern, ...] = CONTENT
    content_cleanup: tuple[Pattern, ...] = CONTENT_CLEANUP
    title: tuple[Pattern, ...] = TITLE
    date: tuple[Pattern, ...] = DATE
    images: tuple[Pattern, ...] = IMAGES
    ignored_urls: tuple[str, ...] = IGNORED_URLS
    date_as_title: bool = False
    title_override: Callable[[Column], Column] | None = field(default=None, compare=False)
    language_override: Callable[[Column], Column] | None = field(default=None, compare=False)


DEFAULT = SiteProfile("default")

# What each kind of site adds or replaces.
BLOGSPOT = replace(
    DEFAULT,
    name="blogspot",
    content=CONTENT
    + (
        path(having("div", "class", "post-body")),
        path(having("div", "itemprop", "articleBody")),
    ),
    images=IMAGES + (path(having("div", "class", "post-body"), _IMG),),
    ignored_urls=IGNORED_URLS
    + (
        r"https:\/\/www.blogger.com\/img\/blogger_logo_[a-z]+_[0-9]+\.png",
        r"https:\/\/resources.blogblog.com\/img\/[a-z0-9_]+.gif",
        r"https:\/\/resources.blogblog.com\/img\/icon_feed[0-9]+.png",
        r"https:\/\/www.paypalobjects.com\/[a-zA-Z_]+\/i\/scr\/pixel.gif",
        r"https:\/\/resources.blogblog.com\/img\/widgets\/[a-zA-Z0-9\-\.]+",
        r"https:\/\/[a-zA-Z0-9\.\/\-\_]+icon[0-9]+_[a-z]+.gif",
    ),
    date_as_title=True,
)
WORDPRESS = replace(
    DEFAULT,
    name="wordpress",
    content=CONTENT
    + (
        path(having("div", "class", "type-post")),
        path(Step("div", "class", "word", "type-post")),
    ),
    images=IMAGES
    + (
        path(having("div", "class", "type-post"), _IMG),
        path(having("img", "class", "size-full")),
        path(having("figure", "class", "wp-block-image"), _IMG),
        path(having("div", "class", "wp-block-image"), _IMG),
        path(_IMG),
    ),
    title=TITLE + (path(having("*", "class", "entry-title"), take="alltext"),),
)
NRDBLOG = replace(
    DEFAULT,
    name="nrdblog",
    title=(Pattern(regex=text.TITLE_TAG_PATTERN),),
    content_cleanup=CONTENT_CLEANUP + (path(equal("div", "class", "bawmrp")),),
)
ZEISSIKONVEB = replace(
    DEFAULT,
    name="zeissikonveb",
    content=(path(equal("div", "id", "Section1")),),
    content_cleanup=(
        path(equal("div", "data-kind", "MENU")),
        Pattern(regex=r"[\s]*\!important"),
        Pattern(
            regex=r"background-color:rgba(255,255,255,1);color:rgba(156,156,156,1);"
        ),
        Pattern(regex=r"font-size:[\s0-9]+px\;"),
        Pattern(regex=r"line-height:[\s0-9]+\;"),
        Pattern(regex=r"font-family:Arial, Helvetica, sans-serif"),
        Pattern(
            regex=r'<p (class|style)="[^"]+" (class|style)="[^"]+"><span style="[^"]+"><br><\/span><\/p>'
        ),
    ),
    date=(
        Pattern(regex=r"letzte Änderung[\s:]*([0-9]{1,2})[\.\s]*([A-Za-z]+)[\.\s]*([0-9]{4})"),
        Pattern(
            regex=r"letzte Aktualisierung[\s:]*([0-9]{1,2})[\.\s]*([A-Za-z]+)[\.\s]*([0-9]{4})"
        ),
        Pattern(regex=r"last update[\s:]*([0-9]{1,2})[\.\s]*([A-Za-z]+)[\.\s]*([0-9]{4})"),
    ),
    images=(path(equal("div", "data-kind", "IMAGE"), _IMG),),
    title_override=text.cut_title_suffix,
    language_override=lambda language: F.lit("de"),
)

PROFILES: tuple[SiteProfile, ...] = (DEFAULT, BLOGSPOT, WORDPRESS, NRDBLOG, ZEISSIKONVEB)

FIELDS = ("content", "content_cleanup", "title", "date", "images")

# Fields every site looks up the same way.
COMMON_FIELDS = {
    "tags": TAGS,
    "comment_heading": COMMENT_HEADING,
    "comment_blocks": COMMENT_BLOCKS,
    "comment_authors": COMMENT_AUTHORS,
    "comment_bodies": COMMENT_BODIES,
    "header_images": HEADER_IMAGES,
    "description": DESCRIPTION,
}


def site_patterns(
    spark: SparkSession, profiles: tuple[SiteProfile, ...] = PROFILES
) -> DataFrame:
    """Pattern rows ``(profile, field, seq, kind, expr)``; a few hundred at most."""
    rows = [
        (profile.name, name, seq, pattern.kind, pattern.expr)
        for profile in profiles
        for name in FIELDS
        for seq, pattern in enumerate(getattr(profile, name))
    ] + [
        (profile.name, "ignored_urls", seq, "regex", rule)
        for profile in profiles
        for seq, rule in enumerate(profile.ignored_urls)
    ]
    return spark.createDataFrame(rows, schemas.SITE_PATTERNS)


def with_profile(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pattern rows of every page's profile; the pattern table is fixed and small."""
    return df.withColumn("profile", profile_of(F.col("url"))).join(
        F.broadcast(patterns), "profile"
    )


def override(
    value: Column, profile: Column, hook: str, profiles: tuple[SiteProfile, ...] = PROFILES
) -> Column:
    """Apply each profile's own hook to its rows and leave the rest alone."""
    result = value
    for p in profiles:
        fn = getattr(p, hook)
        if fn is not None:
            result = F.when(profile == p.name, fn(value)).otherwise(result)
    return result


__all__ = [
    "BLOGSPOT",
    "DEFAULT",
    "NRDBLOG",
    "PROFILES",
    "PROFILE_URL_FRAGMENTS",
    "WORDPRESS",
    "ZEISSIKONVEB",
    "Pattern",
    "SiteProfile",
    "Step",
    "child",
    "equal",
    "having",
    "override",
    "path",
    "profile_of",
    "site_patterns",
    "with_profile",
]
