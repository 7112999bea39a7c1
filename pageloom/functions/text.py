"""Page-level text columns (X9-X13, X17, F11, parse check)."""

from __future__ import annotations

import html as html_entities

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns tried in order for the page language and its title.
LANGUAGE_PATTERNS = (
    r"'lang':[\s]*'([a-z^']+)'",
    r"""lang=['"]([a-z]+)['"]""",
    r"""locale['"]:[\s]*['"]([a-z]+)['"]""",
)
TITLE_TAG_PATTERN = r"<title>([^>^<]*)</title>"
TITLE_CUT_LENGTH = 60
TITLE_CUT_MARK = "&#8211;"
INTERSTITIAL_PATTERN = r'interstitial=([^"]+)'

# Characters XML can hold; a page with any other one is not parseable. The
# anchored form is one forward pass without backtracking.
_XML_CHARS = r"\t\n\r\x20-\uFFFD\x{10000}-\x{10FFFF}"
_ALL_XML = rf"\A[{_XML_CHARS}]*+\z"

# What strip() removes in the pages at hand.
BLANK = " \t\n\r\x0b\x0c"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once and referred to many times."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


# The same trimming inside SQL text; the blanks are written as one literal.
STRIP_SQL = r"trim(BOTH ' \t\n\r\u000b\u000c' FROM {})"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANK))


@F.arrow_udf(T.StringType())
def html_unescape(values: pa.Array) -> pa.Array:
    """Entities to characters; one Arrow batch at a time."""
    return pa.array(
        [v if v is None or "&" not in v else html_entities.unescape(v) for v in values.to_pylist()],
        type=pa.string(),
    )


def is_parseable(html: Column) -> Column:
    """True for pages the extraction accepts; decides rows before any Python runs."""
    return html.isNotNull() & html.rlike(_ALL_XML)


def detect_language(html: Column, profile: Column | None = None) -> Column:
    hits = [
        F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")) for pattern in LANGUAGE_PATTERNS
    ]
    language = F.coalesce(*hits, F.lit("en"))
    if profile is None:
        return language
    return F.when(profile == "zeissikonveb", "de").otherwise(language)


def title_tag(html: Column) -> Column:
    """Raw text of the title element, blank when there is none."""
    return strip(F.regexp_extract(html, TITLE_TAG_PATTERN, 1))


def raw_blog_title(html: Column, profile: Column | None = None) -> Column:
    """Blog title before entities are resolved."""
    title = title_tag(html)
    is_long = (F.length(title) > TITLE_CUT_LENGTH) & F.contains(title, F.lit(TITLE_CUT_MARK))
    if profile is not None:
        is_long = is_long & (profile != "nrdblog")
    cut = strip(F.split_part(title, F.lit(TITLE_CUT_MARK), F.lit(1)))
    return F.when(is_long, cut).otherwise(title)


def blog_title(html: Column, profile: Column | None = None) -> Column:
    return html_unescape(raw_blog_title(html, profile))


def interstitial_token(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, INTERSTITIAL_PATTERN, 1), F.lit(""))


def clever_decode(content: Column) -> Column:
    """Bytes as UTF-8 where valid, else as Latin-1."""
    return F.when(
        F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))


def fix_html_tags(c: Column) -> Column:
    """Quote bare attributes and close the void tags that break XML readers."""
    c = F.regexp_replace(c, r"([a-zA-Z0-9\-]+)=([a-zA-Z0-9\./\-:#_]+)([>\s])", r'$1="$2"$3')
    c = F.regexp_replace(c, r"<meta content=([^>]+)>", r"<meta content=$1 />")
    c = F.regexp_replace(c, r"<link href=([^>]+)>", r"<link href=$1 />")
    c = F.regexp_replace(c, r"<img ([^>]+)>", r"<img $1 />")
    c = F.replace(c, F.lit("//>"), F.lit("/>"))
    return F.replace(c, F.lit("<br>"), F.lit("<br/>"))


def cut_title_suffix(c: Column) -> Column:
    """Part of a title before the first bar."""
    return F.split_part(c, F.lit("|"), F.lit(1))


def escape_html(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))
