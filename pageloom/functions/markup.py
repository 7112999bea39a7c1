"""Content markup columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import let, strip

# Tags that stay in chapter content.
KEPT_TAGS = ("a", "img", "p", "i", "b", "strong", "ul", "ol", "li", "br", "pre")

PLACEHOLDER = "#pageimage#"

# The captioned table an image is shown in.
IMAGE_TABLE_OPEN = (
    '<table align="center" cellpadding="0" cellspacing="0" class="tr-caption-container"'
    ' style="margin-left: auto; margin-right: auto; text-align: center; background: #FFF;'
    'box-shadow: 1px 1px 5px rgba(0, 0, 0, 0.5); padding: 8px;"><tbody>'
)
IMAGE_CELL_OPEN = '<tr><td style="text-align: center;"><img border="0" src="images/'
IMAGE_CELL_CLOSE = '" /></td></tr>'
CAPTION_OPEN = '<tr><td class="tr-caption" style="text-align: center;">'
CAPTION_CLOSE = "</td></tr>"
IMAGE_TABLE_CLOSE = "</tbody></table>"

def apply_edits_sql(page: str, start: str, stop: str, edits: str) -> str:
    """SQL: ``page[start, stop)`` with character ranges replaced.

    ``edits`` holds ``(start, stop, insert)`` in page coordinates; an edit that
    begins inside an earlier one, or reaches outside the range, is dropped.
    """
    ordered = (
        f"sort_array(filter({edits}, e -> e.start >= {start} AND e.stop <= {stop}))"
    )
    return f"""aggregate({ordered},
        named_struct('at', {start}, 'out', ''),
        (a, e) -> CASE WHEN e.start >= a.at THEN named_struct(
            'at', e.stop,
            'out', concat(a.out, substring({page}, a.at, e.start - a.at), e.insert))
          ELSE a END,
        a -> concat(a.out, substring({page}, a.at, {stop} - a.at)))"""


def remove_patterns(c: Column, regexes: list[str]) -> Column:
    """Delete every match of the cleanup regexes, one after the other."""
    for regex in regexes:
        c = F.regexp_replace(c, regex, "")
    return c


def _collapse_blanks(c: Column) -> Column:
    """Runs of blanks as one space; text without any is not even scanned."""
    has_runs = F.contains(c, F.lit("  "))
    for blank in "\t\r\f\x0b":
        has_runs = has_runs | F.contains(c, F.lit(blank))
    collapsed = F.regexp_replace(c, r"[ \t\r\f\x0b]{2,}|[\t\r\f\x0b]", " ")
    return F.when(has_runs, collapsed).otherwise(c)


def _where(c: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """``change`` for text that holds ``mark``; a look at the bytes spares the rest a regex."""
    return let(c, lambda v: F.when(F.contains(v, F.lit(mark)), change(v)).otherwise(v))


def reduce_markup(c: Column) -> Column:
    """Content with only the kept tags, divs as paragraphs, blanks collapsed."""
    kept = "|".join(KEPT_TAGS)
    c = F.replace(c, F.lit("\n"), F.lit(""))
    more = r"""<a name=["']more["']\s*(/>|></a>)"""
    c = _where(c, "<a name=", lambda v: F.regexp_replace(v, more, ""))
    c = _where(c, "<!--", lambda v: F.regexp_replace(v, r"(?s)<!--.*?-->", ""))
    c = F.regexp_replace(c, r"(?i)<div[^>]*>", "<p>")
    c = F.regexp_replace(c, rf"(?i)</?(?!(?:{kept})\b)[a-zA-Z!][^>]*>", "")
    c = strip(let(c, _collapse_blanks))
    c = _where(c, "</i>", lambda v: F.regexp_replace(v, r"</i>\s*<i>", ""))
    return _where(c, "</b>", lambda v: F.regexp_replace(v, r"</b>\s*<b>", ""))


def placeholder(image_hash: Column) -> Column:
    return F.concat(F.lit(PLACEHOLDER), image_hash, F.lit("#"))


def image_table(fn: Column, description: Column) -> Column:
    caption = F.when(
        F.coalesce(description, F.lit("")) != "",
        F.concat(F.lit(CAPTION_OPEN), description, F.lit(CAPTION_CLOSE)),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit(IMAGE_TABLE_OPEN + IMAGE_CELL_OPEN),
        fn,
        F.lit(IMAGE_CELL_CLOSE),
        caption,
        F.lit(IMAGE_TABLE_CLOSE),
    )


def placeholder_images(content: Column, images: Column) -> Column:
    """Each image's own markup (``html``) replaced by its placeholder."""
    return F.aggregate(
        images, content, lambda acc, i: F.replace(acc, i["html"], placeholder(i["hash"]))
    )


def insert_images(content: Column, images: Column) -> Column:
    """Placeholders replaced by captioned image tables."""
    return F.aggregate(
        images,
        content,
        lambda acc, i: F.replace(
            acc, placeholder(i["hash"]), image_table(i["resized_fn"], i["description"])
        ),
    )


def tags_html(tags: Column) -> Column:
    """Tag line of a chapter, blank without tags."""
    spans = F.transform(
        tags,
        lambda t: F.concat(F.lit('<span epub:type="keyword">'), t, F.lit("</span>")),
    )
    return F.when(
        F.size(tags) > 0, F.concat(F.lit("<h5>"), F.array_join(spans, ", "), F.lit("</h5>"))
    ).otherwise(F.lit(""))


def chapter_xhtml(
    title: Column,
    tags: Column,
    date: Column,
    accessed: Column,
    url: Column,
    content: Column,
    comments: Column,
) -> Column:
    """Body of one chapter: heading, tags, dates, link, content, comments."""
    stamp = "dd MMMM yyyy, HH:mm"
    created = F.when(
        date.isNotNull(),
        F.concat(F.lit("<i>Created: "), F.date_format(date, stamp), F.lit("</i><br/>")),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("<div><h2>"),
        F.coalesce(title, F.lit("")),
        F.lit("</h2>"),
        tags_html(F.coalesce(tags, F.array().cast("array<string>"))),
        F.lit("<p>"),
        created,
        F.lit("<i>Accessed: "),
        F.date_format(accessed, stamp),
        F.lit("</i></p>"),
        F.lit('<p><i><a href="'),
        url,
        F.lit('">'),
        url,
        F.lit("</a></i></p>"),
        F.coalesce(content, F.lit("")),
        F.coalesce(comments, F.lit("")),
        F.lit("</div>"),
    )
