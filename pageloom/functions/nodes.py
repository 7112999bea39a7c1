"""The one HTML scanner, and the flat node array of a page (V4).

Nodes come in page order. A node knows the index of its parent and of its last
descendant, and its 1-based character range in the page. Bulk text never leaves
the JVM: text is returned only inside the few elements whose text is a field of
its own. Extraction doesn't need the array: ``paths`` finds what the site
profiles ask for while the same scan goes on.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attributes that patterns look at or take.
ATTRIBUTES = frozenset(
    "class id itemprop rel property data-kind content src alt href title text".split()
)

NODE = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("value", T.StringType()),
    ]
)

# HTML elements without an end tag.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)

# Elements worth a row even without an attribute; other bare tags are only
# markup of running text.
_STRUCTURE_TAGS = frozenset(
    "article section div span a img h1 h2 h3 h4 time meta abbr figure dl script style".split()
)

# Elements whose text is a field: headings, dates, tags, comments, description.
_TEXT_TAGS = frozenset(["h1"])
_TEXT_MARKS = re.compile("entry-title|post-title|date-header|comment|description")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in ("script", "style")}


def element_attributes(source: str) -> dict[str, str]:
    """Known attributes of a start tag; of a repeated one the first counts."""
    found: dict[str, str] = {}
    if not source.strip(" /\n\t\r"):
        return found
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        name = name.lower()
        if name in ATTRIBUTES:
            found.setdefault(name, html_entities.unescape(value))
    return found


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """``(begin, end, name, closes, attribute source)`` of every tag, in page order.

    Comments and declarations have no name, and neither has the end of the page,
    which comes last; text lies between the events. The content of scripts and
    styles is part of their start tag.
    """
    at, size = 0, len(page)
    while (token := _TOKEN.search(page, at)) is not None:
        begin, at = token.span()
        close, name, source, close2, name2, source2 = token.groups()
        name = (name or name2 or "").lower()
        closes = bool(close or close2)
        source = source or source2 or ""
        if name in _RAW_END and not closes and not source.endswith("/"):
            raw_end = _RAW_END[name].search(page, at)
            at = raw_end.start() if raw_end else size
        yield begin, at, name, closes, source
    yield size, size, "", False, ""


def page_nodes(page: str) -> list[list]:
    """Rows ``[pos, last, parent, tag, start, stop, attributes, value]`` of a page.

    End tags close up to the nearest open element of the same name and are
    ignored when there is none; whatever is still open ends with the page.
    """
    rows: list[list] = []
    stack: list[tuple[str, list, bool]] = []
    open_tags: Counter[str] = Counter()
    pos = at = 0

    def close(end: int) -> None:
        name, row, _ = stack.pop()
        open_tags[name] -= 1
        row[1], row[5] = pos - 1, end + 1

    for begin, end, name, closes, source in tags(page):
        if stack and stack[-1][2] and begin > at:
            text = html_entities.unescape(page[at:begin])
            rows.append([pos, pos, stack[-1][1][0], "#text", at + 1, begin + 1, {}, text])
            pos += 1
        at = end
        if not name:
            continue
        if closes:
            if open_tags[name]:
                while stack[-1][0] != name:
                    close(begin)
                close(end)
            continue
        attributes = element_attributes(source)
        marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        in_text = (
            bool(stack and stack[-1][2])
            or name in _TEXT_TAGS
            or attributes.get("rel") == "tag"
            or bool(_TEXT_MARKS.search(marks))
        )
        parent = stack[-1][1][0] if stack else -1
        row = [pos, pos, parent, name, begin + 1, end + 1, attributes, None]
        rows.append(row)
        pos += 1
        if name in VOID_TAGS or source.endswith("/"):
            continue
        stack.append((name, row, in_text))
        open_tags[name] += 1
    while stack:
        close(len(page))
    return _kept(rows, pos)


def _kept(rows: list[list], size: int) -> list[list]:
    """Rows patterns can refer to, with positions turned into array indexes.

    A parent that is not kept becomes -2, so a child step never matches it.
    """
    index: dict[int, int] = {-1: -1}
    upto = [0] * size
    kept = []
    for row in rows:
        if row[6] or row[7] is not None or row[3] in _STRUCTURE_TAGS:
            index[row[0]] = len(kept)
            kept.append(row)
        upto[row[0]] = len(kept)
    return [
        [i, upto[row[1]] - 1, index.get(row[2], -2), *row[3:]] for i, row in enumerate(kept)
    ]


@F.arrow_udf(T.ArrayType(NODE))
def html_nodes(pages: pa.Array) -> pa.Array:
    """Node arrays of one Arrow batch; null pages give null."""
    offsets, flat, missing = [0], [], []
    for page in pages.to_pylist():
        missing.append(page is None)
        if page is not None:
            flat.extend(page_nodes(page))
        offsets.append(len(flat))
    pos, last, parent, tag, start, stop, attrs, value = (
        [row[i] for row in flat] for i in range(8)
    )
    attr_ends = [0, *accumulate(len(a) for a in attrs)]
    columns = [
        pa.array(pos, pa.int32()),
        pa.array(last, pa.int32()),
        pa.array(parent, pa.int32()),
        pa.array(tag, pa.string()),
        pa.array(start, pa.int32()),
        pa.array(stop, pa.int32()),
        pa.MapArray.from_arrays(
            pa.array(attr_ends, pa.int32()),
            pa.array([k for a in attrs for k in a], pa.string()),
            pa.array([v for a in attrs for v in a.values()], pa.string()),
        ),
        pa.array(value, pa.string()),
    ]
    nodes = pa.StructArray.from_arrays(columns, names=NODE.names)
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), nodes, mask=pa.array(missing, pa.bool_())
    )
