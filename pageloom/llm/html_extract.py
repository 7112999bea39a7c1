"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of tags from the root.
Per path, text length and punctuation are summed and divided by the number of
blocks: running text has long, punctuated blocks, menus have neither. The two
ratios are smoothed over neighbouring blocks and fused, and blocks of paths above
the page's threshold are the seeds of the content. The smallest element that
holds nearly all of their weight is the content node; all its blocks belong to
the text, but for those that markup itself declares to be something else. If that
element is the page itself, the text goes from the first seed to the last.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block is a seed if its fused score is at least this share of the mean score.
THRESHOLD = 0.8
#: Share of the seeds' weight that the content node holds.
COVER = 0.85
#: A path with a larger share of its text in links is made of links.
LINKED = 0.5
#: An element that holds more than this share of the page's weight isn't ruled out by its name.
MOST = 0.5
#: Weights of a block and its neighbours in smoothing.
KERNEL = (0.5, 0.25)

# Fixed lists of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd mark q ruby rb rp rt "
    "rtc s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose inside is never text of the page.
SILENT = "script|style|noscript|template|textarea|svg|math|iframe|object|title|select|xmp|noembed|noframes"
CLOSED_BY_BLOCK = frozenset(("p",))
#: Elements an end of which is implied by the next of its kind.
SIBLINGS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th"),
}
#: What implied ends don't reach beyond.
SCOPES = frozenset("table ul ol dl menu td th article section main aside nav body div".split())
MAIN = frozenset(("article", "main"))
FRAME = frozenset(("html", "body"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text.
RUNNING = HEADINGS | frozenset("p ul ol dl table blockquote pre figure hgroup".split())
ASIDE_TAGS = frozenset(
    "nav aside form footer button dialog menu fieldset label input optgroup datalist legend".split()
)
HEADER_TAGS = frozenset(("header",))
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
    "toolbar".split()
)
#: Elements that a class or id can rule out: containers of blocks, and custom elements.
NAMEABLE = frozenset("article center details div dl header li main ol section table ul".split())
#: Words of class and id that name something beside the article.
ASIDE_WORDS = (
    "ad ads adv adbox adslot adverts? advertisements? advertising alerts? aside banners? breadcrumbs? consent "
    "cookies? copyright disclaimers? feedback footers? form gdpr legal login mastheads? menus? modals? nav navbars? "
    "navigation newsletters? notices? notifications? outbrain overlays? pager pagination pagenav poll popups? "
    "promos? promotions? reactions? recommend recommended recommendations? related rss search share sharing "
    "sidebars? signin signup sitenav skip social sponsors? sponsored submenus? subscribe subscriptions? taboola tags "
    "teasers? toolbars? topbar"
).split()
#: Words for talk about the article, which may be longer than the article.
THREAD_WORDS = "comments? commentlist discuss discussions? disqus replies reply respond responses?".split()
#: Words that name a place or a form, before those above and behind them.
BEFORE = (
    "site page global main primary secondary left right top bottom post article story entry blog wp js mobile "
    "desktop sticky fixed inline inner outer"
).split()
BEHIND = (
    "wrap wrapper container box area section block list inner outer widgets? items? bar btn buttons? icons? links? "
    "panel pane group col column columns row rail region zone slot units? left right top bottom primary secondary "
    "mobile desktop sticky fixed inline horizontal vertical dropdown toggle placeholder holder posts articles stories "
    "entries threads? respond title"
).split()
#: Longer names are not looked at.
NAME_CHARS = 40


def _whole(words: list[str]) -> re.Pattern[str]:
    """Names made up of ``words`` and of words for places and forms only."""
    named = "|".join(words)
    every = "|".join([*ASIDE_WORDS, *THREAD_WORDS, *BEHIND])
    return re.compile(rf"[^a-z]*(?:(?:{'|'.join(BEFORE)})[^a-z]*)*(?:{named})(?:[^a-z]*(?:{every}))*[^a-z]*")


ASIDE_NAME = _whole(ASIDE_WORDS)
THREAD_NAME = _whole(THREAD_WORDS)
HEADER_NAME = _whole(["headers?"])
#: Names of a header that belongs to the article.
ARTICLE_NAME = re.compile(r"\b(?:post|entry|article|story|content|title|headline)\b", re.I)

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<(?P<silent>{SILENT})\b[^>]*+(?:(?<=/)>|>.*?(?:</(?P=silent)\s*+[^>]*+>|\Z))
    |<[!?][^>]*+>
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |</?[a-zA-Z][^>]*+>""",
    re.DOTALL | re.IGNORECASE | re.VERBOSE,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|/|$|=)|display\s*:\s*none""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


@dataclass(slots=True)
class Element:
    """An open element."""

    tag: str
    number: int
    aside: bool
    main: bool
    article: bool


@dataclass(slots=True)
class Block:
    """A block of text with the element straight around it."""

    element: int
    aside: bool
    linked: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""


class Tree:
    """All elements of a page by number, in order of their start; 0 is the page.

    An element knows its parent only, and its path by a number that elements of the
    same tags from the root share. What holds for chains of elements is found in one
    pass over the numbers, since a parent has a smaller one than its children.
    """

    def __init__(self) -> None:
        self.parent, self.tag, self.path, self.depth = [-1], [""], [0], [0]
        self.paths: dict[tuple[int, str], int] = {}

    def add(self, parent: int, tag: str) -> int:
        """A new element's number."""
        key = (self.path[parent], tag)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        self.parent.append(parent)
        self.tag.append(tag)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def sums(self, values: Iterable[tuple[int, float]]) -> list[float]:
        """Sum of ``(element, value)`` pairs over each element and all inside it."""
        total = [0.0] * len(self.parent)
        for element, value in values:
            total[element] += value
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total

    def under(self, marks: Iterable[int]) -> list[bool]:
        """Whether each element is one of ``marks`` or inside one."""
        out = [False] * len(self.parent)
        for m in marks:
            out[m] = True
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out


def _declared_aside(attrs: str) -> bool:
    """Whether role or visibility say that an element isn't article text."""
    if "hidden" in attrs or "none" in attrs:
        if HIDDEN.search(attrs) and 'aria-hidden="false"' not in attrs:
            return True
    return "role" in attrs.lower() and any(
        name.lower() == "role" and "".join(values).lower() in ASIDE_ROLES
        for name, *values in NAMED.findall(attrs)
    )


@lru_cache(1 << 14)
def _kind_of_name(token: str, in_main: bool) -> str:
    """What a whole class or id names: ``aside``, ``thread`` or nothing."""
    if len(token) > NAME_CHARS:
        return ""
    low = token.lower()
    if THREAD_NAME.fullmatch(low):
        return "thread"
    if ASIDE_NAME.fullmatch(low) or (not in_main and HEADER_NAME.fullmatch(low) and not ARTICLE_NAME.search(low)):
        return "aside"
    return ""


def _named(tag: str, attrs: str, in_main: bool, in_article: bool) -> str:
    """What class and id of a container name; an article's sections have their headings' slugs as ids."""
    if tag not in NAMEABLE and "-" not in tag:
        return ""
    given = [(name.lower(), "".join(values).split()) for name, *values in NAMED.findall(attrs)]
    section = tag == "section" or any(n == "class" and "section" in tokens for n, tokens in given)
    kinds = {
        _kind_of_name(token, in_main)
        for name, tokens in given
        if name == "class" or (name == "id" and not (section and in_article))
        for token in tokens
    }
    return "thread" if "thread" in kinds else "aside" if "aside" in kinds else ""


def _rule_out(blocks: list[Block], tree: Tree, named: dict[int, str], marked: set[int]) -> None:
    """Put the blocks of named elements aside, unless a name turns out to be that of a wrapper.

    A named element is a wrapper if no marked article lies beside it and it holds
    a marked article or most of the page's weight. A thread, which may outweigh
    its article, has to hold all seeds. Outer elements are decided before inner ones.
    """
    within = [b for b in blocks if not b.aside]
    fused = scores(within, tree)
    line = THRESHOLD * sum(fused) / max(1, len(fused))
    all_seeds = sum(score >= line for score in fused)
    total = sum(score * len(block.text) for block, score in zip(within, fused))
    weight = tree.sums((b.element, score * len(b.text)) for b, score in zip(within, fused))
    seeds = tree.sums((b.element, score >= line) for b, score in zip(within, fused))
    filled = tree.sums((b.element, 1) for b in within)
    ruled = {e for e in named if filled[e]}
    articles = [a for a in sorted(marked) if filled[a]]
    holds_article = tree.sums((a, 1) for a in articles)
    # Marked articles around each element, and the ruled element next around it or itself.
    around, nearest = [0] * len(tree.parent), [0] * len(tree.parent)
    is_article = set(articles)
    for e in range(1, len(tree.parent)):
        up = tree.parent[e]
        around[e] = around[up] + (up in is_article)
        nearest[e] = e if e in ruled else nearest[up]
    inner = Counter(nearest[a] for a in articles)
    plain = inner[0]  # articles that nothing ruled holds
    for e in sorted(ruled, key=lambda e: (-weight[e], e)):
        if nearest[tree.parent[e]] in ruled:
            continue
        if plain > around[e]:  # an article lies beside it
            continue
        if named[e] == "thread":
            wrapper = weight[e] > 0 and seeds[e] == all_seeds
        else:
            wrapper = holds_article[e] > 0 or weight[e] > MOST * total
        if wrapper:
            ruled.discard(e)
            plain += inner[e]
    aside = tree.under(ruled)
    for block in within:
        block.aside = aside[block.element]


def read_blocks(page: str) -> tuple[list[Block], Tree]:
    """Blocks of a page in order, with white space collapsed, none empty; and its elements."""
    stack: list[Element] = []
    open_tags: Counter[str] = Counter()
    tree = Tree()
    blocks: list[Block] = []
    named: dict[int, str] = {}
    marked: set[int] = set()
    current: Block | None = None
    links = at = 0

    def text(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            top = stack[-1] if stack else None
            current = Block(top.number if top else 0, bool(top and top.aside))
            blocks.append(current)
        current.parts.append(raw)
        if links:
            current.linked += len(raw)

    def close(depth: int) -> None:
        nonlocal current
        open_tags.subtract(e.tag for e in stack[depth:])
        del stack[depth:]
        current = None

    def implied(kinds: Iterable[str]) -> None:
        if not any(open_tags[kind] for kind in kinds):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].tag in kinds:
                close(depth)
                return
            if stack[depth].tag in SCOPES:
                return

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:  # comments, declarations and silent elements
            continue
        tag, end, attrs = tag.lower(), m.group("end"), m.group("attrs")
        if tag == "a":
            links = max(0, links + (-1 if end else 1))
        inline = tag in INLINE
        if end:
            if tag in VOID:
                continue
            if open_tags[tag]:
                close(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth].tag == tag))
            elif not inline:
                current = None
            continue
        declared = tag not in FRAME and bool(attrs) and not attrs.isspace() and _declared_aside(attrs)
        if inline and not declared:
            if tag == "br":
                text(" ")
            continue
        if tag in VOID:
            if not inline:
                current = None
            continue
        if not inline:
            current = None
            if tag in SIBLINGS:
                implied(SIBLINGS[tag])
            else:
                implied(CLOSED_BY_BLOCK)
            if tag in FRAME or tag in MAIN or tag in ("nav", "footer", "header", "aside"):
                links = 0
        top = stack[-1] if stack else None
        inside, in_main, in_article = (top.aside, top.main, top.article) if top else (False, False, False)
        header = tag in HEADER_TAGS and not in_main and not ARTICLE_NAME.search(attrs)
        aside = inside or declared or tag in ASIDE_TAGS or header
        number = tree.add(top.number if top else 0, tag)
        main = tag in MAIN and not aside
        if main:
            marked.add(number)
        if attrs and not aside and (kind := _named(tag, attrs, in_main or main, in_article)):
            named[number] = kind
        stack.append(Element(tag, number, aside, in_main or main, in_article or (main and tag == "article")))
        open_tags[tag] += 1
        current = None
    text(page[at:])
    for block in blocks:
        block.text = " ".join(unescape("".join(block.parts)).split())
    blocks = [b for b in blocks if b.text]
    if named:
        _rule_out(blocks, tree, named, marked)
    return blocks, tree


def scores(blocks: list[Block], tree: Tree) -> list[float]:
    """Smoothed and fused path ratios of each block."""
    totals: dict[int, list[int]] = {}
    for b in blocks:
        t = totals.setdefault(tree.path[b.element], [0, 0, 0, 0])
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(PUNCTUATION.findall(b.text))
        t[3] += min(b.linked, len(b.text))
    mine = [totals[tree.path[b.element]] for b in blocks]
    length = [t[1] / t[0] for t in mine]
    marks = [t[2] / t[0] for t in mine]
    plain = [1 - t[3] / t[1] for t in mine]

    def smooth(x: list[float]) -> list[float]:
        own, beside = KERNEL
        out = []
        for k, v in enumerate(x):
            weight, total = own, own * v
            for j in (k - 1, k + 1):
                if 0 <= j < len(x):
                    weight, total = weight + beside, total + beside * x[j]
            out.append(total / weight)
        return out

    return [
        math.log1p(a) * math.log1p(1 + b) * c for a, b, c in zip(smooth(length), smooth(marks), plain)
    ]


def main_text(page: str) -> str:
    """The article of a page as one line; empty where there is none."""
    blocks, tree = read_blocks(page)
    blocks = [b for b in blocks if not b.aside]
    if not blocks:
        return ""
    fused = scores(blocks, tree)
    line = THRESHOLD * sum(fused) / len(fused)
    seeds = [(b.element, score * len(b.text)) for b, score in zip(blocks, fused) if score >= line]
    weight = tree.sums(seeds)
    least = COVER * sum(w for _, w in seeds)
    held = {e for e, _ in seeds}
    # The deepest element that holds the seeds.
    holders = (e for e in range(1, len(weight)) if weight[e] >= least and (weight[e] > 0 or e in held))
    node = max(holders, key=lambda e: tree.depth[e], default=0)
    # A leaf that holds everything stands for its siblings too.
    if node and tree.tag[node] not in MAIN:
        inside = tree.under([node])
        if not any(inside[b.element] and b.element != node for b in blocks):
            node = tree.parent[node]
    if tree.tag[node] in FRAME or not node:
        kept = _range_of_page(blocks, tree, fused, line)
    else:
        inside = tree.under([node])
        kept = [b for b in blocks if inside[b.element]]
    return " ".join(b.text for b in kept)


def _range_of_page(blocks: list[Block], tree: Tree, fused: list[float], line: float) -> list[Block]:
    """Blocks from the first seed to the last of a page whose text has no element of its own.

    Blocks go by groups, the elements straight in the page. The range takes in
    whole groups, and the groups of running text that adjoin it. Paths made of
    links are left out, but for headings between seeds.
    """
    outermost = [0] * len(tree.parent)  # that is no frame
    for e in range(1, len(outermost)):
        outermost[e] = outermost[tree.parent[e]] or (0 if tree.tag[e] in FRAME else e)
    group = [outermost[b.element] for b in blocks]
    straight = [not g or tree.tag[g] in RUNNING for g in group]
    # made of links on the whole page and in the group, as a list may share its path with a menu
    paths = [tree.path[b.element] for b in blocks]
    excess: dict[tuple[int, int | None], float] = {}
    for b, path, g in zip(blocks, paths, group):
        for key in ((path, None), (path, g)):
            excess[key] = excess.get(key, 0.0) + min(b.linked, len(b.text)) - LINKED * len(b.text)
    links = [excess[path, None] > 0 and excess[path, g] > 0 for path, g in zip(paths, group)]
    seeds = [k for k, score in enumerate(fused) if score >= line]
    first, last = seeds[0], seeds[-1]
    low, high = first, last
    while low and (group[low - 1] == group[low] or (straight[low - 1] and not links[low - 1])):
        low -= 1
    while high + 1 < len(blocks) and (
        group[high + 1] == group[high] or (straight[high + 1] and not links[high + 1])
    ):
        high += 1
    return [
        b
        for k, b in enumerate(blocks)
        if low <= k <= high
        and (not links[k] or fused[k] >= line or (first < k < last and tree.tag[b.element] in HEADINGS))
    ]


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the columns ``keep``, ``text`` and ``n_chars``.

    A null or empty page, and one without an article, has an empty text. Rows
    are taken as they come, repeated or with null keys; other columns are
    ignored.
    """
    read = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = (
        read.drop("__html")
        .withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("bigint")})
        .schema
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("__html").to_pylist()]
            arrays = [batch.column(c) for c in keep]
            arrays += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "text", "n_chars"])

    return read.mapInArrow(run, schema)
