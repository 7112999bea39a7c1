"""Element paths of the site profiles, matched while a page is scanned.

All paths of a profile are compiled to one tree of steps, shared where paths
begin alike. While tags are read, every open element holds the steps that may
come next below it, as a descendant or as a child; an element is tested against
those of its tag only. A path that ends at an element takes its range, its
attributes or the text under it, so one pass over the page yields every field.
Only the fields leave Python: one narrow struct a page, with ranges in place of
bulk text.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pageloom.functions.nodes import VOID_TAGS, element_attributes, tags
from pageloom.profiles import COMMON_FIELDS, FIELDS, PROFILES, Pattern, SiteProfile, Step

#: Start tags whose steps are kept, per profile, and the characters of the longest.
KNOWN_TAGS = 4_000
KNOWN_CHARS = 256

#: Bytes of an Arrow batch that are Python objects at a time, and what any row counts.
SLICE_BYTES = 1 << 20
ROW_BYTES = 1 << 10

_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")

_TEXTS = T.ArrayType(T.StringType())
_RANGE = [T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]
_RANGES = T.ArrayType(T.StructType(_RANGE))

#: What a page yields. ``titles`` holds the first text of each title pattern, null
#: for the title tag, whose text the JVM has; ``date`` and ``description`` the first
#: text of theirs. ``content`` are the candidates in pattern order, ``drops`` the
#: elements to cut out of them.
FIELDS_OF_PAGE = T.StructType(
    [
        T.StructField("titles", _TEXTS),
        T.StructField("date", T.StringType()),
        T.StructField("tags", _TEXTS),
        T.StructField(
            "images",
            T.ArrayType(
                T.StructType([T.StructField("src", T.StringType()), T.StructField("alt", T.StringType()), *_RANGE])
            ),
        ),
        T.StructField("content", _RANGES),
        T.StructField("drops", _RANGES),
        T.StructField("comment_heading", _TEXTS),
        T.StructField("comment_blocks", _TEXTS),
        T.StructField("comment_authors", _TEXTS),
        T.StructField("comment_bodies", _TEXTS),
        T.StructField("header_images", _TEXTS),
        T.StructField("description", T.StringType()),
    ]
)


@dataclass
class State:
    """A step in the tree, the steps after it and the paths that end with it."""

    step: Step
    below: frozenset[int] = frozenset()
    children: frozenset[int] = frozenset()
    ends: list[tuple[int, str]] = field(default_factory=list)

    def accepts(self, attributes: dict[str, str]) -> bool:
        """Whether an element of the right tag passes the step's test."""
        step = self.step
        if not step.attr:
            return True
        value = attributes.get(step.attr)
        if value is None:
            return False
        if step.op == "equals":
            return value == step.value
        if step.op == "word":
            value = f" {_BLANKS.sub(' ', value).strip(' ')} "
        return step.value in value


@dataclass(slots=True)
class Hit:
    """An element that a path selects: its range, attributes and texts."""

    start: int
    stop: int
    attributes: dict[str, str]
    texts: list[str]


class PathTree:
    """Several paths as one tree of steps; ``takes`` are per path."""

    def __init__(self, patterns: Sequence[Pattern]) -> None:
        self.size = len(patterns)
        self.states = [State(Step())]  # the page itself
        seen: dict[tuple[int, Step], int] = {}
        for number, pattern in enumerate(patterns):
            at = 0
            for step in pattern.steps:
                key = (at, step)
                if key not in seen:
                    seen[key] = len(self.states)
                    self.states.append(State(step))
                    before = self.states[at]
                    if step.child:
                        before.children |= {seen[key]}
                    else:
                        before.below |= {seen[key]}
                at = seen[key]
            if at:
                self.states[at].ends.append((number, pattern.take))
        self._known: dict[tuple[frozenset[int], frozenset[int], str, str], tuple] = {}

    def accepted(
        self, below: frozenset[int], children: frozenset[int], tag: str, source: str
    ) -> tuple[tuple[State, ...], dict[str, str]]:
        """Steps that an element passes, and its attributes; start tags repeat, so short ones are kept."""
        key = (below, children, tag, source)
        known = self._known.get(key)
        if known is None:
            attributes = element_attributes(source)
            passed = tuple(
                state
                for state in map(self.states.__getitem__, sorted(below | children))
                if state.step.tag in ("*", tag) and state.accepts(attributes)
            )
            known = (passed, attributes)
            if len(source) <= KNOWN_CHARS:
                if len(self._known) >= KNOWN_TAGS:
                    self._known.clear()
                self._known[key] = known
        return known

    def search(self, page: str) -> list[list[Hit]]:
        """What each path selects, in page order."""
        found: list[list[Hit]] = [[] for _ in range(self.size)]
        none: frozenset[int] = frozenset()
        root = self.states[0]
        # Per open element: its name, its hits, the steps after it, and the texts
        # to which its own and all inner text goes.
        stack = [("", (), root.below, root.children, (), ())]
        open_tags: dict[str, int] = {}
        at = 0
        for begin, end, name, closes, source in tags(page):
            _, _, below, children, own, inner = stack[-1]
            if begin > at and (own or inner):
                text = html_entities.unescape(page[at:begin])
                for texts in (*own, *inner):
                    texts.append(text)
            at = end
            if not name:
                continue
            if closes:
                if open_tags.get(name):
                    while True:
                        closed, hits, *_ = stack.pop()
                        open_tags[closed] -= 1
                        for hit in hits:
                            hit.stop = (end if closed == name else begin) + 1
                        if closed == name:
                            break
                continue
            hits: list[Hit] = []
            own, after, later = (), none, below
            states, attributes = self.accepted(below, children, name, source)
            for state in states:
                later |= state.below
                after |= state.children
                for number, take in state.ends:
                    hit = Hit(begin + 1, end + 1, attributes, [])
                    if take == "text":
                        own = (*own, hit.texts)
                    elif take == "alltext":
                        inner = (*inner, hit.texts)
                    elif take != "element" and take[1:] in attributes:
                        hit.texts.append(attributes[take[1:]])
                    hits.append(hit)
                    found[number].append(hit)
            if name in VOID_TAGS or source.endswith("/"):
                continue
            stack.append((name, hits, later, after, own, inner))
            open_tags[name] = open_tags.get(name, 0) + 1
        for _, hits, *_ in stack:
            for hit in hits:
                hit.stop = len(page) + 1
        return found


#: Elements that never belong to content, whatever the profile.
_SILENT = (Pattern(steps=(Step("script"),)), Pattern(steps=(Step("style"),)))
#: Fields of which the text of each element counts as a whole.
_WHOLE = ("comment_authors", "comment_bodies")


class PageReader:
    """Fields of a page by the patterns of one profile."""

    def __init__(self, profile: SiteProfile) -> None:
        fields = {name: getattr(profile, name) for name in FIELDS} | COMMON_FIELDS
        fields["drops"] = (*fields.pop("content_cleanup"), *_SILENT)
        patterns: list[Pattern] = []
        #: Path numbers per field; None stands for the title tag's pattern.
        self.paths: dict[str, list[int | None]] = {}
        for name, wanted in fields.items():
            numbers = self.paths[name] = []
            for pattern in wanted:
                if pattern.steps:
                    numbers.append(len(patterns))
                    take = "alltext" if name in _WHOLE else pattern.take
                    patterns.append(Pattern(steps=pattern.steps, take=take))
                elif name == "title":
                    numbers.append(None)
        self.tree = PathTree(patterns)

    def read(self, page: str) -> tuple:
        """Values of ``FIELDS_OF_PAGE``."""
        found = self.tree.search(page)

        def hits(name: str) -> list[Hit]:
            return [hit for number in self.paths[name] for hit in found[number]]

        def texts(name: str) -> list[str]:
            return [text for hit in hits(name) for text in hit.texts]

        def first(name: str) -> str | None:
            return next(iter(texts(name)), None)

        titles: list[str | None] = []
        for number in self.paths["title"]:
            if number is None:
                titles.append(None)
            else:
                titles += [text for hit in found[number] for text in hit.texts][:1]
        firsts = dict.fromkeys((h[0].start, h[0].stop) for n in self.paths["content"] if (h := found[n]))
        return (
            titles,
            first("date"),
            texts("tags"),
            [
                (hit.attributes["src"], hit.attributes.get("alt", ""), hit.start, hit.stop)
                for hit in hits("images")
                if "src" in hit.attributes
            ],
            list(firsts),
            [(hit.start, hit.stop) for hit in hits("drops")],
            texts("comment_heading"),
            texts("comment_blocks"),
            ["".join(hit.texts) for hit in hits("comment_authors")],
            ["".join(hit.texts) for hit in hits("comment_bodies")],
            texts("header_images"),
            first("description"),
        )


def slices(pages: pa.Array) -> Iterator[tuple[int, int]]:
    """``(first, count)`` of consecutive rows of at most ``SLICE_BYTES`` and one page each."""
    sizes = pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False)
    filled = np.cumsum(sizes.astype(np.int64) + ROW_BYTES) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(pages)]
    return ((first, end - first) for first, end in zip(cuts, cuts[1:]) if end > first)


def read_slices(kind: pa.DataType, read: Callable[..., object], pages: pa.Array, *others: pa.Array) -> pa.Array:
    """``read`` of every row of an Arrow batch, null for null pages.

    Only a slice of the rows is turned into Python objects at a time: a batch of long
    pages takes a multiple of its bytes as strings, and a worker keeps what it once took.
    """
    parts = [
        pa.array(
            [
                None if page is None else read(page, *rest)
                for page, *rest in zip(*(c.slice(*rows).to_pylist() for c in (pages, *others)))
            ],
            kind,
        )
        for rows in slices(pages)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def page_fields(
    page: Column, profile: Column, profiles: Sequence[SiteProfile] = PROFILES
) -> Column:
    """``FIELDS_OF_PAGE`` of each page by its own profile; null pages give null."""
    readers = {p.name: PageReader(p) for p in profiles}
    kind = to_arrow_type(FIELDS_OF_PAGE)

    @F.arrow_udf(FIELDS_OF_PAGE)
    def read(pages: pa.Array, names: pa.Array) -> pa.Array:
        return read_slices(
            kind, lambda text, name: readers[name].read(text) if name in readers else None, pages, names
        )

    return read(page, profile)


def path_texts(page: Column, patterns: Sequence[Pattern]) -> Column:
    """All texts that the given patterns take, one pattern after the other."""
    tree = PathTree(patterns)

    def texts(page: str) -> list[str]:
        return [t for hits in tree.search(page) for hit in hits for t in hit.texts]

    @F.arrow_udf(_TEXTS)
    def read(pages: pa.Array) -> pa.Array:
        return read_slices(pa.list_(pa.string()), texts, pages)

    return read(page)
