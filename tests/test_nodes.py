"""The HTML helper against its invariants and small pages worked by hand."""

from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.functions.nodes import VOID_TAGS, page_nodes

POS, LAST, PARENT, TAG, START, STOP, ATTRS, VALUE = range(8)

PIECES = st.sampled_from(
    [
        "<div class='a'>", "</div>", "<p>", "</p>", "<b>", "</b>", "<br>", "<br/>",
        "<img src='x.jpg'>", "<h1>", "</h1>", "<a rel=tag>", "</a>", "text", " é ", "<",
        "<!-- c -->", "<script>var t='</p>';</script>", "<!DOCTYPE html>", "&amp;", '<span id="q',
    ]
)


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=40))
def test_intervals_nest(pieces):
    page = "".join(pieces)
    rows = page_nodes(page)
    for i, row in enumerate(rows):
        assert row[POS] == i <= row[LAST] < len(rows)
        assert 1 <= row[START] <= row[STOP] <= len(page) + 1
        assert row[PARENT] < i
        if row[PARENT] >= 0:
            outer = rows[row[PARENT]]
            assert outer[LAST] >= row[LAST]
            assert outer[START] <= row[START] and row[STOP] <= outer[STOP]


class _Counter(HTMLParser):
    """Open elements per tag, the way the stack rule counts them."""

    def __init__(self):
        super().__init__()
        self.seen = {}

    def handle_starttag(self, tag, attrs):
        self.seen[tag] = self.seen.get(tag, 0) + 1


@settings(max_examples=100, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            ["<div>", "</div>", "<h1>", "</h1>", "<a href='x'>", "</a>", "<img src=a>", "word", "<p>"]
        ),
        max_size=30,
    )
)
def test_same_elements_as_the_standard_parser(pieces):
    page = "".join(pieces)
    parser = _Counter()
    parser.feed(page)
    parser.close()
    rows = page_nodes(page)
    for tag in ("div", "h1", "a", "img"):
        assert sum(r[TAG] == tag for r in rows) == parser.seen.get(tag, 0)


def test_unclosed_and_stray_tags():
    rows = page_nodes("<div id=a><h1>one<b>two</div></h1><article>rest")
    tags = [(r[TAG], r[PARENT]) for r in rows if r[TAG] != "#text"]
    assert tags == [("div", -1), ("h1", 0), ("article", -1)]
    page = "<div id=a><h1>one<b>two</div></h1><article>rest"
    article = rows[-1]
    assert page[article[START] - 1 : article[STOP] - 1] == "<article>rest"


def test_script_is_not_markup():
    rows = page_nodes("<script>var t='<h1>no</h1>';</script><h1>yes</h1>")
    assert [r[VALUE] for r in rows if r[TAG] == "#text"] == ["yes"]


def test_attributes_and_entities():
    rows = page_nodes('<img SRC=a.jpg alt="x &amp; y" data-x=1><h1>T &eacute;</h1>')
    assert rows[0][ATTRS] == {"src": "a.jpg", "alt": "x & y"}
    assert rows[2][VALUE] == "T é"
    assert "img" in VOID_TAGS
