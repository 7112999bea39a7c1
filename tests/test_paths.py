"""The path matcher against a plain evaluation over the node array."""

import tracemalloc

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom import profiles
from pageloom.functions import paths
from pageloom.functions.nodes import page_nodes
from pageloom.profiles import Pattern, Step, child, equal, having, path

POS, LAST, PARENT, TAG, START, STOP, ATTRS, VALUE = range(8)

PIECES = st.sampled_from(
    [
        '<div id="header">', "<div>", "</div>", '<p class="description">', "</p>", "<span>", "</span>",
        '<img src="a.jpg" alt="x">', "<img>", '<a rel="tag">', "</a>", "<b>", "</b>", "text", " é &amp; ",
        '<h1 class="entry-title">', "</h1>", '<div class="entry-content x">', "<article>", "</article>",
        '<div class="comment-block">', '<div id="comments">', "<h4>", "</h4>", "<!-- c -->", "<time>", "</time>",
        '<dl id="comments-block">', '<dt class="comment-author">', "</dt>", '<dd class="comment-body">', "</dd>",
        "</dl>", "<script>var t='</p><h1>';</script>", '<meta property="og:title" content="T">', "<style>x</style>",
        '<h2 class="date-header">', "</h2>", '<div class="a   type-post b">', "<br/>", '<section class="entry-content"/>',
    ]
)


def passes(node, step):
    if node[TAG] == "#text" or step.tag not in ("*", node[TAG]):
        return False
    if not step.attr:
        return True
    value = node[ATTRS].get(step.attr)
    if value is None:
        return False
    if step.op == "word":
        value = f" {' '.join(value.split())} "
    return value == step.value if step.op == "equals" else step.value in value


def plain(nodes, pattern):
    """Selected nodes of a pattern, and the texts it takes."""
    outers = [-1]
    for step in pattern.steps:
        inner = set()
        for o in outers:
            last = len(nodes) - 1 if o < 0 else nodes[o][LAST]
            for n in nodes[o + 1 : last + 1]:
                if passes(n, step) and (not step.child or n[PARENT] == o):
                    inner.add(n[POS])
        outers = sorted(inner)
    texts = []
    for i in outers:
        inside = [n for n in nodes[i + 1 : nodes[i][LAST] + 1] if n[TAG] == "#text"]
        if pattern.take == "text":
            texts += [n[VALUE] for n in inside if n[PARENT] == i]
        elif pattern.take == "alltext":
            texts += [n[VALUE] for n in inside]
        elif pattern.take.startswith("@") and pattern.take[1:] in nodes[i][ATTRS]:
            texts.append(nodes[i][ATTRS][pattern.take[1:]])
    return [(nodes[i][START], nodes[i][STOP]) for i in outers], texts


ALL = tuple(
    dict.fromkeys(
        pattern
        for profile in profiles.PROFILES
        for name in (*profiles.FIELDS, *profiles.COMMON_FIELDS)
        for pattern in (getattr(profile, name, ()) or profiles.COMMON_FIELDS.get(name, ()))
        if pattern.steps
    )
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=50))
def test_all_paths_equal_a_plain_evaluation(pieces):
    page = "".join(pieces)
    nodes = page_nodes(page)
    tree = paths.PathTree(ALL)
    for pattern, hits in zip(ALL, tree.search(page)):
        spans, texts = plain(nodes, pattern)
        assert [(h.start, h.stop) for h in hits] == spans, pattern.expr
        assert [t for h in hits for t in h.texts] == texts, pattern.expr


def test_shared_steps_are_one_state():
    tree = paths.PathTree(profiles.HEADER_IMAGES + profiles.DESCRIPTION)
    chains = sum(len(p.steps) for p in profiles.HEADER_IMAGES + profiles.DESCRIPTION)
    assert len(tree.states) - 1 < chains - 5


def test_start_tags_are_forgotten_when_too_many(monkeypatch):
    monkeypatch.setattr(paths, "KNOWN_TAGS", 3)
    tree = paths.PathTree((path(having("div", "class", "a"), child("p"), take="text"),))
    page = "".join(f'<div class="a{k}"><p>{k}</p></div>' for k in range(10))
    assert [t for h in tree.search(page)[0] for t in h.texts] == [str(k) for k in range(10)]
    assert len(tree._known) <= 3


def test_long_start_tags_are_not_kept():
    tree = paths.PathTree((path(Step("img"), take="@src"),))
    page = "".join(f'<img src="data:{k},{"x" * 5_000}">' for k in range(50)) * 2
    assert len(tree.search(page)[0]) == 100
    assert sum(len(key[3]) for key in tree._known) < 10_000


def test_a_batch_is_read_slice_by_slice(monkeypatch):
    """What Python holds of an Arrow batch is a part of it, whatever the batch's size."""
    monkeypatch.setattr(paths.F, "arrow_udf", lambda kind: lambda fn: fn)
    long = '<h1 class="entry-title">ž{}</h1>' + "ž " * 50_000
    pages = pa.array([None, "", *(long.format(k) for k in range(300)), None, "<h1>", ""])
    names = pa.array(["default"] * 5 + [None, "unknown"] + ["default"] * (len(pages) - 7))
    tracemalloc.start()
    try:
        found = paths.page_fields(pages, names)
        texts = paths.path_texts(pages, (path(Step("h1"), take="text"),))
        assert tracemalloc.get_traced_memory()[1] < pages.nbytes / 4
    finally:
        tracemalloc.stop()
    reader = paths.PageReader(profiles.DEFAULT)
    kind = paths.to_arrow_type(paths.FIELDS_OF_PAGE)
    rows = zip(pages.to_pylist(), names.to_pylist())
    assert found == pa.array([None if p is None or n != "default" else reader.read(p) for p, n in rows], kind)
    assert texts.to_pylist() == [None, [], *([f"ž{k}"] for k in range(300)), None, [], []]
    assert paths.page_fields(pages[:0], names[:0]) == pa.array([], kind)


def test_page_values():
    page = (
        '<title>x</title><h1 class="entry-title"> A </h1><div class="entry-content">c<img src="i.png"><img alt="n">'
        "<script>s</script></div><article>d</article>"
    )
    reader = paths.PageReader(profiles.DEFAULT)
    values = dict(zip(paths.FIELDS_OF_PAGE.names, reader.read(page)))
    assert values["titles"] == [" A ", None]
    assert [page[a - 1 : b - 1] for a, b in values["content"]][1] == "<article>d</article>"
    assert [i[:2] for i in values["images"]] == [("i.png", "")]
    drops = [page[a - 1 : b - 1] for a, b in values["drops"]]
    assert drops == ['<h1 class="entry-title"> A </h1>', "<script>s</script>"]
    assert values["date"] is values["description"] is None
    assert dict(zip(paths.FIELDS_OF_PAGE.names, reader.read("")))["content"] == []


def test_deep_and_long_pages_stay_linear():
    deep = '<div class="entry-content">' * 20_000 + "<article>x"
    hits = paths.PathTree((path(equal("div", "id", "q")), path(Step("article"), take="text"))).search(deep)
    assert [len(h) for h in hits] == [0, 1] and hits[1][0].texts == ["x"]
    assert Pattern().steps == ()
