from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.config import JobConfig
from pageloom.functions import markup, text
from pageloom.functions.urls import blog_of
from pageloom.operators import extract

CFG = JobConfig()

POST = """<html lang="pl"><head><title>My &amp; Blog</title><style>x</style></head><body>
<div id="header"><div><div><div><p class="description"><span>About<img src="/h.png"></span></p>
</div></div></div></div><h2 class="date-header"><span>wtorek, 5 stycznia 2012</span></h2>
<h3 class="post-title entry-title"> Ti &lt;tle </h3>
<div class="entry-content"><div>Hello <em>w</em>orld<br><b>a</b> <b>b</b></div><!-- x -->
<img src="/a.jpg" alt="cap">tail<script>var t="</p>";</script>
<a name="more"></a><div class="post-footer">foot</div></div>
<a rel="tag" href=x> t1 </a><a rel="tag">t2</a></body></html>"""


def pages(spark, *rows):
    df = spark.createDataFrame(
        [(i, url, html) for i, (url, html) in enumerate(rows)], "seq long, url string, html string"
    )
    return df.withColumn("blog", blog_of(F.col("url")))


def one(spark, html, url="https://x.blogspot.com/2012/01/a.html", cfg=CFG):
    return extract.extract_articles(pages(spark, (url, html)), cfg).first()


def test_whole_post(spark):
    row = one(spark, POST)
    assert row.title == "Ti <tle"
    assert row.date == datetime(2012, 1, 5)
    assert row.tags == ["t1", "t2"]
    assert row.language == "pl"
    assert [i.url for i in row.images] == ["https://x.blogspot.com/a.jpg"]
    assert row.content.startswith("<p><p>Hello world<br><b>ab</b><table align=")
    assert row.content.endswith("</tbody></table>tail")
    assert "cap</td>" in row.content
    assert markup.PLACEHOLDER not in row.content
    assert "foot" not in row.content and "var t" not in row.content


def test_missing_and_unreadable_pages_are_dropped(spark):
    df = pages(
        spark,
        ("https://a.com/1", "<p>ok"),
        ("https://a.com/2", None),
        ("https://a.com/3", "bad \x01 mark"),
        ("https://a.com/4", "astral \U0001f600 fine"),
    )
    got = [r.url for r in extract.extract_articles(df, CFG).orderBy("seq").collect()]
    assert got == ["https://a.com/1", "https://a.com/4"]
    counts = extract.count_unparsed(df).first()
    assert (counts.pages, counts.dropped) == (4, 2)


def test_losses_are_counted_while_rows_go_by(spark):
    df = pages(
        spark,
        ("https://a.com/1", '<meta property="article:published_time" content="soon"/><article>x</article>'),
        ("https://a.com/2", None),
        ("https://a.com/3", "bad \x01 mark"),
        ("https://a.com/2020/04/x", "<p>no content"),
    )
    losses = extract.Losses()
    made = extract.extract_articles(df, CFG, losses=losses)
    assert len(made.collect()) == 2
    assert losses.counts() == {
        "pages": 4, "missing": 1, "unreadable": 1, "articles": 2, "unknown_dates": 1, "dates_from_url": 1, "empty": 1
    }
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


@pytest.mark.parametrize(
    "html, title",
    [
        ('<b class="entry-title">x</b><title>Whole</title>', "Whole"),
        ('<b class="entry-title"> </b><h1 class="wp-block-post-title">Second</h1>', "Second"),
        ('<h2 class="entry-title"><a href="q">Linked</a></h2>', "Linked"),
        ('<meta property="og:title" content="A &amp; B">', "A & B"),
        ('<div class="entry"><section><h1>Deep</h1></section></div>', "Deep"),
        ("<title> T &#8211; x </title>", "T – x"),
        ("<p>none</p>", None),
    ],
)
def test_title_patterns_in_order(spark, html, title):
    assert one(spark, html, "https://a.com/x").title == title


def test_profile_titles(spark):
    html = '<h1 class="entry-title">First</h1><title>Page | Site</title>'
    assert one(spark, html, "https://nrdblog.cmosnet.eu/1").title == "Page | Site"
    assert one(spark, html, "https://zeissikonveb.de/1").title == "First"
    bar = "<title>Page | Site</title>"
    assert one(spark, bar, "https://zeissikonveb.de/1").title == "Page "
    nested = '<h1 class="entry-title"><em>Inner</em></h1>'
    assert one(spark, nested, "https://a.wordpress.com/1").title == "Inner"
    assert one(spark, nested, "https://a.com/1").title is None


def test_date_stands_in_for_a_missing_title(spark):
    html = '<meta property="article:published_time" content="2024-10-21T14:34:23+02:00"/><p>x'
    assert one(spark, html).title == "Monday, 21 October 2024, 12:34"
    assert one(spark, html, "https://a.com/1").title is None


def test_title_equal_to_the_blog_title_becomes_the_date(spark):
    df = pages(spark, ("https://x.blogspot.com/2012/03/a.html", "<title>My Blog</title><p>x"))
    blogs = spark.createDataFrame([("https://x.blogspot.com", "My Blog", "en")], "blog string, title string, language string")
    row = extract.extract_articles(df, CFG, blogs).first()
    assert row.title == "Thursday, 01 March 2012, 00:00"


def test_regex_dates_of_one_profile(spark):
    html = "<div id='Section1'>text letzte Änderung: 7. März 2019</div>"
    row = one(spark, html, "https://zeissikonveb.de/x")
    # An umlaut is not among the letters the pattern takes, so the short URL decides.
    assert row.date == datetime(2024, 1, 31)
    html = "<div id='Section1'>text letzte Änderung: 7. Mai 2019</div>"
    row = one(spark, html, "https://zeissikonveb.de/x")
    assert row.date == datetime(2019, 5, 7)
    assert row.language == "de"
    assert row.content.startswith("<p>text letzte")


def test_content_takes_the_first_pattern_that_is_not_blank(spark):
    html = (
        '<div itemprop="articleBody"> <div class="post-footer">gone</div></div>'
        "<article><p>kept</p></article>"
    )
    # The first element leaves only an opening paragraph, which is content.
    assert one(spark, html, "https://a.com/1").content == "<p>"
    html = '<section itemprop="text"> <!-- only --> </section><article>kept</article>'
    assert one(spark, html, "https://a.com/1").content == "kept"


def test_ranges_count_characters_not_bytes(spark):
    html = "<p>żółw \U0001f600</p><article>x \U0001f600 <em>é</em><!-- ą --> y</article>"
    assert one(spark, html, "https://a.com/1").content == "x \U0001f600 é y"


def test_extra_content_patterns(spark):
    body = '<div class="type-post">wp</div><div class="post-body">bs</div>'
    assert one(spark, body, "https://a.wordpress.com/1").content == "<p>wp"
    assert one(spark, body, "https://a.blogspot.com/1").content == "<p>bs"
    assert one(spark, body, "https://a.com/1").content == ""


def test_images_of_overlapping_patterns_repeat(spark):
    html = (
        '<article><a href="x"><img src="1.jpg"></a><img alt="no source">'
        '<img src="2.svg"><img src="https://zblogowani.pl/b.png"></article>'
    )
    fields = extract.extract_fields(pages(spark, ("https://a.com/x", html)), CFG).first()
    assert [r.src for r in fields.image_refs] == [
        "1.jpg", "2.svg", "https://zblogowani.pl/b.png", "1.jpg",
    ]
    assert [i.url for i in fields.images] == ["https://a.com/1.jpg"] * 2
    assert fields.content.count("<table") == 1
    assert '<img src="2.svg">' in fields.content


def test_block_comments(spark):
    html = (
        '<div id="comments"><h4>2 comments</h4><div class="comment-block"><p>Ann</p> <p>first</p>'
        '<p>more</p><span>Odpowiedz</span><a>Usuń</a></div>'
        '<div class="comment-block"><p>Bob &amp; co</p><p>second</p></div></div>'
    )
    assert one(spark, html).comments == (
        "<hr/><h3>2 comments</h3><h4>Ann</h4><p>first</p><p>more</p>"
        "<h4>Bob & co</h4><p>second</p>"
    )


def test_listed_comments(spark):
    html = (
        "<div id='comments'><h4>3</h4></div><dl id='comments-block'>"
        "<dt class='comment-author'>Ann\nB</dt><dd class='comment-body'><p>one</p> two</dd>"
        "<dt class='comment-author'>Cy</dt></dl>"
    )
    assert one(spark, html).comments == "<hr/><h3>3</h3><h4>Ann B</h4><p>one two</p>"
    assert one(spark, "<div id='comments'><h4>0</h4></div>").comments == ""


def test_blog_metadata_prefers_the_root_page(spark):
    df = pages(
        spark,
        ("https://a.com/1", "<title>One</title>"),
        ("https://a.com/", POST),
        ("https://b.com/1", "<p>untitled"),
        ("https://b.com/2", '<html lang="fr"><title>Two</title>'),
    )
    got = {r.blog: r for r in extract.blog_metadata(df).collect()}
    assert got["https://a.com"].title == "My & Blog"
    assert got["https://a.com"].description == "About"
    assert got["https://a.com"].header_images == ["/h.png"]
    assert (got["https://b.com"].title, got["https://b.com"].language) == ("Two", "fr")


def test_python_runs_once_per_page(spark):
    df = extract.extract_articles(pages(spark, ("https://a.com/1", POST)), CFG)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize(
    "html, language",
    [
        ("{'lang': 'pl', lang='x'}", "pl"),
        ("<html lang='de'>", "de"),
        ("<html lang='pt-BR'>", "en"),
        ('"locale": "fr"', "fr"),
        ("", "en"),
    ],
)
def test_detect_language(spark, html, language):
    assert spark.range(1).select(text.detect_language(F.lit(html))).first()[0] == language


def test_fix_html_tags(spark):
    given = "<meta content=0;url=x><img src=a.png><a href=b>c</a><br><link href=q.css>"
    got = spark.range(1).select(text.fix_html_tags(F.lit(given))).first()[0]
    assert got == (
        '<meta content=0;url="x" /><img src="a.png" /><a href="b">c</a><br/>'
        '<link href="q.css" />'
    )


def test_clever_decode(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary")
    assert [r[0] for r in df.select(text.clever_decode(F.col("b"))).collect()] == ["é", "é"]
