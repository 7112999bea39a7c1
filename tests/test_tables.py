"""Caches, seeds, sinks and the whole run."""

import gzip
import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from pageloom import sinks
from pageloom.config import JobConfig
from pageloom.functions.urls import blog_of
from pageloom.operators import books, comments, extract, history
from pageloom.plans import run
from pageloom.session import staged
from pageloom.sources import pages
from pageloom.sources.store import write_store


def test_html_cache(spark, tmp_path):
    bodies = {"https://a.com/1": "<p>one\ntwo</p>", "https://a.com/2": "<p>é</p>"}
    for i, (url, html) in enumerate(bodies.items()):
        name = hashlib.md5(url.encode()).hexdigest() + ".html"
        if i == 0:
            (tmp_path / f"{name}.gz").write_bytes(gzip.compress(html.encode()))
        else:
            (tmp_path / name).write_text(html, encoding="utf-8")
    got = {r.url_md5: r.html for r in pages.scan_html_cache(spark, str(tmp_path)).collect()}
    assert got == {hashlib.md5(u.encode()).hexdigest(): h for u, h in bodies.items()}


def test_html_cache_of_unknown_encoding(spark, tmp_path):
    (tmp_path / ("e" * 32 + ".html")).write_bytes(b"<p>\xe9</p>")
    got = pages.scan_html_cache_bytes(spark, str(tmp_path)).first()
    assert (got.url_md5, got.html) == ("e" * 32, "<p>é</p>")


def test_seeds_from_csv(spark, tmp_path):
    file = tmp_path / "seeds.csv"
    file.write_text("url,limit,skip\nexample.com,5,\nhttps://Example.com/x,5,\nhttp://b.org,,2\n")
    got = sorted((r.blog, r.port, r.limit, r.skip) for r in pages.scan_seeds(spark, str(file)).collect())
    assert got == [("http://b.org", 80, None, "2"), ("https://example.com", 443, "5", None)]


def stored(spark, n=40):
    rows = [
        (
            i,
            f"https://{'hot' if i % 2 else f'b{i % 6}'}.example.com/2012/0{1 + i % 9}/p{i}.html",
            f"<title>T{i}</title><article><p>body {i}</p></article>" if i % 7 else None,
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_sinks_round_trip(spark, tmp_path):
    articles = extract.extract_articles(pages.blog_pages(stored(spark)), JobConfig())
    sinks.write_articles(articles, f"{tmp_path}/articles")
    back = sinks.read_table(spark, f"{tmp_path}/articles")
    n = articles.count()
    assert back.count() == n
    one = sinks.read_blog(spark, f"{tmp_path}/articles", "https://hot.example.com")
    assert one.count() == back.filter("blog = 'https://hot.example.com'").count() > 0
    chapters = books.build_chapters(back, JobConfig())
    sinks.write_chapters_text(chapters, f"{tmp_path}/text")
    lines = [r.value for r in sinks.read_text(spark, f"{tmp_path}/text").collect()]
    assert len(lines) == n
    assert all(len(line.split("\t")) == 3 for line in lines)


def test_whole_run(spark, tmp_path):
    cfg = JobConfig(skip="1", limit="4")
    table = stored(spark, 60).withColumn("url_md5", F.md5("url"))
    inventory = table.select(
        blog_of(F.col("url")).alias("blog"), F.col("page_id").alias("entry"), "url", "url_md5"
    )
    from pageloom.operators.ranking import rank_by_seq

    numbered = rank_by_seq(inventory, "blog", "entry", "seq")
    metadata = inventory.select("blog").distinct().withColumns(
        {"title": F.lit("Meta"), "language": F.lit("pl")}
    )
    store = write_store(table, f"{tmp_path}/store", 8)
    plan = staged(run.chapter_plan(numbered, store, cfg, metadata), "plan")
    made = run.chapter_rows(plan, store, cfg)
    expected = []
    by_blog = {}
    for r in sorted(table.collect(), key=lambda r: r.page_id):
        by_blog.setdefault(r.url.split("/2012")[0], []).append(r)
    for blog, rows in by_blog.items():
        kept = [r for r in rows[1:] if r.html is not None][:4]
        expected += [
            (blog, i, f"T{r.page_id}", len(kept) - i + 1) for i, r in enumerate(kept, start=1)
        ]
    got = [(r.blog, r.number, r.title, r.toc_pos) for r in made.collect()]
    assert sorted(got) == sorted(expected)
    assert {r.language for r in made.select("language").distinct().collect()} == {"pl"}
    blogs = made.select("blog").distinct().withColumns(
        {"title": F.lit("Same"), "description": F.lit(""), "file_prefix": F.lit("same")}
    )
    names = [r.file_name for r in run.book_rows(made, blogs).collect()]
    assert len(names) == len(set(names)) == len(by_blog)


def test_selection_and_composed_books(spark):
    day = datetime(2020, 1, 1)
    articles = spark.createDataFrame(
        [("b", i, f"u{i}", f"T{i}", day, f"C{i}") for i in range(4)],
        "blog string, seq long, url string, title string, date timestamp, content string",
    )
    ticks = spark.createDataFrame([("b", 1, True), ("b", 2, False), ("b", 3, True)], "blog string, seq long, selected boolean")
    assert sorted(r.seq for r in books.select_articles(articles, ticks).collect()) == [1, 3]
    assert books.selected_count(ticks).first().n_selected == 2
    spec = spark.createDataFrame(
        [("x", 1, "u3", None), ("x", 2, "u0", "Own title"), ("x", 3, "gone", None)],
        "book string, position long, url string, chapter_title string",
    )
    got = books.compose_book(spec, articles).orderBy("position").collect()
    assert [(r.title, r.content) for r in got] == [("T3", "C3"), ("Own title", "C0"), (None, None)]


def test_history(spark):
    old = spark.createDataFrame([("a",), ("b",)], "url string")
    new = spark.createDataFrame([("b",), ("c",), ("c",), ("",)], "url string")
    assert sorted(r.url for r in history.append_history(old, new).collect()) == ["a", "b", "c"]
    cfg = spark.createDataFrame(
        [("x", "5", "10"), ("y", "5", ""), ("z", "", "7"), ("w", "0", "7")],
        "blog string, limit string, skip string",
    )
    got = {r.blog: r.next_skip for r in history.next_offset(cfg).collect()}
    assert got == {"x": 15, "y": 5, "z": 7, "w": 7}


def test_comment_rows_match_the_page_markup(spark):
    texts = ["", "Ann", "hi", "Odpowiedz", "Usuń", "Bob", "yo", "more", "Usuń", "Usuń", "Cy"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "page string, pos long, text string")
    rows = comments.comment_rows(df).orderBy("comment").collect()
    assert [(r.author, r.content) for r in rows] == [("Ann", "hi"), ("Bob", "yo\nmore"), ("Cy", "")]
