"""Streams over several files give what one batch over all of them gives."""

import os

import pytest
from pyspark.sql import functions as F

from pageloom.config import JobConfig
from pageloom.operators import comments, extract
from pageloom.sources.pages import blog_pages
from pageloom.streaming import incremental, keyed, seen


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pages")
    rows = [
        (
            i,
            f"https://{'hot' if i % 3 else f'b{i % 4}'}.com/2012/01/p{i}.html",
            None if i % 10 == 9 else f'<title>T{i}</title><article>x{i}</article><a rel="tag">t{i % 2}</a>',
        )
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in range(3):
        df.filter(F.expr(f"page_id div 20 = {part}")).coalesce(1).write.mode("append").parquet(str(path))
    return str(path), df


def dirs(tmp_path):
    return f"{tmp_path}/out", f"{tmp_path}/checkpoint"


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_articles_equal_the_batch(spark, folder, tmp_path):
    path, df = folder
    out, checkpoint = dirs(tmp_path)
    stream = incremental.stream_pages(spark, path, max_files=1)
    incremental.run_append(incremental.stream_articles(stream, JobConfig()), out, checkpoint)
    batch = extract.extract_articles(blog_pages(df), JobConfig())
    names = ("blog", "seq", "url", "title", "date", "content")
    assert rows_of(spark.read.parquet(out), *names) == rows_of(batch, *names)


def test_each_page_passes_once(spark, folder, tmp_path):
    path, df = folder
    out, checkpoint = dirs(tmp_path)
    stream = incremental.stream_pages(spark, path, max_files=1)
    twice = stream.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    incremental.run_append(incremental.stream_dedupe(twice).select("url_md5"), out, checkpoint)
    once = rows_of(df.select(F.md5("url").alias("url_md5")), "url_md5")
    assert rows_of(spark.read.parquet(out), "url_md5") == once
    out, checkpoint = dirs(tmp_path / "exact")
    incremental.run_dedupe(twice, out, checkpoint)
    assert rows_of(seen.published_rows(spark, out), "url_md5") == once


def test_limit_holds_over_batches(spark, folder, tmp_path):
    path, df = folder
    out, checkpoint = dirs(tmp_path)
    stream = incremental.stream_pages(spark, path, max_files=1)
    incremental.run_limit(stream, "7", out, checkpoint, JobConfig())
    kept = incremental.read_limit(spark, out)
    articles = incremental.read_limit(spark, out, "articles")
    assert rows_of(articles, "blog", "seq") == rows_of(kept, "blog", "seq")
    assert kept.select("batch").distinct().count() > 1
    counts = {r.blog: r["count"] for r in kept.groupBy("blog").count().collect()}
    readable = {
        r.blog: r["count"]
        for r in extract.drop_unparsed(blog_pages(df)).groupBy("blog").count().collect()
    }
    assert counts == {blog: min(7, n) for blog, n in readable.items()}
    # A second run finds nothing new.
    incremental.run_limit(incremental.stream_pages(spark, path, max_files=1), "7", out, checkpoint)
    assert incremental.read_limit(spark, out).count() == sum(counts.values())
    state = keyed.read_latest(spark, f"{out}/state", ["blog"])
    assert {r.blog: r.n for r in state.collect()} == counts


def test_tag_counts_and_spans(spark, folder, tmp_path):
    path, df = folder
    batch = extract.extract_articles(blog_pages(df), JobConfig())
    stream = incremental.stream_articles(
        incremental.stream_pages(spark, path, max_files=1), JobConfig()
    )
    out, checkpoint = dirs(tmp_path / "tags")
    incremental.run_latest(incremental.stream_tag_counts(stream), out, checkpoint, ["blog", "tag"])
    got = keyed.read_latest(spark, out, ["blog", "tag"])
    assert rows_of(got, "blog", "tag", "n") == rows_of(comments.tag_counts(batch), "blog", "tag", "n")
    out, checkpoint = dirs(tmp_path / "span")
    incremental.run_latest(incremental.stream_span(stream), out, checkpoint, ["blog"])
    spans = incremental.stream_span(batch)
    names = ("blog", "n_articles", "start", "end")
    assert rows_of(keyed.read_latest(spark, out, ["blog"]), *names) == rows_of(spans, *names)


def opened(df):
    return len(df.inputFiles())


def test_thirty_batches_of_changes_of_which_one_fails(spark, tmp_path, monkeypatch):
    path, want, files = f"{tmp_path}/t", {}, []
    publish = keyed.tables.publish
    for batch in range(30):
        rows = [(f"k{k}" if k else None, batch * 100 + k) for k in range(batch % 7, 40 + batch, 3)]
        df = spark.createDataFrame(rows, "key string, n long").coalesce(2)
        if batch == 15:  # merges and dies before its pointer is written

            def broken(*args):
                raise RuntimeError("lost")

            monkeypatch.setattr(keyed.tables, "publish", broken)
            with pytest.raises(RuntimeError, match="lost"):
                keyed.write_changes(df, path, ["key"], batch, buckets=4, every=4)
            monkeypatch.setattr(keyed.tables, "publish", publish)
            assert {r.key: r.n for r in keyed.read_latest(spark, path, ["key"]).collect()} == want
        keyed.write_changes(df, path, ["key"], batch, buckets=4, every=4)
        keyed.write_changes(df.limit(0), path, ["key"], batch, buckets=4, every=4)  # repeated: nothing happens
        want.update(rows)
        files.append(opened(keyed.read_latest(spark, path, ["key"])))
        if batch % 5 == 4:
            got = keyed.read_latest(spark, path, ["key"]).collect()
            assert {r.key: r.n for r in got} == want and len(got) == len(want)
    assert max(files) <= 4 * 2 + 3 * 4
    assert keyed.last_batch(spark, path) == 29
    left = [name for name in os.listdir(path) if name.startswith(("base-", "changes-"))]
    assert len(left) <= 4 * 4


def test_state_of_thirty_batches_has_a_row_a_blog(spark, tmp_path):
    folder, (out, checkpoint) = f"{tmp_path}/in", dirs(tmp_path)
    rows = [
        (i, f"https://{'hot' if i % 2 else f'b{i % 5}'}.com/p{i}", f"<title>T{i}</title><article>x") for i in range(90)
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in range(30):
        df.filter(F.expr(f"page_id div 3 = {part}")).coalesce(1).write.mode("append").parquet(folder)
    incremental.run_limit(incremental.stream_pages(spark, folder, max_files=1), "20", out, checkpoint)
    assert keyed.last_batch(spark, f"{out}/state") == 29
    state = keyed.read_latest(spark, f"{out}/state", ["blog"])
    kept = incremental.read_limit(spark, out)
    counts = {r.blog: r["count"] for r in kept.groupBy("blog").count().collect()}
    assert counts["https://hot.com"] == 20 and len(counts) == 6
    assert {r.blog: r.n for r in state.collect()} == counts and state.count() == 6


def test_a_reader_never_sees_part_of_a_batch(spark, folder, tmp_path, monkeypatch):
    path, _ = folder
    out, checkpoint = dirs(tmp_path)
    with pytest.raises(ValueError, match="no published batch"):
        incremental.read_limit(spark, out)
    write, seen_rows = keyed.write_changes, []

    def watched(changes, place, keys, batch, **more):
        # Rows and articles of this batch are written, but not published yet.
        if batch:
            seen_rows.append(incremental.read_limit(spark, out, "articles").agg(F.max("batch")).first()[0])
        if batch == 2 and len(seen_rows) == 2:
            raise RuntimeError("lost")
        write(changes, place, keys, batch, **more)

    monkeypatch.setattr(keyed, "write_changes", watched)
    stream = incremental.stream_pages(spark, path, max_files=1)
    with pytest.raises(Exception, match="lost"):
        incremental.run_limit(stream, "7", out, checkpoint, JobConfig())
    assert seen_rows == [0, 1]
    assert incremental.read_limit(spark, out).agg(F.max("batch")).first()[0] == 1
    incremental.run_limit(incremental.stream_pages(spark, path, max_files=1), "7", out, checkpoint, JobConfig())
    rows, articles = incremental.read_limit(spark, out), incremental.read_limit(spark, out, "articles")
    assert rows_of(rows, "blog", "seq") == rows_of(articles, "blog", "seq")
    assert max(r["count"] for r in rows.groupBy("blog").count().collect()) == 7


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_exact_first_arrivals_over_batches(spark, tmp_path, bits):
    """A filter of 64 bits a part fills at once; the result stays exact."""
    out, known = f"{tmp_path}/o", set()
    for batch in range(4):
        names = [f"u{k}" for k in range(batch * 150, batch * 150 + 400)] * 2 + [None]
        df = spark.createDataFrame([(u, k) for k, u in enumerate(names)], "url string, n long")
        df = df.withColumn("url_md5", F.md5("url"))
        seen.add_batch(df, out, batch, bits)
        seen.add_batch(df.limit(1), out, batch, bits)  # repeated: nothing happens
        known |= {u for u in names if u}
        got = [r.url for r in seen.published_rows(spark, out).collect()]
        assert sorted(got) == sorted(known)
    fresh = spark.range(100).select(F.md5(F.concat(F.lit("new"), "id")).alias("url_md5"))
    filters = keyed.read_latest(spark, f"{out}/filter", ["part"])
    assert filters.count() <= 256
    if bits > 64:
        assert seen.perhaps_seen(fresh, filters, bits).count() < 5
    old = seen.published_rows(spark, out).select("url_md5")
    assert seen.perhaps_seen(old, filters, bits).count() == len(known)
