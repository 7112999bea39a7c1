"""Chunked ranks against Spark's own row_number, with one very large key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.operators import books, inventory, ranking


@pytest.fixture()
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(6000):
        blog = "hot" if rng.random() < 0.5 else f"b{rng.randrange(40)}"
        date = None
        if rng.random() < 0.8:
            date = datetime(2020, 1, 1) + timedelta(minutes=rng.randrange(3000), seconds=rng.randrange(3))
        data.append((blog, i * rng.choice([1, 1, 1]), date))
    return spark.createDataFrame(data, "blog string, seq long, date timestamp").cache()


@pytest.fixture()
def small_chunks(monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK_BITS", 6)
    monkeypatch.setattr(ranking, "LARGE_KEY", 100)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rank_by_seq(rows, small_chunks):
    got = ranking.rank_by_seq(rows.select("blog", "seq"))
    window = Window.partitionBy("blog").orderBy("seq")
    same(got, rows.select("blog", "seq", F.row_number().over(window).cast("bigint")))


@pytest.mark.parametrize("by", ["date", "sitemap"])
def test_order_chapters(rows, small_chunks, by):
    got = books.order_chapters(rows, by=by).select("blog", "seq", "number")
    order = [F.col("seq").desc()]
    if by == "date":
        order = [F.col("date").asc_nulls_last(), *order]
    window = Window.partitionBy("blog").orderBy(*order)
    same(got, rows.select("blog", "seq", F.row_number().over(window).cast("bigint")))


@pytest.mark.parametrize("limit, want", [("5", 5), ("0", 1), ("", None), ("None", None)])
def test_limit(rows, small_chunks, limit, want):
    got = books.limit_articles(rows, F.lit(limit)).select("blog", "seq")
    window = Window.partitionBy("blog").orderBy("seq")
    ranked = rows.withColumn("n", F.row_number().over(window))
    same(got, (ranked if want is None else ranked.filter(F.col("n") <= want)).select("blog", "seq"))


@pytest.mark.parametrize("skip, want", [("3", 3), ("0", 0), ("-1", 0), ("x", 0), ("100000", 100000)])
def test_skip(rows, small_chunks, skip, want):
    got = inventory.skip_pages(rows.select("blog", "seq"), F.lit(skip))
    window = Window.partitionBy("blog").orderBy("seq")
    ranked = rows.withColumn("n", F.row_number().over(window))
    same(got, ranked.filter(F.col("n") > want).select("blog", "seq"))


def test_rank_without_large_keys(rows):
    got = ranking.rank_by_seq(rows.select("blog", "seq"))
    window = Window.partitionBy("blog").orderBy("seq")
    same(got, rows.select("blog", "seq", F.row_number().over(window).cast("bigint")))


def test_large_key_is_spread(rows, small_chunks):
    assert "hot" in {r.blog for r in ranking.large_keys(rows, ["blog"]).collect()}
    ranked = ranking.rank_by_seq(rows.select("blog", "seq"))
    spread = ranked.withColumn("p", F.spark_partition_id()).filter("blog = 'hot'")
    assert spread.select("p").distinct().count() > 1


def test_toc_is_a_permutation(rows, small_chunks):
    chapters = books.toc_spine(books.number_chapters(rows.select("blog", "seq")))
    for blog in chapters.select("blog").distinct().collect():
        of_blog = chapters.filter(F.col("blog") == blog.blog).collect()
        n = len(of_blog)
        assert sorted(r.number for r in of_blog) == list(range(1, n + 1))
        assert sorted(r.toc_pos for r in of_blog) == list(range(1, n + 1))
        assert all(r.spine_pos == n - r.number + 3 for r in of_blog)


def test_names_are_unique(spark):
    df = spark.createDataFrame(
        [(f"blog{i}", "same.epub" if i % 3 else "other_[4].epub") for i in range(50)],
        "blog string, file_name string",
    )
    names = [r.file_name for r in books.dedupe_names(df).collect()]
    assert len(set(names)) == 50
    assert "same.epub" in names and "same_[1].epub" in names
    others = {n for n in names if n.startswith("other")}
    assert others == {f"other_[{i}].epub" for i in range(1, 18)}


def test_crawl_span(spark):
    day = datetime(2020, 1, 1)
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 2, day), ("a", 3, None), ("b", 1, day), ("c", 1, None), ("d", 1, day), ("d", 2, day - timedelta(1))],
        "blog string, seq long, date timestamp",
    )
    got = {r.blog: (r.start, r.end) for r in books.crawl_span(df).collect()}
    assert got == {"a": (day, None), "b": (day, None), "c": (None, None), "d": (day, day - timedelta(1))}


@pytest.mark.parametrize("large", [1 << 20, 1])
def test_null_keys_are_a_group(spark, monkeypatch, large):
    monkeypatch.setattr(ranking, "LARGE_KEY", large)
    df = spark.createDataFrame([(None, 5), (None, 2), ("a", 1), ("a", 9)], "blog string, seq long")
    got = {(r.blog, r.seq, r.number, r.n) for r in ranking.rank_by_seq(df, total="n").collect()}
    assert got == {(None, 2, 1, 2), (None, 5, 2, 2), ("a", 1, 1, 2), ("a", 9, 2, 2)}
