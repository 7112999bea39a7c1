"""The page store, published tables and their layout."""

import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pageloom import sinks, tables
from pageloom.config import JobConfig
from pageloom.operators import extract, inventory
from pageloom.plans import run
from pageloom.session import staged
from pageloom.sources import store as page_store

ROWS = [
    (5, "u1", "<title>old</title>x"),
    (9, "u1", "<title>new</title>x"),
    (-4, "u2", "<title>negative</title>"),
    (3, "u2", "later"),
    (7, "u3", None),
    (7, "u4", "same id, other page"),
    (None, "u5", "no id"),
    (1, None, "no url"),
    (8, "u6", "bad \x01 mark"),
    (8, "u6", "bad \x01 mark"),
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_body_scan(plan):
    """Operators between the root of a plan and the scan that reads ``html``."""
    lines = plan.split("\n")
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and "html" in line.split("Batched")[0])
    depth = lambda line: len(re.match(r"[ :+\-]*", line)[0])
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if re.match(r"[ :]*[+:]- |\S", line) and depth(line) < level:
            out.append(line.strip(" :+-"))
            level = depth(line)
    return out


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("extra", F.lit(1))
    return page_store.write_store(df, str(tmp_path_factory.mktemp("store") / "s"), 4)


def key(spark, *urls):
    rows = [(f"b{k % 2}", k, u) for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "blog string, seq long, url string").withColumn("url_md5", F.md5("url"))


def test_one_row_a_page(store):
    got = {r.url: (r.page_id, r.html, r.readable, r.titled) for r in store.collect()}
    assert got == {
        "u1": (5, "<title>old</title>x", True, True),
        "u2": (-4, "<title>negative</title>", True, True),
        "u3": (7, None, False, False),
        "u4": (7, "same id, other page", True, False),
        "u5": (None, "no id", True, False),
        None: (1, "no url", True, False),
        "u6": (8, "bad \x01 mark", False, False),
    }


def test_lookup_keeps_missing_null_and_repeated_pages(spark, store):
    wanted = key(spark, "u2", "gone", "u3", "u1", "u1", None)
    got = {r.seq: (r.url, r.page_id, r.html) for r in inventory.lookup_pages(wanted, store).collect()}
    old = ("u1", 5, "<title>old</title>x")
    assert got == {
        0: ("u2", -4, "<title>negative</title>"),
        1: ("gone", None, None),
        2: ("u3", 7, None),
        3: old,
        4: old,
        5: (None, None, None),
    }
    assert [r.seq for r in inventory.frontier(wanted, store).orderBy("seq").collect()] == [1, 5]


def test_pages_asked_for_very_often_are_spread(spark, store, monkeypatch):
    monkeypatch.setattr(page_store, "HOT_ROWS", 10)
    wanted = key(spark, *["u1"] * 45, *["gone"] * 30, "u2", "none", None)
    for how, n in (("left", 78), ("inner", 46)):
        got = page_store.fetch_bodies(wanted, store, how).collect()
        assert len(got) == n and len({r.seq for r in got}) == n
        assert {r.html for r in got if r.url == "u1"} == {"<title>old</title>x"}
    spread = page_store.fetch_bodies(wanted, store, "left")
    assert "salt" in plan_of(spread)


def test_bodies_are_neither_shuffled_nor_sorted(spark, store, tmp_path):
    wanted = staged(key(spark, "u1", "u2", "gone"), "wanted")
    moved = re.compile("Exchange|Sort")
    looked_up = plan_of(inventory.lookup_pages(wanted, store))
    assert not any(moved.match(op) for op in above_body_scan(looked_up)), looked_up
    assert any(op.startswith("ShuffledHashJoin") for op in above_body_scan(looked_up))
    plan = staged(run.chapter_plan(wanted, store, JobConfig(skip="")), "plan")
    made = plan_of(run.chapter_rows(plan, store, JobConfig()))
    assert not any(moved.match(op) for op in above_body_scan(made)), made
    meta = plan_of(extract.store_metadata(store.withColumn("blog", F.lit("b"))))
    assert not any(moved.match(op) for op in above_body_scan(meta)), meta


def test_choosing_pages_reads_no_body(spark, store):
    readable = store.filter("readable").select("url_md5", "page_id")
    assert "html" not in plan_of(readable)


def test_store_metadata_equals_the_plain_one(spark, tmp_path):
    rows = [
        (3, "https://a.com/", "<title>Root</title>"),
        (1, "https://a.com/x", "<title>First</title>"),
        (2, "https://b.com/x", "<p>none"),
        (5, "https://b.com/y", '<html lang="fr"><p>none'),
        (4, "https://c.com/y", None),
        (-1, "https://d.com/y", "<title>D</title>"),
        (0, "https://d.com/z", "<title>E</title>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    columns = page_store.store_columns(df)
    store = page_store.write_store(df, f"{tmp_path}/s", 3)
    order = lambda d: sorted(map(str, d.collect()))
    plain = extract.blog_metadata(columns.withColumnRenamed("page_id", "seq"))
    assert order(extract.store_metadata(store)) == order(plain)
    assert {r.blog: r.title for r in plain.collect()} == {
        "https://a.com": "Root", "https://b.com": "", "https://c.com": "", "https://d.com": "D"
    }


def test_store_is_opened_by_its_pointer(spark, tmp_path):
    path = f"{tmp_path}/s"
    with pytest.raises(ValueError, match="no page store"):
        page_store.open_store(spark, path)
    df = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    page_store.write_store(df, path, 4)
    _, facts = tables.published(spark, path)
    name = page_store._name(path, facts["folder"])
    spark.sql(f"DROP TABLE {name}")  # another session doesn't know it
    again = page_store.open_store(spark, path)
    assert again.count() == 2
    wanted = staged(key(spark, "u1"), "wanted")
    assert "Bucketed: true" in plan_of(inventory.lookup_pages(wanted, again))
    # A new version is another table; the pointer decides.
    page_store.write_store(df.limit(1), path, 2)
    assert page_store.open_store(spark, path).count() == 1


def articles(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.concat(F.lit("b"), F.col("id") % 7).alias("blog"), F.col("id").alias("seq"), F.repeat(F.lit("x"), 50).alias("t")
    )


def test_a_blog_is_read_whatever_the_bucket_count(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.write_table(articles(spark, 70), path, buckets=5)
    assert sorted(r.seq for r in sinks.read_blog(spark, path, "b3").collect()) == list(range(3, 70, 7))
    sinks.write_table(articles(spark, 70, 70), path, buckets=9, mode="append")
    assert sorted(r.seq for r in sinks.read_blog(spark, path, "b3").collect()) == list(range(3, 140, 7))
    assert sinks.read_table(spark, path).count() == 140
    sinks.write_table(articles(spark, 7), path, buckets=2)
    assert sinks.read_table(spark, path).count() == 7
    with pytest.raises(ValueError, match="no published table"):
        sinks.read_blog(spark, f"{tmp_path}/none", "b")


def test_row_groups_of_a_file_are_in_order_of_blogs(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.conf.set("parquet.block.size", str(1 << 14))
    try:
        sinks.write_articles(articles(spark, 20_000).withColumn("t", F.sha2(F.col("seq").cast("string"), 512)), path, buckets=2)
    finally:
        spark.conf.unset("parquet.block.size")
    groups = 0
    for folder, _, files in os.walk(path):
        for name in files:
            if name.endswith(".parquet") and "pointer" not in folder:
                meta = pq.ParquetFile(f"{folder}/{name}").metadata
                column = next(k for k in range(meta.num_columns) if meta.schema.column(k).name == "blog")
                spans = [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups)]
                groups += len(spans)
                assert all(a.max <= b.min for a, b in zip(spans, spans[1:]))
    assert groups >= 2


def test_a_write_that_fails_is_not_seen(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.write_table(articles(spark, 7), path)
    broken = articles(spark, 7).withColumn("t", F.raise_error(F.lit("half way")).cast("string"))
    with pytest.raises(Exception, match="half way"):
        sinks.write_table(broken, path)
    assert sinks.read_table(spark, path).count() == 7
    sinks.write_table(articles(spark, 14), path)
    assert sinks.read_table(spark, path).count() == 14


def test_chapter_text_lies_in_order(spark, tmp_path):
    chapters = spark.range(50).select(
        F.lit("b").alias("blog"),
        (49 - F.col("id")).alias("number"),
        F.format_string("c%02d", 49 - F.col("id")).alias("href"),
        F.lit("<p>\n</p>").alias("xhtml"),
    )
    sinks.write_chapters_text(chapters.repartition(4), f"{tmp_path}/x", buckets=3)
    lines = [r.value.split("\t") for r in sinks.read_text(spark, f"{tmp_path}/x").collect()]
    assert lines == [["b", f"c{k:02d}", "<p> </p>"] for k in range(50)]


def test_pointer_survives_a_lost_slot(spark, tmp_path):
    path = f"{tmp_path}/p"
    assert tables.published(spark, path) == (0, {})
    for k in range(1, 6):
        assert tables.publish(spark, path, {"n": k}) == k
        assert tables.published(spark, path) == (k, {"n": k})
    assert sorted(os.listdir(f"{path}/pointer")) == ["slot-0", "slot-1"]
    # While version 6 replaces slot 0, that slot is empty for a moment.
    spark.createDataFrame([], "version long, facts string").write.mode("overwrite").parquet(f"{path}/pointer/slot-0")
    assert tables.published(spark, path) == (5, {"n": 5})
