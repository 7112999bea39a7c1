"""The shared folder."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

from pageloom import session
from pageloom.operators import inventory
from pageloom.plans.queries import QUERIES
from pyspark.sql import functions as F


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder, set=lambda key, value: None)
    context = SimpleNamespace(master=master, getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        session.shared_folder(fake(master))
    assert session.shared_folder(fake(master, "s3://bucket/x")) == "s3://bucket/x"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_machine_gets_a_temporary_folder(master):
    assert session.shared_folder(fake(master))


def test_a_large_skip_skips_everything(spark):
    pages = spark.range(5).select(F.lit("b").alias("blog"), F.col("id").alias("seq"))
    assert inventory.skip_pages(pages, F.lit("3000000000")).count() == 0
    assert inventory.skip_pages(pages, F.lit("3")).count() == 2


def test_pages_go_to_python_in_small_batches(spark):
    rows = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("html"))

    @F.arrow_udf("bigint")
    def batch_bytes(pages: pa.Array) -> pa.Array:
        return pa.array([pages.nbytes] * len(pages), pa.int64())

    def largest():
        return rows.select(batch_bytes("html").alias("n")).agg(F.max("n")).head()[0]

    try:
        session.prepare_session(spark, pages=True)
        assert largest() < 9 << 20
        session.prepare_session(spark)
        assert largest() > 25 << 20
    finally:
        session.prepare_session(spark)


def test_batches_of_a_user_stay(spark):
    try:
        spark.conf.set(session.ARROW_BYTES, "12345678")
        session.prepare_session(spark)
        assert spark.conf.get(session.ARROW_BYTES) == "12345678"
    finally:
        spark.conf.unset(session.ARROW_BYTES)


def test_a_page_query_asks_for_small_batches(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame([(1, "title\nx", "en", "s", 7)], schema)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    try:
        found = QUERIES["e1_title_of_posts"](spark, str(tmp_path))
        assert spark.conf.get(session.ARROW_BYTES) == session.PAGE_BATCH
        assert found.collect() == [(1, "title")]
    finally:
        session.prepare_session(spark)
    assert spark.conf.get(session.ARROW_BYTES) != session.PAGE_BATCH
