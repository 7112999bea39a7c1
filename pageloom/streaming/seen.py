"""Exact first arrivals without an event time.

What has arrived is known from the published rows themselves; no stream state is
held. A Bloom filter, cut by the leading digits of the hash, stands before them:
a page it doesn't know is new for certain, and only the others are looked up in
the published hashes. The filter has a fixed size; when it fills, more pages are
looked up, and the result stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import staged
from pageloom.streaming import keyed

#: Leading hash digits that name a part of the filter, bits of a part, hash functions.
DIGITS = 2
BITS = 1 << 20
PROBES = 7

_PART = "part string, bits binary"


def places(hashes: list[str], bits: int) -> np.ndarray:
    """Bit numbers of each hash, a row a hash; any string has some."""
    raw = np.array([(int(h[:16], 16), int(h[16:], 16) | 1) for h in hashes], dtype=np.uint64).reshape(-1, 2)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((raw[:, :1] + steps * raw[:, 1:]) % np.uint64(bits)).astype(np.int64)


def _bits_of(table: pa.Table, bits: int) -> np.ndarray:
    """Unpacked bits of a part; none are set where it isn't stored yet."""
    if not table.num_rows:
        return np.zeros(bits, dtype=np.uint8)
    return np.unpackbits(np.frombuffer(table["bits"][0].as_py(), dtype=np.uint8))


def _per_part(rows: DataFrame, filters: DataFrame, fn, schema: str) -> DataFrame:
    part = rows.withColumn("part", F.substring("url_md5", 1, DIGITS))
    return part.groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(fn, schema)


def perhaps_seen(hashes: DataFrame, filters: DataFrame, bits: int = BITS) -> DataFrame:
    """``url_md5`` of ``hashes`` that the filter ``(part, bits)`` may know."""

    def look(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows or not known.num_rows:
            return pa.table({"url_md5": pa.array([], pa.string())})
        hit = _bits_of(known, bits)[places(rows["url_md5"].to_pylist(), bits)].all(axis=1)
        return rows.filter(pa.array(hit)).select(["url_md5"])

    return _per_part(hashes, filters, look, "url_md5 string")


def with_hashes(hashes: DataFrame, filters: DataFrame, bits: int = BITS) -> DataFrame:
    """Parts of the filter that change when ``hashes`` are added."""

    def add(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"part": pa.array([], pa.string()), "bits": pa.array([], pa.binary())})
        now = _bits_of(known, bits)
        now[places(rows["url_md5"].to_pylist(), bits).ravel()] = 1
        return pa.table({"part": rows["part"].slice(0, 1), "bits": pa.array([np.packbits(now).tobytes()], pa.binary())})

    return _per_part(hashes, filters, add, _PART)


def published_rows(spark: SparkSession, out: str) -> DataFrame:
    """All first arrivals of published batches."""
    last = keyed.last_batch(spark, f"{out}/filter")
    if last < 0:
        raise ValueError(f"no published batch at {out}")
    return spark.read.parquet(f"{out}/rows").filter(F.col("batch") <= last).drop("batch")


def add_batch(batch: DataFrame, out: str, batch_id: int, bits: int = BITS) -> None:
    """Write the rows of a batch whose ``url_md5`` never arrived before, and publish them.

    Of rows that share a hash inside the batch one is kept, the smallest. Rows without
    a hash are no pages and are dropped. Rows lie below ``out/rows``, the filter, whose
    pointer publishes both, below ``out/filter``.
    """
    spark = batch.sparkSession
    if batch_id <= keyed.last_batch(spark, f"{out}/filter"):
        return
    rest = [c for c in batch.columns if c != "url_md5"]
    one = batch.filter("url_md5 is not null").groupBy("url_md5")
    arrived = one.agg(F.min(F.struct(*rest)).alias("__one")).select("url_md5", "__one.*") if rest else one.agg().select("url_md5")
    arrived = staged(arrived, "arrived")
    fresh = arrived
    try:
        filters = keyed.read_latest(spark, f"{out}/filter", ["part"])
    except ValueError:
        filters = spark.createDataFrame([], _PART)
    else:
        asked = staged(perhaps_seen(arrived.select("url_md5"), filters, bits), "perhaps-seen")
        known = published_rows(spark, out).select("url_md5").join(asked, "url_md5", "left_semi")
        fresh = arrived.join(known.distinct(), "url_md5", "left_anti")
    target = f"{out}/rows/batch={batch_id}"
    fresh.write.mode("overwrite").parquet(target)
    new = spark.read.schema(arrived.schema).parquet(target).select("url_md5")
    keyed.write_changes(with_hashes(new, filters, bits), f"{out}/filter", ["part"], batch_id)
