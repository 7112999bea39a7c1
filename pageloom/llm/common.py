"""Helpers shared by the operators: tables, whole runs of keys, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import prepare_session, staged

__all__ = [
    "cells",
    "components",
    "distinct_roots",
    "over_runs",
    "prepared",
    "read_table",
    "run_starts",
    "spread_columns",
    "staged",
    "text_bytes",
]


def prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``fn`` called with a prepared session."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare_session(spark), sf_dir)

    call.__doc__ = fn.__doc__
    call.__name__ = fn.__name__
    return call


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def run_starts(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Row numbers at which one of the key columns changes, the first row included."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def over_runs(
    batches: Iterable[pa.RecordBatch], keys: Sequence[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of equal keys, with the runs' starts.

    The rows come sorted by the integer columns ``keys``. Only the last,
    unfinished run is carried from batch to batch, so memory is bounded by one
    batch and the longest run.
    """
    carry: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        starts = run_starts([table[k].to_numpy() for k in keys])
        first = tuple(table[k][0].as_py() for k in keys)
        cut = int(starts[-1])
        if carry and (first != last):
            whole = pa.concat_tables(carry)
            yield whole, run_starts([whole[k].to_numpy() for k in keys])
            carry = []
        if cut:
            whole = pa.concat_tables([*carry, table.slice(0, cut)])
            yield whole, run_starts([whole[k].to_numpy() for k in keys])
            carry = []
        carry.append(table.slice(cut))
        last = tuple(table[k][table.num_rows - 1].as_py() for k in keys)
    if carry:
        whole = pa.concat_tables(carry)
        yield whole, run_starts([whole[k].to_numpy() for k in keys])


def spread_columns(hot: DataFrame, keys: Sequence[str], rows: str, limit: int) -> DataFrame:
    """Keys of more than ``limit`` rows with the number of chunks to cut them into."""
    return hot.filter(F.col(rows) > limit).select(
        *keys, F.ceil(F.col(rows) / F.lit(limit)).cast("int").alias("__chunks")
    )


def cells(df: DataFrame, keys: Sequence[str], spread: Column, counts: DataFrame, limit: int) -> DataFrame:
    """Rows dealt to cells so that every two rows of a key meet in one cell.

    A key of at most ``limit`` rows is one cell ``(key, 0, 0)``. A larger one is
    cut into chunks by the hash ``spread``; each pair of chunks ``i <= j`` is a
    cell of about ``2 * limit`` rows at most, which any task can take. ``__own``
    is a row's own chunk. ``counts`` holds ``(*keys, rows)``; keys above the
    limit are at most ``rows / limit``, so their list is broadcast.
    """
    hot = spread_columns(counts, keys, "rows", limit)
    chunked = df.join(F.broadcast(hot), list(keys), "left").withColumn(
        "__chunks", F.coalesce("__chunks", F.lit(1))
    )
    own = F.pmod(spread, F.col("__chunks")).cast("int")
    return (
        chunked.withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
        .withColumn("__ci", F.least("__own", "__other"))
        .withColumn("__cj", F.greatest("__own", "__other"))
        .drop("__chunks", "__other")
    )


def distinct_roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index linked to each of ``n`` items by the links ``a``-``b``."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``(node, root)`` of every linked node: the smallest node it reaches.

    ``links`` holds two columns ``a`` and ``b`` of one sortable type. Each round links all
    larger neighbours of a node to its smallest one, then all smaller
    neighbours likewise; the rounds grow with the logarithm of the longest
    path. A round's links are written to the shared folder, so nothing is
    computed twice and a lost executor costs a file read.
    """
    now = staged(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        name,
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("__b")).withColumn("__m", F.least("a", "__b"))
        large = (
            both.join(low.select("a", "__m"), "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("__m").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("__m"))
        small = (
            large.join(low, "a")
            .filter("b <> __m")
            .select(F.col("b").alias("a"), F.col("__m").alias("b"))
            .unionByName(low.select("a", F.col("__m").alias("b")))
            .distinct()
        )
        now = staged(small, name)
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
