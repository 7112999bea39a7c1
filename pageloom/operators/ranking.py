"""Exact row numbers per key without sorting a large key in one task.

A blog may hold a third of all pages, so ``row_number() over (partition by
blog)`` would put a third of the table into one task. Here large keys are cut
into ordered chunks; rows are numbered inside their chunk, and the chunk's
offset is a running sum over chunk sizes, which are few. Small keys are one
chunk each. All steps are deterministic functions of the data, so a lost
executor changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Positions sharing a chunk: 2 ** 16 in a row.
CHUNK_BITS = 16

# Keys with more rows than this are cut into chunks. A table of n rows has at
# most n / LARGE_KEY such keys: ten thousand in ten billion rows.
LARGE_KEY = 1 << 20


def chunk_of(seq: Column) -> Column:
    """Chunk number of an integer position."""
    return F.shiftright(seq, CHUNK_BITS)


def large_keys(df: DataFrame, keys: Sequence[str], large: int | None = None) -> DataFrame:
    """Keys to cut into chunks; few by arithmetic, so they may be broadcast."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return sizes.filter(F.col("__rows") > (LARGE_KEY if large is None else large)).select(*keys, F.lit(True).alias("__large"))


def _fixed(kind: T.DataType) -> Column:
    """Some value of a level's type, the same for all rows of a small key."""
    if isinstance(kind, T.StructType):
        return F.struct(*(_fixed(f.dataType).alias(f.name) for f in kind))
    zero = {"timestamp": F.timestamp_seconds(F.lit(0)), "string": F.lit("")}
    return zero.get(kind.simpleString(), F.lit(0)).cast(kind)


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    levels: Sequence[Column],
    out: str = "number",
    total: str | None = None,
    large: int | None = None,
) -> DataFrame:
    """Add ``out`` = 1..n per ``keys`` in ``order``, and n itself as ``total``.

    Keys of more than ``large`` rows (``LARGE_KEY``) are cut into chunks.
    ``levels`` are columns, coarse to fine, whose ascending order agrees with
    ``order``; rows of a large key equal in all levels form one chunk. Rows with
    a null key are a group like any other; levels are never null. ``df`` is read three times (large keys, chunk sizes,
    numbering), the first two combined before their shuffle: stage it first
    when it is costly to compute.
    """
    names = [f"__level_{i}" for i in range(len(levels))]
    # As one struct the keys compare null to null, in windows and joins alike.
    df = df.withColumn("__key", F.struct(*keys))
    keys = ["__key"]
    cut = large_keys(df.select(*keys), keys, large)
    leveled = df.withColumns(dict(zip(names, levels)))
    chunked = leveled.join(F.broadcast(cut), keys, "left").withColumns(
        {
            name: F.when(F.col("__large"), F.col(name)).otherwise(
                _fixed(leveled.schema[name].dataType)
            )
            for name in names
        }
    ).drop("__large")
    local = Window.partitionBy(*keys, *names).orderBy(*order)
    ranked = chunked.withColumn("__local", F.row_number().over(local).cast("bigint"))
    sizes = chunked.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = None
    parts = []
    for depth in range(len(names), 0, -1):
        above, here = names[: depth - 1], names[depth - 1]
        before = (
            Window.partitionBy(*keys, *above)
            .orderBy(here)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        part = f"__before_{depth}"
        parts.append(part)
        level = sizes
        if depth < len(names):
            level = sizes.groupBy(*keys, *above, here).agg(F.sum("__rows").alias("__rows"))
        extra = []
        if total is not None and depth == 1:
            extra = [F.sum("__rows").over(Window.partitionBy(*keys)).alias(total)]
        level = level.select(
            *keys,
            *above,
            here,
            F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias(part),
            *extra,
        )
        offsets = level if offsets is None else offsets.join(level, [*keys, *above, here])
    number = reduce(lambda a, b: a + b, (F.col(p) for p in parts), F.col("__local"))
    return (
        ranked.join(offsets, [*keys, *names])
        .withColumn(out, number.cast("bigint"))
        .drop("__key", "__local", *names, *parts)
    )


def rank_by_seq(
    df: DataFrame,
    key: str = "blog",
    seq: str = "seq",
    out: str = "number",
    total: str | None = None,
) -> DataFrame:
    """1..n per key in the order of an integer position."""
    return rank_within(df, [key], [F.col(seq)], [chunk_of(F.col(seq))], out, total)


def nth_position(df: DataFrame, n: Column, key: str = "blog", seq: str = "seq") -> DataFrame:
    """``(key, cut)``: position of the n-th row of every key that has one.

    Only the key and the position are shuffled; wide rows are then filtered
    against one row per key instead of being ranked themselves.
    """
    ranked = rank_by_seq(df, key, seq, "__n")
    return ranked.filter(F.col("__n") == n).select(key, F.col(seq).alias("cut"))


def top_k(df: DataFrame, keys: Sequence[str], order: Column, salt: Column, k: int, out: str) -> DataFrame:
    """First ``k`` rows per key; each salt bucket is cut to ``k`` rows first."""
    keys = list(keys)
    salted = df.withColumn("__salt", salt)
    within = Window.partitionBy(*keys, "__salt").orderBy(order)
    first = salted.withColumn("__r", F.row_number().over(within)).filter(F.col("__r") <= k)
    overall = Window.partitionBy(*keys).orderBy(order)
    return (
        first.drop("__r", "__salt")
        .withColumn(out, F.row_number().over(overall))
        .filter(F.col(out) <= k)
    )
