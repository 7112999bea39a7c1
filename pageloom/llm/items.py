"""Blocks of a stated set of short texts that every task holds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Bytes of text and rows of a block, about: rows are dealt to blocks by a hash.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 50_000


def item_blocks(
    items: DataFrame, id_col: str, text_col: str, size: int = BLOCK_BYTES, rows: int = BLOCK_ROWS
) -> Iterator[list[Row]]:
    """Distinct ``(id, text)`` rows, a bounded block at a time; the count of blocks grows with them."""
    rows_in = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    total = rows_in.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")
    ).first()
    blocks = max(-(-total["rows"] // rows), -(-(total["bytes"] or 0) // size))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, blocks)))
    for b in range(blocks):
        yield rows_in.filter(block == b).orderBy("id", "text").collect()
