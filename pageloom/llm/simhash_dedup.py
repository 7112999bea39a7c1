"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints within ``d`` bits of each other agree in one of ``d + 1`` segments.
Each segment in turn is rotated to the top, and the distinct fingerprints are
dealt by it and sorted by Gray rank, in which neighbours differ in few bits.
Over every run of one segment value a tree is built: a node keeps the bits all
its fingerprints share (a mask and a pattern). Two nodes are compared from the
root downwards; once the differences in bits that both share exceed ``d``, all
their fingerprints are pruned together, and once even the bits not shared can't
exceed it, all are linked together. Only links that connect are returned, never
all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cells, components, distinct_roots, over_runs, staged, text_bytes

#: Seed of the shingle hash.
SEED = 42
#: Fingerprints of one segment value that one task takes at once.
CELL_ROWS = 50_000
#: Children of a tree node.
FANOUT = 8
#: Node pairs expanded at once.
FRONTIER = 1 << 18
#: Shingle hashes unpacked to bits at once.
UNPACKED = 1 << 17


def fingerprints_of(texts: list[bytes], words: int) -> np.ndarray:
    """64-bit SimHash fingerprints of UTF-8 texts.

    A-Z are lower-cased, words end at ASCII white space; shingles of ``words``
    words count with repeats. A text of fewer words is one shingle, a text
    without words has fingerprint zero.
    """
    out = np.zeros(len(texts), dtype=np.uint64)
    hashed: list[int] = []
    owners: list[int] = []
    sizes: list[int] = []
    digest = xxhash.xxh64_intdigest

    def settle() -> None:
        if not sizes:
            return
        flat = np.array(hashed, dtype=np.uint64)
        ends = np.cumsum(sizes)
        ones = np.zeros((len(sizes), 64), dtype=np.int64)
        for at in range(0, len(flat), UNPACKED):
            part = flat[at : at + UNPACKED]
            bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64)
            first = int(np.searchsorted(ends, at, side="right"))
            last = int(np.searchsorted(ends, at + len(part) - 1, side="right"))
            cuts = np.concatenate(([0], ends[first:last] - at)).astype(np.int64)
            ones[first : last + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        set_bits = (2 * ones > np.array(sizes)[:, None]).astype(np.uint8)
        out[owners] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
        hashed.clear(), owners.clear(), sizes.clear()

    for k, text in enumerate(texts):
        tokens = text.lower().split()
        if not tokens:
            continue
        if len(tokens) <= words:
            shingles: Iterable[bytes] = (b" ".join(tokens),)
        else:
            shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        before = len(hashed)
        hashed.extend([digest(s, SEED) for s in shingles])
        owners.append(k)
        sizes.append(len(hashed) - before)
        if len(hashed) > UNPACKED:
            settle()
    settle()
    return out


def add_fingerprints(docs: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the fingerprint as bigint ``__fp``."""
    kept = [c for c in docs.columns if c != text_col]
    read = docs.select(*kept, F.col(text_col).alias("__text"))
    schema = read.drop("__text").withColumn("__fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints_of(text_bytes(batch.column("__text")), words).view(np.int64)
            arrays = [batch.column(c) for c in kept] + [pa.array(prints)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "__fp"])

    return read.mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code word in the binary-reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _tree(codes: np.ndarray, run: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of the index, leaves first, until every run has one node."""
    full = np.full(len(codes), ~np.uint64(0))
    rows = np.arange(len(codes))
    levels = [{"mask": full, "pattern": codes, "run": run, "start": rows, "stop": rows + 1}]
    both, some = codes, codes
    lo, hi = rows, rows + 1
    while True:
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        sizes = np.diff(np.append(starts, len(run)))
        if sizes.max() == 1:
            return levels
        place = np.arange(len(run)) - np.repeat(starts, sizes)
        cuts = np.flatnonzero(place % FANOUT == 0)
        ends = np.append(cuts[1:], len(run))
        both = np.bitwise_and.reduceat(both, cuts)
        some = np.bitwise_or.reduceat(some, cuts)
        mask = ~(both ^ some)
        run = run[cuts]
        lo, hi = lo[cuts], hi[ends - 1]
        levels.append(
            {
                "mask": mask,
                "pattern": both & mask,
                "run": run,
                "start": lo,
                "stop": hi,
                "first": cuts,
                "last": ends,
            }
        )


def linked_roots(codes: np.ndarray, run: np.ndarray, bits: int) -> np.ndarray:
    """First linked row of each row; rows are sorted by run and Gray rank.

    Rows of one run are linked when their codes differ in ``bits`` bits or
    fewer.
    """
    levels = _tree(codes, run)
    label = np.arange(len(codes))
    top = np.arange(len(levels[-1]["run"]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, i, j = stack.pop()
        if len(i) > FRONTIER:
            half = len(i) // 2
            stack += [(depth, i[half:], j[half:]), (depth, i[:half], j[:half])]
            continue
        level = levels[depth]
        shared = level["mask"][i] & level["mask"][j]
        apart = np.bitwise_count((level["pattern"][i] ^ level["pattern"][j]) & shared)
        near = apart <= bits
        if depth == 0:
            near &= i != j
            label = distinct_roots(len(codes), i[near], j[near], label)
            continue
        sure = near & (apart + np.bitwise_count(~shared) <= bits)
        for node in (i, j):  # all below both nodes are linked with the first below i
            a, b = level["start"][node[sure]], level["stop"][node[sure]]
            sizes = b - a
            rows = np.repeat(a - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            roots = np.repeat(level["start"][i[sure]], sizes)
            label = distinct_roots(len(codes), rows, roots, label)
        near &= ~sure
        i, j = i[near], j[near]
        width_i = level["last"][i] - level["first"][i]
        width_j = level["last"][j] - level["first"][j]
        sizes = width_i * width_j
        pair = np.repeat(np.arange(len(i)), sizes)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        below_i = level["first"][i][pair] + place // width_j[pair]
        below_j = level["first"][j][pair] + place % width_j[pair]
        once = below_i <= below_j
        stack.append((depth - 1, below_i[once], below_j[once]))
    return label


def fingerprint_links(prints: DataFrame, bits: int) -> DataFrame:
    """Links ``(a, b)`` that connect distinct fingerprints (bigint ``__fp``).

    Each segment value held by more than ``CELL_ROWS`` fingerprints is dealt to
    cells in which every two of them still meet.
    """
    cuts = [round(64 * k / (bits + 1)) for k in range(bits + 2)]
    keyed = []
    for k in range(bits + 1):
        low, width = cuts[k], cuts[k + 1] - cuts[k]
        segment = F.shiftrightunsigned("__fp", low)
        if width < 64:
            segment = segment.bitwiseAND(F.lit((1 << width) - 1))
        keyed.append(F.struct(F.lit(k).alias("k"), segment.cast("bigint").alias("v")))
    rows = prints.select("__fp", F.explode(F.array(*keyed)).alias("__s")).select(
        "__fp", F.col("__s.k").alias("__k"), F.col("__s.v").alias("__v")
    )
    counts = rows.groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("rows"))
    dealt = cells(rows, ["__k", "__v"], F.xxhash64("__fp"), counts, CELL_ROWS).drop("__own")
    keys = ["__k", "__v", "__ci", "__cj"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in over_runs(batches, keys):
            sizes = np.diff(np.append(starts, table.num_rows))
            keep = np.repeat(sizes > 1, sizes)
            if not keep.any():
                continue
            which = np.repeat(np.arange(len(starts)), sizes)[keep]
            codes = table["__fp"].to_numpy().view(np.uint64)[keep]
            top = np.array(cuts)[table["__k"].to_numpy()[keep] + 1].astype(np.uint64)
            turn = (np.uint64(64) - top) & np.uint64(63)
            turned = (codes << turn) | (codes >> ((np.uint64(64) - turn) & np.uint64(63)))
            order = np.lexsort((gray_rank(turned), which))
            codes, turned, which = codes[order], turned[order], which[order]
            root = linked_roots(turned, which, bits)
            moved = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[moved].view(np.int64)), pa.array(codes[root[moved]].view(np.int64))],
                names=["a", "b"],
            )

    return (
        dealt.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(run, "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id_col, fingerprint, component_id``.

    Fingerprints link at ``bits`` or fewer differing bits; a component's id is
    the smallest document id in it. Null and empty texts have fingerprint zero
    and link like any other. A repeated row or id is a row of its own. A null id
    is kept and never a component's id unless all ids of the component are null.
    Other columns are ignored. An empty table gives no rows.
    """
    read = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    prints = staged(add_fingerprints(read, words, "__t"), "simhash-prints")
    groups = fingerprint_groups(prints, bits)
    return (
        prints.join(groups, "__fp")
        .select(
            F.col("__id").alias(id_col),
            F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
            "component_id",
        )
    )


def fingerprint_groups(prints: DataFrame, bits: int) -> DataFrame:
    """``(__fp, __root, component_id)`` of each distinct fingerprint of ``(__id, __fp)``."""
    distinct = staged(prints.groupBy("__fp").agg(F.min("__id").alias("__low")), "simhash-distinct")
    found = components(fingerprint_links(distinct.select("__fp"), bits), "simhash-links")
    rooted = distinct.join(
        found.select(F.col("node").alias("__fp"), F.col("root").alias("__root")), "__fp", "left"
    ).withColumn("__root", F.coalesce("__root", "__fp"))
    lows = rooted.groupBy("__root").agg(F.min("__low").alias("component_id"))
    return rooted.join(lows, "__root").select("__fp", "__root", "component_id")


def keep_one(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, columns as before.

    The document of the smallest id stays; among rows of that id the one whose
    text has the smallest hash, once.
    """
    columns = docs.columns
    mark = F.struct(F.xxhash64("text").alias("x"), F.crc32(F.coalesce("text", F.lit(""))).alias("y"))
    read = docs.select(
        F.col("doc_id").alias("__id"), mark.alias("__mark"), F.col("text").alias("__t")
    )
    prints = staged(add_fingerprints(read, words, "__t"), "simhash-prints")
    groups = fingerprint_groups(prints, bits).select("__fp", "__root")
    first = F.min(F.struct(F.col("__id").isNull().alias("n"), "__id", "__mark"))
    stay = (
        prints.join(groups, "__fp")
        .groupBy("__root")
        .agg(first.alias("__first"))
        .select(F.col("__first.__id").alias("__id"), F.col("__first.__mark").alias("__mark"))
        .withColumn("__key", F.xxhash64("__id", "__mark"))
        .distinct()
    )
    same = (
        F.col("__key") == F.col("__doc_key")
    ) & F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__mark") == F.col("__doc_mark"))
    marked = docs.withColumn("__doc_mark", mark).withColumn(
        "__doc_key", F.xxhash64("doc_id", "__doc_mark")
    )
    return marked.join(stay, same, "left_semi").dropDuplicates(["__doc_key", "doc_id", "__doc_mark"]).select(
        *columns
    )
