"""Nearest neighbours by stable projections and kd-trees.

Unit vectors are projected by ``DIMS`` normal (2-stable) random directions, so
the squared projected distance of two vectors, divided by their squared
distance, is chi-squared with ``DIMS`` degrees of freedom. Projected points lie
in cells of a kd-tree fitted on a bounded sample; each cell, cut into chunks
where it is large, has its own kd-tree. A query takes points in order of their
projected distance and verifies them by their cosine, until the next projected
distance would be, for a point nearer than the found ones, beyond the
chi-squared quantile ``SURE``. Points that tie are kept until their ids decide.
First each query searches its own cell, then
every other cell that this same test can't rule out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import over_runs, staged
from pageloom.llm.embedding_dedup import cosines, keyed_vectors, matrix, unit

#: Projected dimensions, and the chance with which a nearer point is seen in time.
DIMS = 8
SURE = 0.9999
#: Vectors in the sample that the upper tree is fitted on, and its cells, at most.
SAMPLE_ROWS = 16_384
CELLS = 1024
#: Vectors of a cell, about, and of one chunk, at most about.
CELL_ROWS = 8192
#: Queries that search a chunk together, about.
QUERY_ROWS = 2048
#: Cosines and squared distances this close may be equal ones.
TIED = 1e-12
#: Points of a leaf of a chunk's tree.
LEAF = 128


def chi_squared_quantile(share: float, degrees: int) -> float:
    """Value below which a chi-squared variable of even ``degrees`` lies with chance ``share``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        term = total = math.exp(-mid / 2)
        for k in range(1, degrees // 2):
            term *= mid / 2 / k
            total += term
        low, high = (mid, high) if 1 - total < share else (low, mid)
    return high


def directions(width: int, seed: int) -> np.ndarray:
    """Random directions for vectors of a length."""
    return np.random.default_rng([seed, width]).normal(size=(width, DIMS))


def fit_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Splits ``(dimension, value)`` of a complete binary tree, level by level."""
    depth = max(0, (max(1, leaves) - 1).bit_length())
    splits: list[tuple[int, float]] = []
    groups = [points]
    for _ in range(depth):
        after = []
        for g in groups:
            d = int(np.argmax(g.max(axis=0) - g.min(axis=0))) if len(g) else 0
            value = float(np.median(g[:, d])) if len(g) else 0.0
            splits.append((d, value))
            after += [g[g[:, d] <= value], g[g[:, d] > value]]
        groups = after
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """Leaf number of each point."""
    node = np.zeros(len(points), dtype=np.int64)
    if splits:
        dims, values = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for _ in range((len(splits) + 1).bit_length() - 1):
            right = points[np.arange(len(points)), dims[node]] > values[node]
            node = 2 * node + 1 + right
    return node - len(splits)


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point from each box."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


class ChunkTree:
    """A kd-tree over the projected points of a chunk, as boxes of leaves."""

    def __init__(self, points: np.ndarray) -> None:
        leaves = [np.arange(len(points))]
        while max(map(len, leaves)) > LEAF:
            after = []
            for rows in leaves:
                if len(rows) <= LEAF:
                    after.append(rows)
                    continue
                part = points[rows]
                d = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                order = rows[np.argsort(part[:, d], kind="stable")]
                after += [order[: len(rows) // 2], order[len(rows) // 2 :]]
            leaves = after
        self.points, self.leaves = points, leaves
        self.low = np.array([points[r].min(axis=0) for r in leaves])
        self.high = np.array([points[r].max(axis=0) for r in leaves])

    def ascending(self, point: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Points in order of projected distance, a block at a time.

        Yields the smallest squared distance of the block and its rows; no later
        block holds a smaller one than the largest of a block before it.
        """
        bounds = box_distances(point, self.low, self.high)
        order = np.argsort(bounds, kind="stable")
        rows = np.zeros(0, dtype=np.int64)
        far = np.zeros(0)
        for k, leaf in enumerate(order):
            fresh = self.leaves[leaf]
            gap = self.points[fresh] - point
            rows = np.concatenate((rows, fresh))
            far = np.concatenate((far, (gap * gap).sum(axis=1)))
            limit = bounds[order[k + 1]] if k + 1 < len(order) else np.inf
            ready = far <= limit
            if ready.any():
                yield float(far[ready].min()), rows[ready]
                rows, far = rows[~ready], far[~ready]


def search(
    tree: ChunkTree, units: np.ndarray, point: np.ndarray, query: np.ndarray, count: int, reach: float, limit: float
) -> np.ndarray:
    """Rows of about the ``2 * count`` nearest units found, and of all that tie with the last.

    ``reach`` is the squared distance of the ``count``-th nearest known so far,
    ``limit`` the chi-squared quantile of the stopping test.
    """
    rows = np.zeros(0, dtype=np.int64)
    near = np.zeros(0)
    for least, block in tree.ascending(point):
        if least > limit * reach:
            break
        value = units[block] @ query
        rows, near = np.concatenate((rows, block)), np.concatenate((near, value))
        if len(rows) > 2 * count:
            last = -np.partition(-near, 2 * count - 1)[2 * count - 1]
            keep = near >= last - TIED
            rows, near = rows[keep], near[keep]
        if len(rows) >= count:
            kth = -np.partition(-near, count - 1)[count - 1]
            reach = min(reach, max(0.0, 2 - 2 * kth) + 1e-12)
    return rows


def nearest_rows(
    df: DataFrame,
    is_query: Callable[[Column], Column],
    count: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    seed: int = 11,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``count`` nearest rows of each query.

    ``is_query`` makes a condition of the id. Nearest by largest cosine, ties to
    the smaller id; a row is no candidate of a query with its id. Vectors that
    are null, empty, all zero or hold null, infinite or NaN components, and rows
    with a null id, take no part; vectors are compared with those of their
    length only. A repeated row with one id and vector counts once. Other columns
    are ignored.
    """
    keyed = staged(
        keyed_vectors(df, id_col, vec_col).filter("__id is not null and __key is not null"), "ann-vectors"
    )
    # Copies of a vector are one point; only their first ids can be among the nearest.
    by_id = Window.partitionBy("__key").orderBy("__id")
    first = (
        keyed.select("__key", "__id")
        .distinct()
        .withColumn("__r", F.row_number().over(by_id))
        .filter(F.col("__r") <= count + 1)
        .groupBy("__key")
        .agg(F.sort_array(F.collect_list("__id")).alias("__ids"))
    )
    asks = F.coalesce(is_query(F.col("__id")), F.lit(False))
    asked = keyed.filter(asks).select("__id", "__key").distinct()
    points = (
        keyed.groupBy("__key")
        .agg(F.first("__vec").alias("__vec"), F.max(asks).alias("__asks"))
        .join(first, "__key")
    )

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array([len(v) // 8 for v in batch.column("__vec").to_pylist()])
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                at = unit(matrix(part.column("__vec"), int(width))) @ directions(int(width), seed)
                columns = [*part.columns, pa.array(np.full(part.num_rows, width, dtype=np.int32))]
                columns.append(pa.array([p.tobytes() for p in at], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "__width", "__at"])

    points = staged(
        points.mapInArrow(
            project,
            "__key binary, __vec binary, __asks boolean, __ids array<bigint>, __width int, __at binary",
        ),
        "ann-points",
    )
    total = points.count()
    sample = points.orderBy(F.xxhash64("__key"), "__key").limit(SAMPLE_ROWS).select("__at").collect()
    leaves = min(CELLS, -(-total // CELL_ROWS), max(1, len(sample) // 16))
    splits = fit_tree(np.frombuffer(b"".join(bytes(r[0]) for r in sample), dtype=float).reshape(-1, DIMS), leaves)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = matrix(batch.column("__at"), DIMS)
            columns = [*batch.columns, pa.array(cell_of(at, splits).astype(np.int32))]
            columns.append(pa.array(list(at), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__cell", "__xyz"])

    placed = staged(
        points.mapInArrow(
            place, points.withColumns({"__cell": F.lit(0), "__xyz": F.array(F.lit(0.0))}).schema
        ),
        "ann-cells",
    )
    # One row for each length and cell, of which there are at most CELLS a length.
    boxes = (
        placed.groupBy("__width", "__cell")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *(F.min(F.col("__xyz")[d]).alias(f"low{d}") for d in range(DIMS)),
            *(F.max(F.col("__xyz")[d]).alias(f"high{d}") for d in range(DIMS)),
        )
        .orderBy("__width", "__cell")
        .collect()
    )
    chunks = {(b["__width"], b["__cell"]): -(-b["rows"] // (2 * CELL_ROWS)) for b in boxes}
    candidates = placed.drop("__asks", "__xyz")
    queries = placed.filter("__asks").select("__key", "__vec", "__width", "__at", "__cell")
    own = searched(
        candidates, queries.withColumn("__reach", F.lit(4.0)), chunks, count, "ann-own"
    )
    reach = own.groupBy("__query").agg(
        F.slice(F.sort_array(F.collect_list("__score"), asc=False), 1, count + 1).alias("__best")
    )

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = chi_squared_quantile(SURE, DIMS)
        by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {b["__width"] for b in boxes}:
            here = [b for b in boxes if b["__width"] == width]
            by_width[width] = (
                np.array([b["__cell"] for b in here]),
                np.array([[b[f"low{d}"] for d in range(DIMS)] for b in here]),
                np.array([[b[f"high{d}"] for d in range(DIMS)] for b in here]),
            )
        for batch in batches:
            at = matrix(batch.column("__at"), DIMS)
            source, cells_found, reaches = [], [], []
            for k in range(batch.num_rows):
                best = batch.column("__best")[k].as_py()
                known = max(0.0, 2 - 2 * best[count]) + TIED if best and len(best) > count else 4.0
                names, low, high = by_width[batch.column("__width")[k].as_py()]
                visit = names[box_distances(at[k], low, high) <= limit * known]
                visit = visit[visit != batch.column("__cell")[k].as_py()]
                source += [k] * len(visit)
                cells_found += visit.tolist()
                reaches += [known] * len(visit)
            part = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("__key", "__vec", "__width", "__at")]
                + [pa.array(cells_found, pa.int32()), pa.array(reaches, pa.float64())],
                names=["__key", "__vec", "__width", "__at", "__cell", "__reach"],
            )

    further = queries.join(reach, F.col("__key") == F.col("__query"), "left").mapInArrow(
        others, "__key binary, __vec binary, __width int, __at binary, __cell int, __reach double"
    )
    rest = searched(candidates, staged(further, "ann-visits"), chunks, count, "ann-rest")
    found = own.unionByName(rest).withColumn("__found", F.explode("__ids"))
    best = Window.partitionBy("__query").orderBy(F.desc("__score"), "__found")
    lists = (
        found.withColumn("__r", F.row_number().over(best))
        .filter(F.col("__r") <= count + 1)
        .groupBy("__query")
        .agg(F.sort_array(F.collect_list(F.struct("__r", "__found", "__score"))).alias("__list"))
    )
    answer = F.slice(F.filter("__list", lambda x: x["__found"] != F.col("__id")), 1, count)
    return (
        asked.join(lists, F.col("__key") == F.col("__query"))
        .select("__id", F.posexplode(answer).alias("__pos", "__one"))
        .select(
            F.col("__id").alias("query_id"),
            (F.col("__pos") + 1).cast("int").alias("rank"),
            F.col("__one.__found").alias("vec_id"),
            F.col("__one.__score").alias("score"),
        )
    )


def searched(
    candidates: DataFrame, queries: DataFrame, chunks: dict[tuple[int, int], int], count: int, name: str
) -> DataFrame:
    """``(__query, __score, __ids)``: the nearest points of each query in each chunk of its cell.

    A chunk's points and the queries that visit it meet in one task; the queries
    of a cell are dealt into groups, and the points go once to each group.
    """
    keys = ["__width", "__cell", "__chunk", "__group"]
    groups = queries.groupBy("__width", "__cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("__groups")
    )
    spread = [(w, c, n) for (w, c), n in chunks.items()]
    sizes = candidates.sparkSession.createDataFrame(spread or [(0, 0, 1)], "__width int, __cell int, __chunks int")
    plan = F.broadcast(groups.join(sizes, ["__width", "__cell"]))  # one row for each cell
    points = candidates.join(plan, ["__width", "__cell"]).select(
        "__width",
        "__cell",
        F.pmod(F.xxhash64("__key"), F.col("__chunks")).cast("int").alias("__chunk"),
        F.explode(F.sequence(F.lit(0), F.col("__groups") - 1)).alias("__group"),
        F.lit(False).alias("__asks"),
        "__key",
        "__vec",
        "__at",
        "__ids",
        F.lit(0.0).alias("__reach"),
    )
    visits = queries.join(plan, ["__width", "__cell"]).select(
        "__width",
        "__cell",
        F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"),
        F.pmod(F.xxhash64("__key", F.lit(1)), F.col("__groups")).cast("int").alias("__group"),
        F.lit(True).alias("__asks"),
        "__key",
        "__vec",
        "__at",
        F.lit(None).cast("array<bigint>").alias("__ids"),
        "__reach",
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = chi_squared_quantile(SURE, DIMS)
        for table, starts in over_runs(batches, keys):
            for start, stop in zip(starts, np.append(starts[1:], table.num_rows)):
                part = table.slice(start, stop - start)
                asks = part["__asks"].to_numpy()
                if asks.all() or not asks.any():
                    continue
                width = part["__width"][0].as_py()
                vectors = matrix(part["__vec"], width)
                units, at = unit(vectors), matrix(part["__at"], DIMS)
                here, there = np.flatnonzero(~asks), np.flatnonzero(asks)
                tree = ChunkTree(at[here])
                inside = units[here]
                reach = part["__reach"].to_numpy()
                lowest = pc.list_element(part["__ids"].combine_chunks().filter(pa.array(~asks)), 0).to_numpy()
                first = np.zeros(len(asks), dtype=lowest.dtype)
                first[here] = lowest
                rows, asked, scores = [], [], []
                for q in there:
                    found = here[search(tree, inside, at[q], units[q], count + 1, reach[q], limit)]
                    exact = cosines(vectors[found], np.broadcast_to(vectors[q], (len(found), width)))
                    # Of points that tie, those of the smallest ids.
                    keep = np.lexsort((first[found], -exact))[: count + 1]
                    rows.append(found[keep])
                    scores.append(exact[keep])
                    asked.append(np.full(len(keep), q))
                rows_at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["__key"].take(pa.array(np.concatenate(asked))).combine_chunks(),
                        pa.array(np.concatenate(scores)),
                        part["__ids"].take(rows_at).combine_chunks(),
                    ],
                    names=["__query", "__score", "__ids"],
                )

    return staged(
        points.unionByName(visits)
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(run, "__query binary, __score double, __ids array<bigint>"),
        name,
    )
