"""Embedding near-duplicates by cross-polytope hashing.

Every table rotates the vectors by ``H D3 H D2 H D1``: random signs and fast
Hadamard transforms, ``funcs`` times. A rotation's hash is the coordinate
largest in size, with its sign: the nearest corner of the cross-polytope. A
vector is entered under its ``probes`` most likely buckets of each table, so two
vectors meet when any of their likely buckets agree. Pairs that meet are
verified by their cosine in double precision; a pair is counted in the first
bucket in which it meets, which both vectors can tell by themselves, so pairs
are never written out to be made distinct.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cells, components, distinct_roots, over_runs, staged

#: Tables, and buckets in which a vector is entered per table at two functions.
#: A pair at cosine 0.95 in 64 dimensions is missed once in about 30,000 times.
TABLES = 3
PROBES = 6
#: Vectors of one bucket that one task takes at once.
CELL_ROWS = 4096
#: Cosines this close to the threshold are computed again, component by component.
CLOSE = 1e-9
#: Rows of a similarity block.
BLOCK = 512


def functions_for(rows: int, width: int) -> int:
    """Hash functions joined to a bucket: more rows need finer buckets."""
    return max(2, int(math.log(max(rows, 2)) / math.log(2 * width)))


def probes_for(funcs: int) -> int:
    """Buckets per table; each further function triples them to keep the recall."""
    return PROBES * 3 ** (funcs - 2)


def padded_width(width: int) -> int:
    """The Hadamard size: the next power of two."""
    return 1 << max(1, (width - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def buckets(vectors: np.ndarray, tables: int, funcs: int, probes: int, seed: int) -> np.ndarray:
    """Bucket numbers of unit vectors, ``(rows, tables, probes)``, int64."""
    rows, width = vectors.shape
    size = padded_width(width)
    x = np.zeros((rows, size))
    x[:, :width] = vectors
    near = min(size, max(4, probes))
    out = np.empty((rows, tables, probes), dtype=np.int64)
    for t in range(tables):
        signs = np.random.default_rng([seed, size, t]).choice([-1.0, 1.0], size=(funcs, 3, size))
        cost, code = np.zeros((rows, 1)), np.full((rows, 1), t, dtype=np.int64)
        for f in range(funcs):
            y = x
            for s in signs[f]:
                y = hadamard(y * s)
            big = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, big, 1)
            lost = np.abs(value[:, :1]) - np.abs(value)
            corner = 2 * big + (value < 0)
            cost = (cost[:, :, None] + lost[:, None, :]).reshape(rows, -1)
            code = (code[:, :, None] * (2 * size) + corner[:, None, :]).reshape(rows, -1)
            keep = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, code = np.take_along_axis(cost, keep, 1), np.take_along_axis(code, keep, 1)
        if code.shape[1] < probes:
            code = np.pad(code, ((0, 0), (0, probes - code.shape[1])), mode="edge")
        out[:, t] = code
    return out


def list_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's components in double precision; None for a null row or component."""
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)
    bad_at = np.cumsum(np.concatenate(([0], ~np.isfinite(flat)))) if len(flat) else np.zeros(1)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [
        flat[a:b] if ok and b > a and bad_at[b] == bad_at[a] and flat[a:b].any() else None
        for a, b, ok in zip(offsets[:-1], offsets[1:], valid)
    ]


def vector_key(vector: np.ndarray) -> bytes:
    """Sixteen bytes that name a vector's exact components."""
    return hashlib.sha256((vector + 0.0).tobytes()).digest()[:16]


def keyed_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(__id, __key, __vec)``: key and double components, null where a vector takes no part."""
    read = df.select(
        F.col(id_col).cast("bigint").alias("__id"), F.col(vec_col).cast("array<double>").alias("__v")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list_rows(batch.column("__v"))
            keys = [None if v is None else vector_key(v) for v in rows]
            data = [None if v is None else (v + 0.0).tobytes() for v in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
                names=["__id", "__key", "__vec"],
            )

    return read.mapInArrow(run, "__id bigint, __key binary, __vec binary")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Components of equally long vectors as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``, summed from first to last component."""

    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1]

    with np.errstate(over="ignore", invalid="ignore"):
        value = total(a * b) / np.sqrt(total(a * a) * total(b * b))
    if not np.isfinite(value).all():  # components near the limits of a double
        scaled = [x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b)]
        again = total(scaled[0] * scaled[1]) / np.sqrt(
            total(scaled[0] ** 2) * total(scaled[1] ** 2)
        )
        value = np.where(np.isfinite(value), value, again)
    return np.clip(value, -1.0, 1.0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _pairs(units: np.ndarray, vectors: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Index pairs with a cosine of at least ``threshold``, block by block."""
    same = left is right
    for at in range(0, len(left), BLOCK):
        rows = left[at : at + BLOCK]
        others = right[at:] if same else right
        value = units[rows] @ units[others].T
        i, j = np.nonzero(value >= threshold - CLOSE)
        if same:
            later = j > i
            i, j = i[later], j[later]
        a, b, close = rows[i], others[j], value[i, j] < threshold + CLOSE
        if close.any():
            sure = ~close
            sure[close] = cosines(vectors[a[close]], vectors[b[close]]) >= threshold
            a, b = a[sure], b[sure]
        yield a, b


def _first_meeting(codes: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether ``bucket`` of ``table`` is the first in which each pair meets."""
    open_ = np.ones(len(a), dtype=bool)
    for t in range(table + 1):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        x, y = codes[a[at], t], codes[b[at], t]
        met = np.zeros(len(at), dtype=bool)
        for p in range(x.shape[1]):
            here = (x[:, p : p + 1] == y).any(axis=1)
            met |= here if t < table else here & (x[:, p] < bucket)
        open_[at[met]] = False
    return open_


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    tables: int = TABLES,
    seed: int = 7,
) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    ``n_links`` counts the other rows at a cosine of ``threshold`` or more,
    ``component_id`` is the smallest id reachable, ``kept`` whether it is the
    row's own. Vectors that are null, empty, all zero or hold null, infinite or
    NaN components link with nothing, and vectors of different lengths never
    link. Repeated rows and ids are vectors of their own; a row with a null id
    is counted in links but names a component only if it holds no other id
    (``kept`` is then null). Other columns are ignored.
    """
    keyed = staged(keyed_vectors(df, id_col, vec_col), "vectors")
    # Copies of a vector are one node from here on.
    nodes = staged(
        keyed.filter("__key is not null")
        .groupBy("__key")
        .agg(
            F.min("__id").alias("__low"),
            F.count(F.lit(1)).alias("__copies"),
            F.first("__vec").alias("__vec"),
        )
        .withColumn("__width", (F.length("__vec") / 8).cast("int")),
        "vector-nodes",
    )
    size = nodes.agg(F.count(F.lit(1)).alias("rows"), F.max("__width").alias("width")).first()
    funcs = functions_for(size["rows"], padded_width(size["width"] or 2))
    probes = probes_for(funcs)

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("__width").to_numpy()
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                codes = buckets(unit(matrix(part.column("__vec"), int(w))), tables, funcs, probes, seed)
                flat = codes.reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__key"), part.column("__copies"), part.column("__width")]
                    + [pa.array(list(flat), pa.list_(pa.int64())), part.column("__vec")],
                    names=["__key", "__copies", "__width", "__codes", "__vec"],
                )

    entered = nodes.mapInArrow(
        enter, "__key binary, __copies bigint, __width int, __codes array<bigint>, __vec binary"
    )
    entered = staged(entered, "vector-buckets")
    counts = (
        entered.select("__width", F.explode(F.array_distinct("__codes")).alias("__code"))
        .groupBy("__width", "__code")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    exploded = entered.select(
        "__key", "__copies", "__width", "__vec", F.explode(F.array_distinct("__codes")).alias("__code")
    )
    dealt = cells(exploded, ["__width", "__code"], F.xxhash64("__key"), counts, CELL_ROWS)
    keys = ["__width", "__code", "__ci", "__cj"]

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in over_runs(batches, keys):
            ends = np.append(starts[1:], table.num_rows)
            widths_here, codes_here = table["__width"].to_numpy(), table["__code"].to_numpy()
            ci, cj = table["__ci"].to_numpy(), table["__cj"].to_numpy()
            own, copies = table["__own"].to_numpy(), table["__copies"].to_numpy()
            out_key: list[bytes] = []
            out_root: list[bytes] = []
            out_links: list[np.ndarray] = []
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                width, code = int(widths_here[s]), int(codes_here[s])
                vectors = matrix(table["__vec"].slice(s, e - s), width)
                units = unit(vectors)
                everyone = np.arange(e - s)
                left = everyone if ci[s] == cj[s] else everyone[own[s:e] == ci[s]]
                right = left if ci[s] == cj[s] else everyone[own[s:e] == cj[s]]
                step = code // (2 * padded_width(width)) ** funcs
                links = np.zeros(e - s)
                label = np.arange(e - s)
                known = np.full(e - s, -1)
                rows_known: np.ndarray | None = None
                for a, b in _pairs(units, vectors, left, right, threshold):
                    if not len(a):
                        continue
                    new = np.unique(np.concatenate((a, b)))
                    new = new[known[new] < 0]
                    if len(new):
                        got = buckets(units[new], step + 1, funcs, probes, seed)
                        base = 0 if rows_known is None else len(rows_known)
                        known[new] = base + np.arange(len(new))
                        rows_known = got if rows_known is None else np.concatenate((rows_known, got))
                    first = _first_meeting(rows_known, known[a], known[b], step, code)
                    a, b = a[first], b[first]
                    own_copies = copies[s:e]
                    links += np.bincount(a, own_copies[b], e - s) + np.bincount(b, own_copies[a], e - s)
                    label = distinct_roots(e - s, a, b, label)
                named = np.flatnonzero(links)
                names = table["__key"].slice(s, e - s)
                out_key += names.take(pa.array(named)).to_pylist()
                out_root += names.take(pa.array(label[named])).to_pylist()
                out_links.append(links[named].astype(np.int64))
            if out_key:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out_key, pa.binary()),
                        pa.array(out_root, pa.binary()),
                        pa.array(np.concatenate(out_links)),
                    ],
                    names=["__key", "__root", "__links"],
                )

    met = staged(
        dealt.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(verify, "__key binary, __root binary, __links bigint"),
        "vector-links",
    )
    links = met.groupBy("__key").agg(F.sum("__links").alias("__links"))
    found = components(
        met.select(F.col("__key").alias("a"), F.col("__root").alias("b")), "vector-components"
    )
    rooted = nodes.join(
        found.select(F.col("node").alias("__key"), "root"), "__key", "left"
    ).withColumn("__root", F.coalesce("root", "__key"))
    lows = rooted.groupBy("__root").agg(F.min("__low").alias("component_id"))
    result = (
        rooted.join(lows, "__root")
        .join(links, "__key", "left")
        .select(
            "__key",
            "component_id",
            (F.coalesce("__links", F.lit(0)) + F.col("__copies") - 1).alias("__n"),
        )
    )
    return (
        keyed.select("__id", "__key")
        .join(result, "__key", "left")
        .select(
            F.col("__id").alias(id_col),
            F.coalesce("__n", F.lit(0)).cast("bigint").alias("n_links"),
            F.when(F.col("__key").isNull(), F.col("__id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col) == F.col("component_id"))
    )
