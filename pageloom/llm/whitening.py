"""Leading principal components by Chebyshev-filtered subspace iteration.

Vectors become integer vectors; each distinct one counts once. The covariance V
is never formed: a pass over the distributed rows gives ``V Q`` for a thin block
Q, as the sum of ``(x - mean)' ((x - mean) Q)`` over blocks of rows. A round
applies a Chebyshev polynomial of V to the block by its three-term recurrence,
one pass a degree; the polynomial is small between zero and the block's
smallest Ritz value, where the unwanted spectrum lies, and grows steeply above.
QR and a Rayleigh-Ritz step, one more pass, then give eigenvalues and
eigenvectors with their residuals; rounds go on until the residuals certify the
wanted ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import staged

#: Columns of the block besides the wanted ones, degree of the polynomial, rounds at most.
GUARD = 20
DEGREE = 8
ROUNDS = 60
#: Residual, as a share of the largest eigenvalue, that certifies an eigenvector.
CERTIFIED = 2e-14
#: Residual that is accepted where rounding keeps it from falling further.
SETTLED = 1e-11
#: Eigenvalues below this share of the trace are zero.
RANK = 1e-12
#: Integer vectors of one packed block.
BLOCK_ROWS = 4096
#: Largest component that isn't cut off on its way to 64 bits.
LONGEST = 2.0**62


def integer_vectors(vectors: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """``vectors`` with ``__dims`` and ``__x``, the entries times ``scale``, rounded down.

    Rows whose vector is null or holds null, NaN or infinite entries go. ``__x`` packs
    64-bit integers; entries beyond 2^62 are cut off there.
    """
    kept = [c for c in vectors.columns if c != vec_col]
    read = vectors.select(*kept, F.col(vec_col).cast("array<double>").alias("__vec")).filter(
        "__vec is not null and forall(__vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    schema = read.drop("__vec").withColumns({"__dims": F.lit(0), "__x": F.lit(b"")}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__vec")
            entries = lists.flatten().to_numpy()
            with np.errstate(over="ignore"):
                x = np.floor(np.clip(entries * scale, -LONGEST, LONGEST)).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int32)
            bytes_at = pa.py_buffer(np.concatenate(([0], np.cumsum(sizes * 8))).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), len(sizes), [None, bytes_at, pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sizes), column], names=[*kept, "__dims", "__x"]
            )

    return read.mapInArrow(run, schema)


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """Packed vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(-1, dims)


def fit_list(vectors: DataFrame) -> DataFrame:
    """Distinct vectors as blocks ``(__dims, __rows)`` of bounded size."""
    distinct = vectors.select("__dims", "__x").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for dims, x in zip(batch.column("__dims").to_pylist(), batch.column("__x").to_pylist()):
                rows = held.setdefault(dims, [])
                rows.append(x)
                if len(rows) * max(1, dims // 64) >= BLOCK_ROWS:
                    yield block(dims, held.pop(dims))
        for dims, rows in held.items():
            yield block(dims, rows)

    def block(dims: int, rows: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"__dims": pa.array([dims], pa.int32()), "__rows": pa.array([b"".join(rows)], pa.binary())}
        )

    return distinct.mapInArrow(run, "__dims int, __rows binary")


def matrices(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """Integer matrices of the blocks."""
    for batch in batches:
        for rows in batch.column("__rows"):
            yield np.frombuffer(rows.as_py(), dtype=np.int64).reshape(-1, dims)


def summed(blocks: DataFrame, fn, width: int) -> np.ndarray:
    """Sum over all blocks of the matrices that ``fn`` makes of a task's batches.

    Each task sends one row a matrix row; Spark adds them, so the driver gets the
    sum alone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fn(batches)
        if total is not None:
            columns = [pa.array(np.arange(len(total)), pa.int32()), *(pa.array(total[:, k]) for k in range(width))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *(f"c{k}" for k in range(width))])

    schema = "row int, " + ", ".join(f"c{k} double" for k in range(width))
    rows = blocks.mapInArrow(run, schema).groupBy("row").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(width)))
    return np.array([r[1:] for r in sorted(map(tuple, rows.collect()))], dtype=float).reshape(-1, width)


class Covariance:
    """Passes over the distinct vectors of one length."""

    def __init__(self, blocks: DataFrame, dims: int) -> None:
        self.blocks, self.dims = blocks.filter(F.col("__dims") == dims).select("__rows"), dims
        self.passes = 0
        self.count, self.sums = self._sums()
        self.mean = np.array([s / self.count for s in self.sums])
        mean = self.mean

        def spread(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for x in matrices(batches, dims):
                gap = x - mean
                part = (gap * gap).sum(axis=0)[:, None]
                total = part if total is None else total + part
            return total

        self.trace = float(summed(self.blocks, spread, 1).sum()) / self.count

    def _sums(self) -> tuple[int, list[int]]:
        """Number of vectors and the exact sum of each dimension."""
        dims = self.dims

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = 0, np.zeros(dims, dtype=object)
            for x in matrices(batches, dims):
                count += len(x)
                # Halves of 31 bits, so that sums of a block stay exact in 64 bits.
                total += (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & 0x7FFFFFFF).sum(axis=0).astype(object)
            if count:
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(range(-1, dims), pa.int32()),
                        "total": pa.array([str(v) for v in (count, *total)], pa.string()),
                    }
                )

        rows = (
            self.blocks.mapInArrow(run, "row int, total string")
            .groupBy("row")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")))
            .collect()
        )
        found = {r[0]: int(r[1]) for r in rows}
        return found[-1], [found[k] for k in range(dims)]

    def times(self, q: np.ndarray) -> np.ndarray:
        """``V q``."""
        mean, dims = self.mean, self.dims
        self.passes += 1

        def product(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for x in matrices(batches, dims):
                gap = x - mean
                part = gap.T @ (gap @ q)
                total = part if total is None else total + part
            return total

        return summed(self.blocks, product, q.shape[1]) / self.count

    def identity_error(self, basis: np.ndarray) -> float:
        """Largest entry of the covariance of the projections, less the identity."""
        mean, dims, k = self.mean, self.dims, basis.shape[1]

        def moments(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for x in matrices(batches, dims):
                y = (x - mean) @ basis
                part = np.vstack((y.T @ y, y.sum(axis=0)))
                total = part if total is None else total + part
            return total

        total = summed(self.blocks, moments, k) / self.count
        return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def leading(cov: Covariance, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues, eigenvectors as columns)`` of the ``count`` largest eigenvalues.

    Raises where the rounds end without a certificate.
    """
    size = min(cov.dims, count + GUARD)
    rng = np.random.default_rng([seed, cov.dims])
    q = np.linalg.qr(rng.normal(size=(cov.dims, size)))[0]
    before = np.inf
    for _ in range(ROUNDS):
        vq = cov.times(q)
        ritz = q.T @ vq
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = np.linalg.norm(vq[:, :count] - q[:, :count] * values[:count], axis=0).max()
        share = residual / values[0] if values[0] > 0 else 0.0
        if share <= CERTIFIED or (share <= SETTLED and share > before / 4):
            return values[:count], q[:, :count]
        before = share
        q = np.linalg.qr(_filtered(cov, q, vq, values))[0]
    raise RuntimeError(f"no certificate after {ROUNDS} rounds: residual {share:.1e} of the largest eigenvalue")


def _filtered(cov: Covariance, q: np.ndarray, vq: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The Chebyshev polynomial of V, scaled to 1 at the largest Ritz value, applied to ``q``.

    ``vq`` is ``V q``. The recurrence maps zero to the smallest Ritz value onto [-1, 1].
    """
    half = max(values[-1], values[0] * 1e-3) / 2
    sigma = first = half / (values[0] - half) if values[0] > half else 1.0
    old, now = q, (vq - half * q) * (sigma / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - sigma)
        now, old = (cov.times(now) - half * now) * (2 * after / half) - old * (sigma * after), now
        sigma = after
    return now


def whitened(
    df: DataFrame,
    count: int = 4,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    seed: int = 5,
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``.

    One row for each usable vector and each of the ``count`` leading components, fewer
    where vectors are shorter. Entries become ``floor(scale * entry)``; ``n`` counts
    the distinct integer vectors, on which means, covariance (divisor ``n``) and
    components are fitted. ``deviation`` is the exact sum of ``(n x - S)^2`` (null beyond
    64 bits), ``whitened`` the centred vector's projection over the root of the
    eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error``
    the largest entry of the covariance of the whitened fit list less the identity.

    Vectors that are null or hold null, NaN or infinite entries have no rows, empty
    vectors no components. Vectors of each length are fitted by themselves. A
    component of eigenvalue zero has null ``whitened`` and no part in
    ``identity_error``; where all vectors are one, ``explained`` is null too. Repeated rows and
    ids stay rows of their own. Other columns are ignored; of an empty table nothing is
    returned. A component's largest entry, the first of equal ones, is positive.
    """
    spark = df.sparkSession
    read = df.select(F.col(id_col).alias("__id"), F.col(vec_col).alias("__vec"))
    vectors = staged(integer_vectors(read, "__vec", scale), "white-vectors")
    blocks = staged(fit_list(vectors), "white-blocks")
    out = None
    for (dims,) in blocks.select("__dims").filter("__dims > 0").distinct().orderBy("__dims").collect():
        part = _of_length(vectors.filter(F.col("__dims") == dims), Covariance(blocks, dims), count, seed)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = vectors.schema["__id"].dataType.simpleString()
        out = spark.createDataFrame([], f"__id {kind}, {COLUMNS}")
    return out.withColumnRenamed("__id", id_col)


COLUMNS = (
    "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def _of_length(vectors: DataFrame, cov: Covariance, count: int, seed: int) -> DataFrame:
    """Rows of :func:`whitened` for vectors of one length."""
    dims, n, mean = cov.dims, cov.count, cov.mean
    count = min(count, dims)
    if cov.trace > 0:
        values, axes = leading(cov, count, seed)
        flip = axes[np.argmax(np.abs(axes), axis=0), np.arange(count)] < 0
        axes = np.where(flip, -axes, axes)
        real = values > RANK * cov.trace
        basis = axes[:, real] / np.sqrt(values[real])
        error = cov.identity_error(basis)
        explained = np.where(real, values / cov.trace, 0.0).tolist()
    else:
        real, basis, error, explained = np.zeros(count, dtype=bool), np.zeros((dims, 0)), None, [None] * count
    sums = np.array(cov.sums, dtype=object)

    def deviations(x: np.ndarray) -> list[int | None]:
        largest = n * int(np.abs(x).max()) + max(map(abs, sums))
        if largest * largest * dims < 2**63:
            gap = n * x - sums.astype(np.int64)
            return (gap * gap).sum(axis=1).tolist()
        gap = n * x.astype(object) - sums
        return [v if v < 2**63 else None for v in (gap * gap).sum(axis=1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column("__x"), dims)
            white = np.full((len(x), count), np.nan)
            white[:, real] = (x - mean) @ basis
            rows = np.repeat(np.arange(len(x)), count)
            values = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(rows), n, dtype=np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(rows)),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * len(rows), pa.float64()),
                ],
                names=["__id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = vectors.schema["__id"].dataType.simpleString()
    return vectors.select("__id", "__x").mapInArrow(run, f"__id {kind}, {COLUMNS}")
