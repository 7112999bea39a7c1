"""Text quality by positive-unlabelled learning.

Trusted positives are documents labelled good; all documents of the corpus are
the unlabelled set. With class prior ``pi`` the risk of a linear score ``g`` is

    pi E_P[loss(g)] + max(0, E_U[loss(-g)] - pi E_P[loss(-g)])

for the logistic loss: the second part stands for the negatives and is kept from
turning negative. Without the floor the risk is convex, and each Newton step
takes one pass over the corpus, in which tasks sum gradients and curvature; a
step that would cross the floor is halved.

No label of a bad document enters the risk or the prior. That is estimated from
the scores of a first fit: were there scores that good documents alone have, the
share of all documents above such a score would be ``pi`` times that of the
positives, so ``pi`` is the ratio of the two shares where the ratio, widened by
the error of shares of so many rows, is smallest. A fit knows its own positives
from others alike, so each half of the rows is scored by a fit of the other half.

The floor keeps the scores of both kinds close together, so they are stretched at
the end: a logistic curve with two parameters is fitted on the labelled rows that
may be learnt from, the only use of labels of bad documents. It changes no order.

Features are shares and ratios of the whole text, each cut into bins at
quantiles of the corpus, so that a linear score can follow any shape.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import staged, text_bytes

#: Places of the bin borders of each feature.
QUANTILES = (0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.35, 0.5, 0.65, 0.8, 0.88, 0.92, 0.96, 0.98, 0.99)
#: Relative error of the quantiles.
QUANTILE_ERROR = 0.002
#: Weight decay, Newton steps and halvings of a step.
DECAY = 1e-3
STEPS = 12
HALVINGS = 4
#: Groups in which the tasks' sums are added before they reach the driver.
SUM_GROUPS = 32
#: Steps of a score's unit that rows are counted in.
GRID = 50
#: Prior of the first fit; chance that the error of a share is larger than allowed for.
FIRST_PRIOR = 0.5
DOUBT = 0.1
#: Score from which on a document counts as good.
GOOD = 0.3
#: Share of ids that are held out: one in so many.
FOLDS = 5

FEATURES = (
    "log_words",
    "word_length",
    "distinct_words",
    "top_word",
    "distinct_pairs",
    "upper",
    "digits",
    "marks",
    "symbols",
    "symbol_words",
    "line_repeats",
    "words_per_line",
    "packed",
    "sentence_length",
)
_UPPER = np.arange(ord("A"), ord("Z") + 1)
_DIGIT = np.arange(ord("0"), ord("9") + 1)
_MARKS = np.frombuffer(b".,;:?'\"-()", dtype=np.uint8)
_SYMBOLS = np.array(
    [c for c in range(33, 127) if not chr(c).isalnum() and c not in set(_MARKS.tolist())], dtype=np.int64
)


def features_of(data: bytes) -> list[float]:
    """Features of a text given in UTF-8; all zero without words."""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = max(1, len(data) - int(counts[[9, 10, 11, 12, 13, 32]].sum()))
    upper, digits = counts[_UPPER].sum(), counts[_DIGIT].sum()
    marks, symbols = counts[_MARKS].sum(), counts[_SYMBOLS].sum()
    distinct = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    odd = sum(c for w, c in distinct.items() if not w.isalnum() and w.translate(None, _PLAIN))
    return [
        float(np.log1p(n)),
        size / n,
        len(distinct) / n,
        distinct.most_common(1)[0][1] / n,
        pairs / max(1, n - 1),
        upper / size,
        digits / size,
        marks / size,
        symbols / size,
        odd / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        len(zlib.compress(data, 1)) / (len(data) + 16),
        float(np.log1p(n / (1 + counts[ord(".")] + counts[ord("?")] + counts[ord("!")]))),
    ]


#: Bytes of ordinary words: letters, digits, marks and everything beyond ASCII.
_PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or c in set(_MARKS.tolist()))


def held_out(id_col: Column) -> Column:
    """Whether an id belongs to the fold that is never learnt from; a null id doesn't."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def add_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(__id, __held, __f)`` of each document; nothing but the text makes ``__f``."""
    read = docs.select(
        F.col(id_col).alias("__id"), held_out(F.col(id_col)).alias("__held"), F.col(text_col).alias("__text")
    )
    kind = read.schema["__id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t) for t in text_bytes(batch.column("__text"))]
            columns = [batch.column("__id"), batch.column("__held"), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "__held", "__f"])

    return read.mapInArrow(run, f"__id {kind}, __held boolean, __f array<double>")


def design(column: pa.Array, borders: list[np.ndarray]) -> np.ndarray:
    """One column for each bin of each feature, and one of ones."""
    x = column.flatten().to_numpy().reshape(-1, len(FEATURES))
    parts = [np.ones((len(x), 1))]
    for k, cuts in enumerate(borders):
        parts.append(np.eye(len(cuts) + 1)[np.searchsorted(cuts, x[:, k], side="right")])
    return np.concatenate(parts, axis=1)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sums(rows: DataFrame, borders: list[np.ndarray], weights: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over all rows ``(__f, __good)`` at given weights."""
    width = len(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + 2 * width + width * width)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = design(part.column("__f"), borders)
                good = part.column("__good").to_numpy(zero_copy_only=False)
                g = x @ weights
                s = 1 / (1 + np.exp(np.clip(-g, -500, 500)))
                total[0] += len(x)
                total[1] += _softplus(g).sum()
                total[2] += good.sum()
                total[3] += _softplus(g[good]).sum()
                total[4 : 4 + width] += s @ x
                total[4 + width : 4 + 2 * width] += x[good].sum(axis=0)
                total[4 + 2 * width :] += ((x * (s * (1 - s))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    def add(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, dtype=float) for x in table["sum"].to_pylist()]
        return pa.table({"sum": pa.array([np.sum(found, axis=0).tobytes()], pa.binary())})

    by_task = rows.select("__f", "__good").mapInArrow(run, "sum binary")
    grouped = by_task.groupBy((F.spark_partition_id() % SUM_GROUPS).alias("g")).applyInArrow(add, "sum binary")
    total = np.sum([np.frombuffer(bytes(r[0]), dtype=float) for r in grouped.collect()], axis=0)
    return {
        "rows": total[0],
        "loss_u": total[1],
        "good": total[2],
        "loss_p": total[3],
        "grad_u": total[4 : 4 + width],
        "sum_p": total[4 + width : 4 + 2 * width],
        "curve": total[4 + 2 * width :].reshape(width, width),
    }


def train(rows: DataFrame, borders: list[np.ndarray], prior: float) -> np.ndarray:
    """Weights of the least non-negative risk found."""
    width = 1 + sum(len(b) + 1 for b in borders)
    weights = np.zeros(width)
    keep = np.full(width, DECAY)
    keep[0] = 1e-8
    here = sums(rows, borders, weights)
    if not here["good"]:
        return weights
    for _ in range(STEPS):
        gradient = here["grad_u"] / here["rows"] - prior * here["sum_p"] / here["good"] + keep * weights
        curve = here["curve"] / here["rows"] + np.diag(keep)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 8.0 / max(1e-12, np.abs(step).max()))
        for _ in range(HALVINGS):
            there = sums(rows, borders, weights - step)
            negative = there["loss_u"] / there["rows"] - prior * there["loss_p"] / there["good"]
            if negative >= 0:
                break
            step = step / 2
        else:
            return weights
        weights, here = weights - step, there
        if np.abs(step).max() < 1e-2:
            break
    return weights


def linear_scores(column: pa.Array, borders: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Score ``g`` of each row of features, some thousand at a time."""
    parts = [design(column.slice(at, 4096), borders) @ weights for at in range(0, len(column), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0)


def count_scores(
    rows: DataFrame, borders: list[np.ndarray], weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(g, positives, everyone)``: rows by ``g`` in rising steps of ``1 / GRID``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = np.clip(linear_scores(batch.column("__f"), borders, weights), -50, 50)
            place = pa.array(np.rint(g * GRID).astype(np.int64))
            yield pa.RecordBatch.from_arrays([place, batch.column("__good")], names=["place", "good"])

    placed = rows.select("__f", "__good").mapInArrow(run, "place bigint, good boolean")
    # at most 100 * GRID places
    found = (
        placed.groupBy("place")
        .agg(F.count_if("good").alias("positives"), F.count(F.lit(1)).alias("everyone"))
        .orderBy("place")
        .collect()
    )
    g, positives, everyone = np.array([tuple(r) for r in found], dtype=float).reshape(-1, 3).T
    return g / GRID, positives, everyone


def across_halves(
    rows: DataFrame, borders: list[np.ndarray], prior: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``count_scores`` of all rows, each half scored by a fit of the other.

    The halves go by features, so that copies lie in one half.
    """
    halves = [rows.filter(F.pmod(F.xxhash64("__f"), F.lit(2)) == k) for k in (0, 1)]
    total: dict[float, np.ndarray] = {}
    for mine, other in (halves, halves[::-1]):
        for place, *n in zip(*count_scores(other, borders, train(mine, borders, prior))):
            total[place] = total.get(place, 0.0) + np.array(n)
    g = np.array(sorted(total))
    counts = np.array([total[place] for place in g]).reshape(-1, 2)
    return g, counts[:, 0], counts[:, 1]


def estimate_prior(positives: np.ndarray, everyone: np.ndarray) -> float:
    """Share of good documents, from counts of positives and of all rows by rising score."""
    n_p, n_u = positives.sum(), everyone.sum()
    if not n_p:
        return FIRST_PRIOR
    above_p = np.cumsum(positives[::-1]) / n_p
    above_u = np.cumsum(everyone[::-1]) / n_u
    some = above_p > 0
    above_p, above_u = above_p[some], above_u[some]
    error = np.sqrt(np.log(4 / DOUBT) / 2) * (n_p**-0.5 + n_u**-0.5)
    best = np.argmin((above_u + error) / above_p)
    return float(min(above_u[best] / above_p[best], 1.0))


def stretch(rows: DataFrame, borders: list[np.ndarray], weights: np.ndarray) -> tuple[float, float]:
    """``(slope, shift)`` of the curve from ``g`` to the chance of a good document.

    Fitted on counts of labelled rows by ``g`` in steps of ``1 / GRID``; without
    labels of both kinds ``g`` stays as it is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = np.clip(linear_scores(batch.column("__f"), borders, weights), -50, 50)
            place = pa.array(np.rint(g * GRID).astype(np.int64))
            yield pa.RecordBatch.from_arrays([place, batch.column("__q")], names=["place", "q"])

    labelled = rows.filter("__q in (0, 1)").select("__f", F.col("__q").cast("int").alias("__q"))
    # at most 100 * GRID places of two kinds
    found = labelled.mapInArrow(run, "place bigint, q int").groupBy("place", "q").count().collect()
    good, bad = (sum(r["count"] for r in found if r.q == k) for k in (1, 0))
    if not good or not bad:
        return 1.0, 0.0
    found.sort(key=lambda r: (r.place, r.q))
    g = np.array([r.place / GRID for r in found])
    n = np.array([r["count"] for r in found], dtype=float)
    target = np.where(np.array([r.q for r in found]) == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack((g, np.ones_like(g)), axis=1)
    p = np.array([1.0, 0.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(np.clip(-(x @ p), -500, 500)))
        curve = (x * (n * s * (1 - s))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (n * (s - target)))
        p = p - step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted``.

    ``score`` is the chance that a document is good, ``predicted`` is 1 from
    ``GOOD`` on. ``labels`` holds ``doc_id`` and ``quality``, labels of the
    held-out fold are never read, nor an id's contradicting labels. Without
    positives every score is 0.5. Null and empty texts have all features zero;
    rows with null or repeated ids are scored as they are. Other columns are
    ignored.
    """
    featured = staged(add_features(docs, id_col, text_col), "quality-features")
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min("quality").alias("__q"), F.max("quality").alias("__most"))
        .filter(F.col("__q") == F.col("__most"))
    )
    rows = staged(
        featured.join(known.select("__id", "__q"), "__id", "left").select(
            "__f", F.coalesce(F.col("__q") == 1, F.lit(False)).alias("__good"), "__q"
        ),
        "quality-rows",
    )
    names = [f"f{k}" for k in range(len(FEATURES))]
    flat = rows.select(*(F.col("__f")[k].alias(n) for k, n in enumerate(names)))
    borders = [np.unique(b) for b in flat.approxQuantile(names, list(QUANTILES), QUANTILE_ERROR)]
    _, positives, everyone = across_halves(rows, borders, FIRST_PRIOR)
    prior = estimate_prior(positives, everyone)
    weights = train(rows, borders, prior)
    slope, shift = stretch(rows, borders, weights)
    kind = featured.schema["__id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = slope * linear_scores(batch.column("__f"), borders, weights) + shift
            score = 1 / (1 + np.exp(np.clip(-g, -500, 500)))
            columns = [batch.column("__id"), batch.column("__held"), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "held_out", "score"])

    return featured.mapInArrow(run, f"__id {kind}, held_out boolean, score double").select(
        F.col("__id").alias(id_col),
        "held_out",
        "score",
        (F.col("score") >= F.lit(GOOD)).cast("int").alias("predicted"),
    )
