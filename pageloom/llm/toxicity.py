"""Toxicity as an ordinal grade: cumulative-link regression on sparse text features.

Features are words and beginnings of words that labelled toxic documents use
more than others. Severity grades are 0 for clean documents and 1 to 3 for toxic
ones by how much of such terms they hold. The chance of a grade above ``k`` is
``sigmoid(w . x - threshold_k)`` with one weight vector shared by all thresholds,
which are kept in order; their sum is the expected severity.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents, chosen by a
hash of their ids; every document is scored on its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import staged

#: Labelled documents a model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Terms a model has, at most, and documents a term is in, at least.
TERMS = 4096
SUPPORT = 5
#: A term is used if its share of toxic documents is at least so many times its share of clean ones.
LIFT = 8.0
#: Characters of the beginnings of words that are terms.
BEGINNINGS = (4, 5, 6)
#: Grades above 0.
GRADES = 3
#: Weight decay, and steps of the fit.
DECAY = 1e-3
STEPS = 400
#: Pieces between spaces whose terms one Python worker keeps.
KEPT_PIECES = 150_000

WORD = re.compile(r"\w+")


def terms_of(piece: str) -> list[str]:
    """Terms of a lower-cased piece of text: its words and their beginnings."""
    out = []
    for word in WORD.findall(piece):
        out.append("=" + word)
        out += [word[:n] for n in BEGINNINGS if len(word) > n]
    return out


@dataclass
class Model:
    """Weights by term and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: list[float]
    least: float = 0.5  # chance of any severity from which on a document is toxic

    def severities(self, texts: Iterable[str | None], kept: dict[str, float]) -> list[tuple[float, float]]:
        """``(expected severity, chance of any)`` of each text.

        ``kept`` remembers the weight of pieces from call to call.
        """
        out = []
        for text in texts:
            pieces = (text or "").lower().split()
            distinct = set(pieces)
            for piece in distinct.difference(kept):
                kept[piece] = self.weight(piece)
            hot = {p for p in distinct if kept[p]}
            total = 0.0
            if hot:
                counts = Counter(p for p in pieces if p in hot)
                total = sum(kept[p] * (1 + math.log(n)) for p, n in sorted(counts.items()))
            above = [1 / (1 + math.exp(min(700.0, t - total))) for t in self.thresholds]
            out.append((sum(above), above[0] if above else 0.0))
            if len(kept) > KEPT_PIECES:
                kept.clear()
        return out

    def weight(self, piece: str) -> float:
        """Sum of the weights of a piece's terms."""
        return sum(self.weights.get(t, 0.0) for t in terms_of(piece))


def fit_cumulative(
    rows: np.ndarray, terms: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative logit model.

    ``rows, terms, values`` are the entries of the sparse features. Thresholds
    are the first plus positive gaps, so they stay in order. Full-batch Adam on
    the mean log loss of the ordered cuts.
    """
    n = len(grades)
    target = (grades[:, None] > np.arange(GRADES)).astype(float)
    rate = np.clip(target.mean(axis=0), 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(rate / (1 - rate)))
    gaps = np.log(np.expm1(np.maximum(np.diff(start), 1e-2)))
    p = np.concatenate((np.zeros(width), [start[0]], gaps))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, first, raw = p[:width], p[width], p[width + 1 :]
        gap = np.logaddexp(0, raw)
        cuts = first + np.concatenate(([0.0], np.cumsum(gap)))
        score = np.bincount(rows, values * w[terms], n)
        above = 1 / (1 + np.exp(np.clip(cuts - score[:, None], -500, 500)))
        off = (above - target) / n
        g_score = off.sum(axis=1)
        g_cuts = -off.sum(axis=0)
        g_w = np.bincount(terms, values * g_score[rows], width) + DECAY * w / max(1, width)
        g_raw = g_cuts[::-1].cumsum()[::-1][1:] / (1 + np.exp(-raw))
        g = np.concatenate((g_w, [g_cuts.sum()], g_raw))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    gap = np.logaddexp(0, p[width + 1 :])
    return p[:width], p[width] + np.concatenate(([0.0], np.cumsum(gap)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(__text, __toxic)`` of at most ``rows`` labelled documents, by a hash of their ids.

    An id with labels of both kinds or none is left out; one document of a
    repeated id is taken. At most ``rows`` ids are broadcast.
    """
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("__toxic"), F.max("toxic").alias("__most"))
        .filter(F.col("__toxic") == F.col("__most"))
        .select(F.col("doc_id").alias("__id"), "__toxic")
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    return (
        texts.join(F.broadcast(chosen), "__id")
        .groupBy("__id", "__toxic")
        .agg(F.min("__text").alias("__text"))
        .select("__text", "__toxic")
    )


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with one document of near copies, and a mark of each document.

    Two documents of which most 5-word passages agree have the same smallest
    passage hash with the same chance; either of two hashes tells. Terms of a
    text that is copied often would look like terms of its label.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows: list[list[int]] = [[], []]
            for text in batch.column("__text").to_pylist():
                words = (text or "").lower().encode().split()
                shingles = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
                for seed in range(2):
                    lows[seed].append(min(xxhash.xxh3_64_intdigest(s, seed) for s in shingles) >> 1)
            columns = [batch.column("__text"), batch.column("__toxic")]
            columns += [pa.array(x, pa.int64()) for x in lows]
            yield pa.RecordBatch.from_arrays(columns, names=["__text", "__toxic", "__mark", "__other"])

    schema = "__text string, __toxic int, __mark bigint, __other bigint"
    marked = sample.mapInArrow(run, schema)
    for key in ("__mark", "__other"):
        first = F.min(F.struct("__toxic", "__text", "__mark", "__other")).alias("d")
        marked = marked.groupBy(F.col(key).alias("__by")).agg(first).select("d.*")
    return marked


def term_counts(sample: DataFrame) -> DataFrame:
    """``(term, toxic, clean)``: documents with each term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("__text").to_pylist(), batch.column("__toxic").to_pylist()):
                pieces = set((text or "").lower().split())
                counts[0 if toxic else 1].update(set(chain.from_iterable(map(terms_of, pieces))))
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array([counts[0][t] for t in names], pa.int64()),
                    pa.array([counts[1][t] for t in names], pa.int64()),
                ],
                names=["term", "toxic", "clean"],
            )

    return sample.mapInArrow(run, "term string, toxic bigint, clean bigint")


def best_cut(score: np.ndarray, positive: np.ndarray) -> float:
    """Middle of the widest gap of scores among the cuts of the best F1."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(positive[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + positive.sum())
    last = np.append(s[1:] < s[:-1], False)  # cuts lie between different scores
    if not last.any():
        return 0.0
    f1 = np.where(last, f1, -1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax(s[best] - s[best + 1])]
    return float((s[k] + s[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled documents; without toxic ones nothing is toxic."""
    sample = staged(without_copies(labelled_sample(docs, labels, rows)), "toxic-sample")
    sizes = dict(sample.groupBy("__toxic").count().collect())
    toxic, clean = sum(v for k, v in sizes.items() if k), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, [50.0] * GRADES)
    counted = term_counts(sample).groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    share_t, share_c = F.col("t") / F.lit(float(toxic)), (F.col("c") + 0.5) / F.lit(float(clean))
    whole = (F.col("t") + F.col("c")) / F.lit(float(toxic + clean))
    picked = (
        counted.filter((F.col("t") >= SUPPORT) & (share_t >= LIFT * share_c))
        .withColumn("z", (share_t - share_c) / F.sqrt(whole + F.lit(5.0 / (toxic + clean))))
        .orderBy(F.desc("z"), "term")
        .limit(TERMS)
    )
    terms = {r.term: k for k, r in enumerate(picked.select("term").collect())}

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, values = [], []
            for text in batch.column("__text").to_pylist():
                pieces = Counter((text or "").lower().split())
                row: dict[int, float] = {}
                for piece, n in sorted(pieces.items()):
                    for term in terms_of(piece):
                        if term in terms:
                            row[terms[term]] = row.get(terms[term], 0.0) + 1 + math.log(n)
                found.append(list(row))
                values.append(list(row.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__mark"),
                    batch.column("__toxic"),
                    pa.array(found, pa.list_(pa.int32())),
                    pa.array(values, pa.list_(pa.float64())),
                ],
                names=["__mark", "toxic", "terms", "amounts"],
            )

    # at most SAMPLE_ROWS rows, in which few terms occur
    data = (
        sample.mapInArrow(
            entries, "__mark bigint, toxic int, terms array<int>, amounts array<double>"
        )
        .toArrow()
        .sort_by("__mark")
    )
    lists = [(t, a) for t, a in zip(data["terms"].to_pylist(), data["amounts"].to_pylist())]
    is_toxic = np.array(data["toxic"].to_pylist()) > 0
    rows_at = np.repeat(np.arange(len(lists)), [len(t) for t, _ in lists])
    terms_at = np.array(list(chain.from_iterable(t for t, _ in lists)), dtype=np.int64)
    values = np.array(list(chain.from_iterable(a for _, a in lists)))
    amount = np.bincount(rows_at, values, len(lists))
    marked = amount[is_toxic & (amount > 0)]
    cuts = np.quantile(marked, [1 / 3, 2 / 3]) if len(marked) else np.zeros(2)
    grades = np.where(is_toxic, 1 + (amount > cuts[0]) + (amount > cuts[1]), 0)
    weights, thresholds = fit_cumulative(rows_at, terms_at, values, grades, len(terms))
    names = sorted(terms, key=terms.get)
    score = np.bincount(rows_at, values * weights[terms_at], len(lists)) - thresholds[0]
    least = 1 / (1 + math.exp(-best_cut(score, is_toxic)))
    return Model(dict(zip(names, weights.tolist())), thresholds.tolist(), least)


def scored(docs: DataFrame, model: Model, keep: Callable[[float], bool] | None = None) -> DataFrame:
    """``docs`` with ``expected_severity`` and ``toxic_chance``; with ``keep`` the
    rows of a chance it accepts, without the two."""
    names = docs.columns
    added = [("expected_severity", pa.float64()), ("toxic_chance", pa.float64())]
    schema = docs.schema
    if keep is None:
        schema = docs.withColumns({n: F.lit(0.0) for n, _ in added}).schema
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # TERMS weights at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, float] = {}
        for batch in batches:
            found = shared.value.severities(batch.column(names.index("text")).to_pylist(), kept)
            if keep is not None:
                yield batch.filter(pa.array([keep(c) for _, c in found], pa.bool_()))
                continue
            columns = list(batch.columns)
            columns += [pa.array([f[k] for f in found], pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(n for n, _ in added)])

    return docs.mapInArrow(run, schema)


def grade_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, expected_severity, toxic_chance, grade, toxic``.

    ``grade`` is the expected severity rounded, ``toxic`` whether the chance of any
    severity reaches the cut that parts the sample best. A null or empty text has no features and is judged by
    the thresholds alone. Rows with null or repeated ids are graded as they are;
    other columns are ignored. Without labels of both kinds nothing is toxic.
    """
    read = docs.select("doc_id", "text")
    model = fit(read, labels, rows)
    out = scored(read, model).drop("text")
    return out.withColumns(
        {
            "grade": F.round("expected_severity").cast("int"),
            "toxic": (F.col("toxic_chance") >= F.lit(model.least)).cast("int"),
        }
    )


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the toxic ones, columns as before."""
    model = fit(docs.select("doc_id", "text"), labels, rows)
    return scored(docs, model, keep=lambda chance: chance < model.least)


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given labels."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "toxic")
