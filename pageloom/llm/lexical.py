"""Best documents of each query by integer impact scores, in buckets by length.

A document is a sparse vector of impacts over the queries' words, a query one of
word weights; the score is their product. Documents are sorted by the length of
their vectors and cut into buckets of similar length, each stored with its
posting lists. A bucket is skipped for a query where the query's length times
the bucket's largest (Cauchy-Schwarz), or its weights times the bucket's largest
coordinates, can't reach the score of the query's ``count``-th best document so
far. Inside a bucket only documents are looked at that hold one of the focus
words, without which the rest can't reach it either; what they gain on those,
and at most can gain on the rest by coordinates and by Cauchy-Schwarz, filters
them again. Survivors are scored anew in 64-bit integers. One document in 16, by a
hash, is searched first, so that the others start with a score to reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from pageloom.llm.common import staged
from pageloom.llm.items import item_blocks
from pageloom.llm.words import numbered, slices, word_lists

#: Documents of a bucket at most, and the shortest vector's share of the longest.
BUCKET_ROWS = 4096
BUCKET_SPAN = 0.9
#: One document in so many is searched first.
SCOUTS = 16
#: Fixed values of the score: scale of impacts and weights, saturation, length share in percent.
SCALE, WEIGHT, DAMP, SHARE = 1_000_000_000, 1000, 20, 50
#: Room for rounding where a bound in doubles is compared with a score.
SLACK = 1e-9


def term_vectors(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, tfs)``: words of each whole text and its counts over the vocabulary.

    ``terms`` are ascending int32 numbers and ``tfs`` int64 counts, as bytes.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = read.schema["id"].dataType.simpleString()
    width = max(1, len(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                numbers, first = numbered(part.column("text"), vocabulary)
                sizes = np.diff(first)
                rows = np.repeat(np.arange(part.num_rows, dtype=np.int64), sizes)
                known = numbers >= 0
                keys, counts = np.unique(rows[known] * width + numbers[known], return_counts=True)
                cuts = np.searchsorted(keys, np.arange(part.num_rows + 1) * width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(sizes, pa.int64()),
                        packed((keys % width).astype(np.int32), cuts),
                        packed(counts.astype(np.int64), cuts),
                    ],
                    names=["id", "n", "terms", "tfs"],
                )

    return read.mapInArrow(run, f"id {id_type}, n bigint, terms binary, tfs binary")


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column whose row k holds ``values[cuts[k]:cuts[k + 1]]``."""
    offsets = pa.py_buffer((cuts * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(values)])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column and where each row's start."""
    rows = column.to_pylist()
    sizes = np.array([len(r) for r in rows], dtype=np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), dtype=kind), np.concatenate(([0], np.cumsum(sizes)))


def document_counts(vectors: DataFrame, words: int) -> np.ndarray:
    """Documents that hold each of ``words`` numbered words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words, dtype=np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column("terms"), np.int32)[0], minlength=words)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen, pa.int32()), "n": pa.array(total[seen])})

    rows = vectors.select("terms").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n"))
    out = np.zeros(words, dtype=np.int64)
    for term, n in rows.collect():
        out[term] = n
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Weight of each word by the documents that hold it."""
    return np.array(
        [math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64
    )


def impact_vectors(vectors: DataFrame, documents: int, words: int) -> DataFrame:
    """``(id, length, terms, impacts)`` of the documents that hold a word of the vocabulary."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tfs, cuts = unpacked(batch.column("tfs"), np.int64)
            n = batch.column("n").to_numpy()
            damp = DAMP * (100 - SHARE + SHARE * n * documents // words)
            impacts = SCALE * tfs // (1000 * tfs + np.repeat(damp, np.diff(cuts)))
            square = np.concatenate(([0.0], np.cumsum(impacts.astype(float) ** 2)))
            length = np.sqrt(square[cuts[1:]] - square[cuts[:-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(length), batch.column("terms"), packed(impacts, cuts)],
                names=["id", "length", "terms", "impacts"],
            )

    some = vectors.filter(F.octet_length("terms") > 0)
    return some.mapInArrow(run, f"id {id_type}, length double, terms binary, impacts binary")


def norm_buckets(impacts: DataFrame, span: float, rows: int) -> DataFrame:
    """Buckets ``(longest, scout, ids, lengths, terms, counts, docs, impacts)``, longest first.

    Documents are range-sorted by length; many of one length are spread by a hash.
    A bucket lists its words with, for each, the documents that hold it. One document
    in ``SCOUTS``, by the hash, lies in buckets of its own, the scouts.
    """
    id_type = impacts.schema["id"].dataType.simpleString()
    spread = F.xxhash64("id", "terms", "impacts")
    ordered = (
        impacts.withColumn("scout", F.pmod(spread, F.lit(SCOUTS)) == 0)
        .repartitionByRange("scout", F.desc("length"), spread)
        .sortWithinPartitions("scout", F.desc("length"))
    )

    def bucket(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        terms, cuts = unpacked(table["terms"].combine_chunks(), np.int32)
        values, _ = unpacked(table["impacts"].combine_chunks(), np.int64)
        docs = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(cuts))
        order = np.argsort(terms, kind="stable")
        words, counts = np.unique(terms, return_counts=True)
        lengths = table["length"].to_numpy()
        ids = table["id"].combine_chunks()
        return pa.RecordBatch.from_pydict(
            {
                "longest": pa.array([lengths.max()]),
                "scout": parts[0].column("scout").slice(0, 1),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "lengths": pa.array([lengths.tobytes()]),
                "terms": pa.array([words.astype(np.int32).tobytes()]),
                "counts": pa.array([counts.astype(np.int32).tobytes()]),
                "docs": pa.array([docs[order].tobytes()]),
                "impacts": pa.array([values[order].astype(np.int32).tobytes()]),
            }
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, longest, scout = 0, 0.0, False
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            scouts = batch.column("scout").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(lengths):
                if not count:
                    longest, scout = lengths[at], scouts[at]
                room = lengths[at : at + rows - count]
                like = (room >= span * longest) & (scouts[at : at + rows - count] == scout)
                fits = len(room) if like.all() else int(np.argmin(like))
                if fits:
                    held.append(batch.slice(at, fits))
                    count, at = count + fits, at + fits
                if count == rows or fits < len(room):
                    yield bucket(held)
                    held, count = [], 0
        if count:
            yield bucket(held)

    return ordered.mapInArrow(
        run,
        f"longest double, scout boolean, ids array<{id_type}>, lengths binary, terms binary, counts binary, "
        "docs binary, impacts binary",
    )


class Queries:
    """Words and weights of all queries of a block, one after the other."""

    def __init__(self, terms: Sequence[np.ndarray], weight: np.ndarray) -> None:
        self.terms = [t[weight[t] > 0] for t in terms]
        self.weights = [weight[t] for t in self.terms]
        self.flat = np.concatenate([*self.terms, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(terms)), [len(t) for t in self.terms])
        self.flat_weights = weight[self.flat].astype(float)
        self.lengths = np.sqrt(np.bincount(self.owner, self.flat_weights**2, minlength=len(terms)))
        self.words = len(weight)

    def open(self, longest: float, largest: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Queries that a bucket may hold a document for, by both bounds."""
        coordinates = np.bincount(
            self.owner, self.flat_weights * largest[self.flat], minlength=len(self.terms)
        )
        bound = np.minimum(coordinates, self.lengths * longest) * (1 + SLACK)
        return np.flatnonzero((bound >= reach) & (coordinates > 0))


class Bucket:
    """Posting lists of a bucket's documents."""

    def __init__(self, lengths: np.ndarray, terms, counts, docs, impacts, words: int) -> None:
        self.lengths, self.docs, self.impacts = lengths, docs, impacts.astype(np.int64)
        ends = np.cumsum(counts, dtype=np.int64)
        self.begin = np.zeros(words, dtype=np.int64)
        self.end = np.zeros(words, dtype=np.int64)
        self.begin[terms], self.end[terms] = ends - counts, ends
        self.largest = np.zeros(words)
        self.largest[terms] = np.maximum.reduceat(self.impacts, ends - counts)

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the posting entries of some words, and how many each word has."""
        begin, sizes = self.begin[terms], self.end[terms] - self.begin[terms]
        shift = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        return np.arange(len(shift)) + shift, sizes

    def search(self, terms: np.ndarray, weight: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """``(documents, scores)`` of at least ``reach``; others may be left out or not."""
        bounds = weight * self.largest[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0.0) * (1 + SLACK)
        focus = int(np.count_nonzero(rest[:-1] >= reach))  # without these, the rest falls short
        first, later = order[:focus], order[focus:]
        at, sizes = self.entries(terms[first])
        docs, value = self.docs[at], self.impacts[at]
        n = len(self.lengths)
        gain = np.bincount(docs, np.repeat(weight[first], sizes) * value, minlength=n)
        some = np.flatnonzero(gain)
        if len(later):
            seen = np.bincount(docs, value.astype(float) ** 2, minlength=n)[some]
            left = np.sqrt(np.maximum(self.lengths[some] ** 2 * (1 + SLACK) - seen, 0))
            more = np.minimum(rest[focus], left * math.sqrt(float((weight[later].astype(float) ** 2).sum())))
            some = some[(gain[some] + more) * (1 + SLACK) >= reach]
        else:
            some = some[gain[some] * (1 + SLACK) >= reach]
        place = np.full(n, -1)
        place[some] = np.arange(len(some))
        at, sizes = self.entries(terms[order])
        owner = place[self.docs[at]]
        mine = owner >= 0
        scores = np.zeros(len(some), dtype=np.int64)
        np.add.at(scores, owner[mine], (np.repeat(weight[order], sizes) * self.impacts[at])[mine])
        good = scores >= reach
        return some[good], scores[good]


def search_buckets(buckets: DataFrame, queries: Queries, reach: np.ndarray, count: int) -> DataFrame:
    """``(query, id, score)``: each task's ``count`` best of each query that reach its score."""
    id_type = buckets.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = reach.copy()
        best: dict[int, tuple[pa.Array, np.ndarray]] = {}
        kind = None
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for k in range(batch.num_rows):
                lengths, terms, counts, docs, impacts = (
                    np.frombuffer(batch.column(c)[k].as_py(), dtype=t)
                    for c, t in (("lengths", float), ("terms", np.int32), ("counts", np.int32),
                                 ("docs", np.int32), ("impacts", np.int32))
                )
                here = Bucket(lengths, terms, counts, docs, impacts, queries.words)
                ids = batch.column("ids")[k].values
                for q in queries.open(batch.column("longest")[k].as_py(), here.largest, least).tolist():
                    found, scores = here.search(queries.terms[q], queries.weights[q], int(least[q]))
                    if not len(found):
                        continue
                    names = ids.take(pa.array(found))
                    if q in best:
                        names = pa.concat_arrays([best[q][0], names])
                        scores = np.concatenate((best[q][1], scores))
                    if len(scores) > count:
                        keep = pc.sort_indices(
                            pa.table({"s": pa.array(scores), "i": names}),
                            sort_keys=[("s", "descending"), ("i", "ascending")],
                            null_placement="at_end",
                        )[:count]
                        names, scores = names.take(keep), scores[keep.to_numpy()]
                    if len(scores) == count:
                        least[q] = max(least[q], scores.min())
                    best[q] = (names, scores)
        if best:
            yield pa.RecordBatch.from_pydict(
                {
                    "query": pa.array(np.repeat(list(best), [len(s) for _, s in best.values()]), pa.int32()),
                    "id": pa.concat_arrays([n for n, _ in best.values()]).cast(kind),
                    "score": pa.array(np.concatenate([s for _, s in best.values()])),
                }
            )

    return buckets.mapInArrow(run, f"query int, id {id_type}, score bigint")


def ranked(found: DataFrame, count: int) -> DataFrame:
    """``found`` with ``rank``, the ``count`` best of each query: by score, then by id, null last."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    count: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``count`` highest-scoring documents of each item.

    A word weighs ``floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document scores the sum
    of weight times ``10^9 tf div (1000 tf + 20 m)`` over the item's distinct words,
    where ``m = 50 + 50 n N div L``; ``N`` counts the documents with words, ``L`` all
    their words, ``n`` the document's, ``tf`` the word's in it. Only scores above 0
    are returned, equal ones by ascending id, null last.

    Null and empty texts have no words: such documents count nowhere, such items
    have no rows. Repeated documents are rows of their own, repeated items count
    once, an item with a null id is searched like any other. Without documents or
    items there are no rows. Other columns are ignored. Items are searched in
    blocks of bounded size.
    """
    spark = docs.sparkSession
    out = None
    for block in item_blocks(items, item_col, item_text_col):
        part = _search_block(docs, block, items.schema[item_col].dataType, count, id_col, text_col, bucket_rows)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
        out = spark.createDataFrame([], f"item {kinds[0]}, rank int, id {kinds[1]}, score bigint")
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(
    docs: DataFrame, block: list[Row], item_type, count: int, id_col: str, text_col: str, bucket_rows: int
) -> DataFrame:
    """``(item, rank, id, score)`` of one block of items."""
    spark = docs.sparkSession
    lists = word_lists([r["text"] for r in block])
    distinct = sorted({w for ws in lists for w in ws})
    number = {w: k for k, w in enumerate(distinct)}
    names: dict[tuple[int, ...], int] = {}
    item_rows = []
    for r, ws in zip(block, lists):
        key = tuple(sorted({number[w] for w in ws}))
        item_rows.append((r["id"], names.setdefault(key, len(names))))
    vectors = staged(term_vectors(docs, pa.array(distinct, pa.binary()), id_col, text_col), "lexical-terms")
    total = vectors.filter("n > 0").agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    weight = weights(document_counts(vectors, len(distinct)), total["N"])
    queries = Queries([np.array(k, dtype=np.int64) for k in names], weight)
    impacts = staged(impact_vectors(vectors, total["N"], total["L"] or 1), "lexical-impacts")
    buckets = staged(norm_buckets(impacts, BUCKET_SPAN, bucket_rows), "lexical-buckets")
    reach = np.ones(len(names), dtype=np.int64)
    scouts = staged(ranked(search_buckets(buckets.filter("scout"), queries, reach, count), count), "lexical-scouts")
    for query, score in scouts.filter(F.col("rank") == count).select("query", "score").collect():
        reach[query] = score
    rest = search_buckets(buckets.filter("not scout"), queries, reach, count)
    best = ranked(scouts.drop("rank").unionByName(rest), count)
    kind = f"item {item_type.simpleString()}, query int"
    return best.join(F.broadcast(spark.createDataFrame(item_rows, kind)), "query").select(
        "item", "rank", "id", "score"
    )
