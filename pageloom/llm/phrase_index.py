"""Test items found in training texts through a positional inverted index.

Every slice of documents becomes one segment of the index: for each word that the
test items hold, the ascending positions of its occurrences, documents laid end
to end. Segments are rows of a table in the shared folder, dealt like the
documents, so a frequent word is spread over all tasks and postings never move.
A phrase is searched from its rarest words: their lists, each moved by the
word's place in the phrase, are intersected one after the other, rarest first;
what is left is exact. Windows that overlap share a search. Near matches take
the rarest word of a window and ask the lists of its other words for an
occurrence close by.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import staged
from pageloom.llm.items import item_blocks
from pageloom.llm.words import numbered, slices, word_lists

#: Words of a window.
WORDS = 10


def build_index(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """Segments ``(segment, ids, sizes, terms, counts, gaps)`` of whole texts.

    ``sizes`` counts the words of each document, ``terms`` numbers the words of
    the vocabulary that occur, ``counts`` their occurrences; ``gaps`` holds, term
    by term, the first position and the distances between positions.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = read.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                numbers, first = numbered(part.column("text"), vocabulary)
                at = np.flatnonzero(numbers >= 0)
                at = at[np.argsort(numbers[at], kind="stable")]
                terms, begins, counts = np.unique(numbers[at], return_index=True, return_counts=True)
                gaps = np.diff(at, prepend=0)
                gaps[begins] = at[begins]
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([segment], pa.int64()),
                        "ids": pa.ListArray.from_arrays(
                            pa.array([0, part.num_rows], pa.int32()), part.column("id")
                        ),
                        "sizes": pa.array([np.diff(first).astype(np.int32)]),
                        "terms": pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
                        "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                        "gaps": pa.array([gaps.astype(np.int32).tobytes()]),
                    }
                )
                segment += 1

    return read.mapInArrow(
        run,
        f"segment bigint, ids array<{id_type}>, sizes array<int>, terms array<int>, counts array<int>, gaps binary",
    )


def occurrences(index: DataFrame, words: int) -> np.ndarray:
    """Occurrences of each of ``words`` numbered words in the whole index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words, dtype=np.int64)
        for batch in batches:
            terms, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            np.add.at(total, terms, counts)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen, pa.int32()), "n": pa.array(total[seen])})

    rows = index.select("terms", "counts").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n"))
    out = np.zeros(words, dtype=np.int64)
    for term, n in rows.collect():
        out[term] = n
    return out


class Searches:
    """What to look for: groups of overlapping windows that share their rarest word.

    A group ``(pattern, a, b)`` stands for the windows of a pattern that start at
    words a to b; all of them hold the words b to a + size - 1.
    """

    def __init__(self, patterns: Sequence[np.ndarray], words: int, rarity: np.ndarray) -> None:
        self.patterns, self.words, self.rarity = patterns, words, rarity
        self.groups: list[tuple[int, int, int, int]] = []
        for p, pattern in enumerate(patterns):
            size = min(words, len(pattern))
            last = None
            for i in range(len(pattern) - size + 1):
                rarest = i + int(np.argmin(rarity[pattern[i : i + size]]))
                if last is not None and rarest == last:
                    q, a, _, s = self.groups[-1]
                    self.groups[-1] = (q, a, i, s)
                else:
                    self.groups.append((p, i, i, size))
                last = rarest
        # Words that all windows of a group hold, as a ragged list.
        common = [patterns[p][b : a + s] for p, a, b, s in self.groups]
        self.common = np.concatenate(common) if common else np.zeros(0, dtype=np.int64)
        self.starts = np.cumsum([0] + [len(c) for c in common])[:-1]

    def possible(self, present: np.ndarray) -> np.ndarray:
        """Groups whose shared words all occur in a segment."""
        if not len(self.groups):
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(np.logical_and.reduceat(present[self.common], self.starts))


class Segment:
    """Posting lists of one segment."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, gaps: bytes, words: int) -> None:
        self.first = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        ends = np.cumsum(counts, dtype=np.int64)
        steps = np.frombuffer(gaps, dtype=np.int32).astype(np.int64)
        upto = np.cumsum(steps)
        before = np.concatenate(([0], upto))[ends - counts]
        self.places = upto - np.repeat(before, counts)
        self.begin = np.zeros(words, dtype=np.int64)
        self.end = np.zeros(words, dtype=np.int64)
        self.begin[terms], self.end[terms] = ends - counts, ends
        self.present = self.end > self.begin

    def postings(self, term: int) -> np.ndarray:
        """Ascending positions of a word."""
        return self.places[self.begin[term] : self.end[term]]

    def holds(self, term: int, at: np.ndarray) -> np.ndarray:
        """Whether the word stands at each of the positions."""
        places = self.postings(term)
        if not len(places):
            return np.zeros(len(at), dtype=bool)
        found = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return places[found] == at

    def within_one(self, start: np.ndarray, size: int) -> np.ndarray:
        """Whether each run of ``size`` positions lies in one document."""
        doc = np.searchsorted(self.first, start, side="right") - 1
        return start + size <= self.first[doc + 1]

    def phrases(self, search: Searches) -> Iterator[tuple[int, np.ndarray, int]]:
        """``(pattern, starts, size)`` of all windows that occur."""
        for g in search.possible(self.present):
            p, a, b, size = search.groups[g]
            pattern = search.patterns[p]
            order = b + np.argsort(search.rarity[pattern[b : a + size]], kind="stable")
            starts = self.postings(pattern[order[0]]) - order[0]  # of the pattern's first word
            for k in order[1:]:
                if not len(starts):
                    break
                starts = starts[self.holds(pattern[k], starts + k)]
            if not len(starts):
                continue
            stands = np.ones((b + size - a, len(starts)), dtype=bool)
            for k in (*range(a, b), *range(a + size, b + size)):
                stands[k - a] = self.holds(pattern[k], starts + k)
            for i in range(a, b + 1):
                found = starts[stands[i - a : i - a + size].all(axis=0)] + i
                found = found[self.within_one(found, size)]
                if len(found):
                    yield p, found, size

    def near(self, search: Searches, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(pattern, documents)`` that hold the words of a window close together.

        Every word of the window stands at most ``reach`` words away from one
        occurrence of its rarest word, in the same document.
        """
        for p, pattern in enumerate(search.patterns):
            size = min(search.words, len(pattern))
            for i in range(len(pattern) - size + 1):
                terms = np.unique(pattern[i : i + size])
                if not self.present[terms].all():
                    continue
                terms = terms[np.argsort(search.rarity[terms], kind="stable")]
                at = self.postings(terms[0])
                doc = np.searchsorted(self.first, at, side="right") - 1
                low = np.maximum(at - reach, self.first[doc])
                high = np.minimum(at + reach, self.first[doc + 1] - 1)
                for term in terms[1:]:
                    places = self.postings(term)
                    after = np.searchsorted(places, low)
                    good = after < len(places)
                    good[good] = places[after[good]] <= high[good]
                    doc, low, high = doc[good], low[good], high[good]
                    if not len(doc):
                        break
                if len(doc):
                    yield p, np.unique(doc)


def _found(index: DataFrame, search: Searches, names: list[list[str]], words: int, reach: int | None) -> DataFrame:
    """``(segment, row, spans, items, near)`` of the documents that hold something."""
    schema = (
        "segment bigint, row int, spans array<struct<start: int, stop: int>>, items array<string>, near array<string>"
    )

    def lists(pairs: set[tuple[int, int]], rows: np.ndarray) -> list[list[str]]:
        by_row: dict[int, set[str]] = {int(r): set() for r in rows}
        for row, pattern in pairs:
            by_row[row].update(names[pattern])
        return [sorted(by_row[int(r)]) for r in rows]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, terms, counts = (
                    batch.column(c)[k].values.to_numpy() for c in ("sizes", "terms", "counts")
                )
                here = Segment(sizes, terms, counts, batch.column("gaps")[k].as_py(), words)
                change = np.zeros(here.first[-1] + 1, dtype=np.int64)
                exact: set[tuple[int, int]] = set()
                for p, starts, size in here.phrases(search):
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + size, -1)
                    docs = np.unique(np.searchsorted(here.first, starts, side="right") - 1)
                    exact.update((d, p) for d in docs.tolist())
                near: set[tuple[int, int]] = set()
                if reach is not None:
                    near = {(d, p) for p, docs in here.near(search, reach) for d in docs.tolist()}
                rows = np.array(sorted({d for d, _ in exact} | {d for d, _ in near}), dtype=np.int64)
                if not len(rows):
                    continue
                covered = np.cumsum(change)[:-1] > 0
                spans = []
                for row in rows:
                    edges = np.diff(covered[here.first[row] : here.first[row + 1]].astype(np.int8), prepend=0, append=0)
                    spans.append(
                        [
                            {"start": a, "stop": b}
                            for a, b in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist())
                        ]
                    )
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([batch.column("segment")[k].as_py()] * len(rows), pa.int64()),
                        "row": pa.array(rows, pa.int32()),
                        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                        "items": pa.array(lists(exact, rows), pa.list_(pa.string())),
                        "near": pa.array(lists(near, rows), pa.list_(pa.string())),
                    }
                )

    return index.select("segment", "sizes", "terms", "counts", "gaps").mapInArrow(run, schema)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    words: int = WORDS,
    reach: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col, n_words, spans, items, near``.

    ``spans`` are the merged ranges ``[start, stop)`` of words inside any
    occurrence of ``words`` consecutive words of an item (all of them, of a
    shorter item); ``items`` the ids, as sorted strings, of the items with such an
    occurrence. ``near`` lists the items with a window whose words all stand at
    most ``reach`` words from one occurrence of its rarest word, in any order; it
    is empty where ``reach`` is None.

    Null and empty texts have no words and no matches; items without words match
    nothing, an item with a null id is named ``null``. Repeated documents are rows
    of their own, repeated items count once. Without documents there are no rows,
    without items no matches. Other columns are ignored. Items are searched in
    blocks of bounded size, one index of the documents each.
    """
    none = F.array().cast("array<string>")
    no_spans = F.array().cast("array<struct<start: int, stop: int>>")
    parts, rows = [], None
    for block in item_blocks(items, item_col, item_text_col):
        lists = word_lists([r["text"] for r in block])
        distinct = sorted({w for ws in lists for w in ws})
        number = {w: k for k, w in enumerate(distinct)}
        names: dict[tuple[int, ...], set[str]] = {}
        for r, ws in zip(block, lists):
            if ws:
                key = tuple(number[w] for w in ws)
                names.setdefault(key, set()).add("null" if r["id"] is None else str(r["id"]))
        patterns = [np.array(p, dtype=np.int64) for p in names]
        index = staged(
            build_index(docs, pa.array(distinct, pa.binary()), id_col, text_col), "phrase-index"
        )
        search = Searches(patterns, words, occurrences(index, len(distinct)))
        parts.append(_found(index, search, [sorted(n) for n in names.values()], len(distinct), reach))
        rows = index.select("segment", "ids", "sizes") if rows is None else rows
    if rows is None:
        index = build_index(docs, pa.array([], pa.binary()), id_col, text_col)
        return index.select(F.inline(F.arrays_zip("ids", "sizes"))).select(
            F.col("ids").alias(id_col),
            F.col("sizes").cast("long").alias("n_words"),
            no_spans.alias("spans"),
            none.alias("items"),
            none.alias("near"),
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # A document has one row a block at most.
    found = found.groupBy("segment", "row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
    )
    every = rows.select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("row", "one"))
    return every.join(found, ["segment", "row"], "left").select(
        F.col("one.ids").alias(id_col),
        F.col("one.sizes").cast("long").alias("n_words"),
        F.coalesce(merged("spans"), no_spans).alias("spans"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near", none).alias("near"),
    )


def merged(spans: str) -> Column:
    """Sorted spans, those that touch or overlap joined."""
    kind = "array<struct<start: int, stop: int>>"

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))),
        )
        apart = (F.size(done) == 0) | (last["stop"] < span["start"])
        return F.when(apart, F.concat(done, F.array(span))).otherwise(joined).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def contamination(docs: DataFrame, items: DataFrame, words: int = WORDS, **columns: str) -> DataFrame:
    """``find_items`` as counts and a digest: ``n_hit, n_items, items_sha256, contaminated``.

    Same rows and rules as :func:`find_items`, whose ``columns`` it takes; the digest
    is of the ids joined by commas, of the empty string where there are none.
    """
    found = find_items(docs, items, words, **columns)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        columns.get("id_col", "doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
