"""Token ids as Simple-8b coded blocks.

A 64-bit word holds a selector in its top 4 bits and, below it, as many ids as
the selector says, each in the same number of bits: 60 ids of 1 bit, 30 of 2,
and so on to one of 60. A slot of all ones is an escape: its id stands in the
block's escape list, so one large id needn't widen its neighbours. At every
position the selector with the fewest bits per id, escapes included, is taken.

A block is one binary value::

    "S8B2"  docs  ids  words  escapes  samples      4 + 5 * 4 bytes
    ids of each document                            docs * 4
    ids before every SAMPLE-th word                 samples * 4
    escapes before every SAMPLE-th word             samples * 4
    words                                           words * 8
    escapes                                         escapes * 4

all little-endian. Words are decoded selector by selector with array operations;
the sampled offsets let a reader of one document or range start at the word before
it (``read_range``). Blocks are written as rows of Parquet files, so that Spark's writer commits them, on any file system.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm.words import slices
from pageloom.session import scratch_path

MAGIC = b"S8B2"
HEADER = struct.Struct("<4s5I")
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Bytes of text encoded at once.
SLICE_BYTES = 4 << 20
#: Words between sampled offsets.
SAMPLE = 128
#: Pieces kept encoded by one Python worker; beyond, those that came once go.
KEPT_PIECES = 800_000

# Ids per word by selector; selectors 0 and 1 are not used.
COUNTS = [0, 0] + [n for n in range(60, 0, -1) if 60 // n > 60 // (n + 1)]
WIDTHS = [0, 0] + [60 // n for n in COUNTS[2:]]
COMMON = math.lcm(*COUNTS[2:])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, escapes)`` of an array of unsigned ids."""
    total = len(ids)
    if not total:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u4")
    padded = np.concatenate((ids.astype(np.uint64), np.zeros(60, dtype=np.uint64)))
    # narrowest slot of each id, as a place among the widths
    marks = np.array([(1 << w) - 1 for w in WIDTHS[2:]], dtype=np.uint64)
    narrowest = (np.searchsorted(marks, padded, side="right") + 2).astype(np.int8)
    best = np.full(total, np.iinfo(np.int32).max, dtype=np.int32)
    cost = np.empty(total, dtype=np.int32)
    large = np.zeros(len(padded) + 1, dtype=np.int32)
    # Where all ids fit, a selector of fewer ids can't be better.
    for selector in range(2, int(narrowest.max()) + 1):
        count = COUNTS[selector]
        scale = 16 * (COMMON // count)  # bits per id, times COMMON; the selector below
        np.cumsum(narrowest > selector, out=large[1:])
        np.subtract(large[count : count + total], large[:total], out=cost)
        np.multiply(cost, 32 * scale, out=cost)
        np.add(cost, 64 * scale + selector, out=cost)
        np.minimum(best, cost, out=best)
    choice = best & 15
    start = word_starts(np.array(COUNTS)[choice])
    selectors = choice[start]
    words = selectors.astype(np.uint64) << np.uint64(60)
    escaped = np.zeros(len(padded), dtype=bool)
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        count, width = COUNTS[selector], WIDTHS[selector]
        at = start[rows][:, None] + np.arange(count)
        value, mark = padded[at], np.uint64((1 << width) - 1)
        escaped[at] = value >= mark
        shift = np.arange(count, dtype=np.uint64) * np.uint64(width)
        words[rows] |= np.bitwise_or.reduce(np.minimum(value, mark) << shift, axis=1)
    return words.astype("<u8"), ids[escaped[:total]].astype("<u4")


def word_starts(steps: np.ndarray) -> np.ndarray:
    """Places reached from 0 by going on by each place's step, up to the end.

    Every 16th place is found one after the other, those between all at once.
    """
    total = len(steps)
    after = np.append(np.minimum(np.arange(total) + steps, total), total)
    far = after
    for _ in range(4):
        far = far[far]
    hops, at = [], 0
    while at < total:
        hops.append(at)
        at = far.item(at)
    rows = [np.array(hops, dtype=np.int64)]
    for _ in range(15):
        rows.append(after[rows[-1]])
    starts = np.stack(rows, axis=1).ravel()
    return starts[starts < total]


def unpack(words: np.ndarray, escapes: np.ndarray, total: int) -> np.ndarray:
    """The ids of packed words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selectors]
    start = np.cumsum(counts) - counts
    out = np.zeros(total + 60, dtype="<u4")
    escaped = np.zeros(total + 60, dtype=bool)
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        count, width = COUNTS[selector], WIDTHS[selector]
        at = start[rows][:, None] + np.arange(count)
        mark = np.uint64((1 << width) - 1)
        shift = np.arange(count, dtype=np.uint64) * np.uint64(width)
        value = (words[rows][:, None] >> shift) & mark
        out[at] = value.astype(np.uint32)
        escaped[at] = value == mark
    out = out[:total]
    out[escaped[:total]] = escapes
    return out


def write_block(sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of documents: how many ids each has, and all their ids."""
    words, escapes = pack(ids)
    counts = np.array(COUNTS)[(words >> np.uint64(60)).astype(np.int64)]
    starts = np.cumsum(counts) - counts
    samples = starts[::SAMPLE]
    # Escapes before each sampled word: those among the ids before it.
    places = escaped_places(words, starts, len(ids))
    escaped = np.searchsorted(places, samples)
    head = HEADER.pack(MAGIC, len(sizes), len(ids), len(words), len(escapes), len(samples))
    parts = (sizes.astype("<u4"), samples.astype("<u4"), escaped.astype("<u4"), words, escapes)
    return b"".join((head, *(p.tobytes() for p in parts)))


def escaped_places(words: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Ascending places of the ids that stand in the escape list."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    found = []
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        count, width = COUNTS[selector], WIDTHS[selector]
        mark = np.uint64((1 << width) - 1)
        shift = np.arange(count, dtype=np.uint64) * np.uint64(width)
        row, slot = np.nonzero(((words[rows][:, None] >> shift) & mark) == mark)
        found.append(starts[rows[row]] + slot)
    places = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return places[places < total]


def block_parts(block: bytes) -> tuple[int, list[np.ndarray]]:
    """``(ids, [sizes, samples, escaped, words, escapes])`` of a block, nothing decoded."""
    magic, docs, total, words, escapes, samples = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEADER.size
    parts = []
    for kind, n in (("<u4", docs), ("<u4", samples), ("<u4", samples), ("<u8", words), ("<u4", escapes)):
        parts.append(np.frombuffer(block, dtype=kind, count=n, offset=at))
        at += parts[-1].nbytes
    return total, parts


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(sizes, ids)``: ids of each document, and all ids."""
    total, (sizes, _, _, words, escapes) = block_parts(block)
    return sizes, unpack(words, escapes, total)


def read_range(block: bytes, start: int, stop: int) -> np.ndarray:
    """The ids ``[start, stop)`` of a block; only words between sampled ones around them are decoded."""
    total, (_, samples, escaped, words, escapes) = block_parts(block)
    start, stop = max(0, start), min(stop, total)
    if start >= stop:
        return np.zeros(0, dtype="<u4")
    low = int(np.searchsorted(samples, start, side="right")) - 1
    high = int(np.searchsorted(samples, stop))
    first = int(samples[low])
    last, upto = (int(samples[high]), int(escaped[high])) if high < len(samples) else (total, len(escapes))
    part = words[low * SAMPLE : high * SAMPLE]
    return unpack(part, escapes[int(escaped[low]) : upto], last - first)[start - first : stop - first]


def read_document(block: bytes, place: int) -> np.ndarray:
    """Ids of the block's document number ``place``, from 0."""
    _, (sizes, *_) = block_parts(block)
    stop = int(sizes[: place + 1].sum(dtype=np.int64))
    return read_range(block, stop - int(sizes[place]), stop)


# What a byte is to the cutting rule: a letter, or ASCII white space.
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
# White space beyond ASCII, in UTF-8.
WIDE_BLANKS = [
    c.encode()
    for c in "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
]


def blank_beside(data: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """Whether the character that ends before, or starts after, each place is white space."""

    def byte(k: int) -> np.ndarray:
        place = at - k if before else at + k
        return data[np.clip(place, 0, len(data) - 1)]

    near = [byte(1), byte(2), byte(3)]
    blank = BLANK[near[0]]
    wide = np.flatnonzero(near[0] >= 0x80)
    if len(wide):
        code = sum(near[k][wide].astype(np.int64) << 8 * k for k in range(3))
        for mark in WIDE_BLANKS:
            order = mark[::-1] if before else mark
            mask = (1 << 8 * len(mark)) - 1
            blank[wide] |= code & mask == sum(b << 8 * k for k, b in enumerate(order))
    return blank


# Pieces that are words whatever stands before them, or after a line end.
SPACED = r"\A [!-~]+\z"
HEADED = r"\A[A-Za-z]+\z"
WIDE = re.compile(r" \S+")
#: Words laid end to end in one call of the library.
JOINED = 4096


def piece_starts(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start, ``heads`` among them.

    A byte-level word is letters, or digits, or marks, with at most one space before.
    So a word ends where a letter is followed by ASCII that is none, and a word
    starts at a space between two characters that aren't white space. One line end
    between two such characters is a word of its own. No other piece ends in white
    space, which is read differently at the end of a text.
    """
    cut = np.zeros(len(data) + 1, dtype=bool)
    before, here = data[:-1], data[1:]
    cut[1:-1] = LETTER[before] & ~LETTER[here] & (here < 0x80)
    single = np.flatnonzero((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) + 1 if len(data) > 2 else heads[:0]
    single = single[~(blank_beside(data, single, True) | blank_beside(data, single, False))]
    cut[single] = True
    cut[single[data[single] == 0x0A] + 1] = True
    cut[heads] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """The library's encoding, remembered by piece.

    Pieces are cut and numbered for all texts of a slice at once; the library sees
    each distinct one the first time only, and ids are put together by array
    operations. A text that holds one of the tokenizer's added tokens is not cut.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id; a byte-level token has a character a byte.
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, int] = {}
        self.ends = np.zeros(1, dtype=np.int64)  # of the ids of each known piece
        self.flat = np.zeros(0, dtype="<u4")
        self.used = np.zeros(0, dtype=np.int32)  # slices in which each came

    def forget(self) -> None:
        """Keep pieces that came in several slices, or none if these are too many."""
        stay = np.flatnonzero(self.used > 1)
        if len(stay) > KEPT_PIECES // 2:
            stay = stay[:0]
        sizes = np.diff(self.ends)[stay]
        first = self.ends[stay]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        self.flat = self.flat[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
        self.ends = upto
        pieces = list(self.known)
        self.known = {pieces[k]: n for n, k in enumerate(stay.tolist())}
        self.used = np.zeros(len(stay), dtype=np.int32)

    def learn(self, fresh: pa.Array) -> None:
        """Let the library encode pieces that are not known yet.

        Plain words are laid end to end, those without a space after a line end, and
        found again by the bytes of their ids; other pieces go one by one.
        """
        spaced = pc.match_substring_regex(fresh, SPACED)
        headed = pc.match_substring_regex(fresh, HEADED)
        wide = fresh.filter(pc.invert(pc.or_(spaced, headed))).to_pylist()
        alone = [WIDE.fullmatch(p.decode()) is None for p in wide]
        others = list(compress(wide, alone))
        coded = self.tokenizer.encode_batch_fast([p.decode() for p in others], add_special_tokens=False)
        lists = [e.ids for e in coded]
        parts = [np.fromiter(chain.from_iterable(lists), "<u4")]
        counts = [np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))]
        order = others
        for words, lead in (
            (fresh.filter(spaced).to_pylist() + [p for p, a in zip(wide, alone) if not a], b""),
            (fresh.filter(headed).to_pylist(), b"\n"),
        ):
            order = order + words
            ids, sizes = self.end_to_end([lead + w for w in words] if lead else words)
            if lead:  # without the line ends
                ids, sizes = np.delete(ids, np.cumsum(sizes) - sizes), sizes - 1
            parts.append(ids)
            counts.append(sizes)
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))
        self.flat = np.concatenate((self.flat, *parts))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))))
        self.used = np.concatenate((self.used, np.zeros(len(order), dtype=np.int32)))

    def end_to_end(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)`` of words that stay words when they follow each other."""
        if not words:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        runs = [b"".join(words[k : k + JOINED]).decode() for k in range(0, len(words), JOINED)]
        coded = self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), "<u4")
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        upto = np.cumsum(self.widths[ids])
        last = np.searchsorted(upto, ends)
        if upto[-1] != ends[-1] or (upto[last] != ends).any():
            raise ValueError("a word's ids reach beyond it: the tokenizer isn't byte-level")
        return ids, np.diff(last, prepend=-1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)``: all texts' ids in a row, and how many each has; null is empty."""
        if len(self.known) > KEPT_PIECES:
            self.forget()
        binary = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
        buffer = binary.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, dtype=np.uint8)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        starts = piece_starts(data, offsets)
        whole = data.tobytes()
        if any(token in whole for token in self.added):
            held = np.array([any(t in whole[a:b] for t in self.added) for a, b in zip(offsets[:-1], offsets[1:])])
            text = np.searchsorted(offsets, starts, side="right") - 1
            inside = (text < len(held)) & held[np.minimum(text, len(held) - 1)]
            starts = starts[~inside | np.isin(starts, offsets)]
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(whole)]
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        find = self.known.get
        numbers = np.array([find(p, -1) for p in distinct], dtype=np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            self.learn(pieces.dictionary.take(pa.array(new)))
            numbers[new] = [find(distinct[k]) for k in new.tolist()]
        self.used[numbers] += 1
        number = numbers[pieces.indices.to_numpy()]
        first, sizes = self.ends[number], self.ends[number + 1] - self.ends[number]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The encoder of a tokenizer file, one per Python worker."""
    return PieceEncoder(path)


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode ``docs`` and write their ids to ``path`` in ascending order of ``id_col``.

    ``end_id`` ends every document; a null text is empty and has only that id.
    Null ids come first; rows of one id follow each other by a hash of the text,
    which also splits an id of very many rows between tasks. An empty table
    writes no block. Other columns are ignored. Rows of the files: ``part`` (a
    write task, of which ranges ascend), ``block``, ``first`` (ids of the part
    before the block), ``n_ids``, ``doc_ids`` and ``body``.
    """
    mark = F.xxhash64(F.col(text_col))
    read = docs.select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), mark.alias("__mark")
    )
    ordered = read.repartitionByRange("__id", "__mark").sortWithinPartitions("__id", "__mark", "__text")
    kind = read.schema["__id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        block = first = 0
        names: list[pa.Array] = []
        held_sizes, held_ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")

        def close(docs: int) -> pa.RecordBatch:
            """A row of the first ``docs`` documents held."""
            nonlocal block, first, names, held_sizes, held_ids
            every = pa.concat_arrays(names)
            count = int(held_sizes[:docs].sum())
            mine = every.slice(0, docs)
            row = {
                "part": pa.array([part], pa.int32()),
                "block": pa.array([block], pa.int32()),
                "first": pa.array([first], pa.int64()),
                "n_ids": pa.array([count], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), mine),
                "body": pa.array([write_block(held_sizes[:docs], held_ids[:count])], pa.binary()),
            }
            block, first, names = block + 1, first + count, [every.slice(docs)]
            held_sizes, held_ids = held_sizes[docs:], held_ids[count:]
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for start, stop in slices(batch.column("__text"), SLICE_BYTES):
                ids, sizes = coder.encode(batch.column("__text").slice(start, stop - start))
                names.append(batch.column("__id").slice(start, stop - start))
                held_ids = np.concatenate((held_ids, np.insert(ids, np.cumsum(sizes), end_id)))
                held_sizes = np.concatenate((held_sizes, sizes + 1))
                while (upto := np.cumsum(held_sizes))[-1] >= BLOCK_IDS:
                    yield close(int(np.searchsorted(upto, BLOCK_IDS)) + 1)
                    if not len(held_sizes):
                        break
        if len(held_sizes):
            yield close(len(held_sizes))

    ordered.select("__id", "__text").mapInArrow(
        run,
        f"part int, block int, first bigint, n_ids bigint, doc_ids array<{kind}>, body binary",
    ).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """``(id_col, start, n_tokens, ids_crc32)`` of each document in the files at ``path``.

    ``start`` counts the ids of all documents before it. ``keep_ids`` adds
    ``ids`` (array<bigint>). The sizes of the parts, one per write task, are
    broadcast.
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        blocks.groupBy("part")
        .agg(F.sum("n_ids").alias("__n"))
        .select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    placed = blocks.join(F.broadcast(parts), "part").select(
        (F.col("first") + F.col("__before")).alias("__start"), "doc_ids", "body"
    )
    schema = f"__id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    if keep_ids:
        schema += ", ids array<bigint>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, ids = read_block(batch.column("body")[k].as_py())
                stops = np.cumsum(sizes, dtype=np.int64)
                starts = stops - sizes
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                arrays = [
                    batch.column("doc_ids")[k].values,
                    pa.array(starts + batch.column("__start")[k].as_py()),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ]
                names = ["__id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    cut = pa.array(np.append(0, stops).astype(np.int32))
                    arrays.append(pa.ListArray.from_arrays(cut, pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return placed.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def read_documents(spark: SparkSession, path: str, wanted: Sequence, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, ids)`` of the documents with an id among the few ``wanted``.

    Only blocks that hold one are decoded, and of those only the words around it.
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    asked = F.array(*(F.lit(w) for w in wanted)).cast(f"array<{kind}>")
    held = blocks.filter(F.arrays_overlap("doc_ids", asked)).select(
        "body", F.posexplode("doc_ids").alias("place", "__id")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("place").to_pylist()
            ids = [read_document(body.as_py(), place) for body, place in zip(batch.column("body"), places)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))],
                names=["__id", "ids"],
            )

    mine = held.filter(F.array_contains(asked, F.col("__id")))
    return mine.mapInArrow(run, f"__id {kind}, ids array<bigint>").withColumnRenamed("__id", id_col)


def through_files(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read the documents back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer, end_id, path, id_col, text_col)
    return read_tokens(docs.sparkSession, path, id_col)
