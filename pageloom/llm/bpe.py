"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch are laid out as one array of symbols with links to
the neighbours. An index maps every mergeable pair, by its rank, to all its
positions. Active ranks are applied in ascending order: all positions of a rank
are merged at once, and only the lists of the pairs that arise beside them are
extended. Positions that a merge has used up stay listed and are passed over
when their rank comes. Words already encoded are kept from batch to batch in a
table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Pieces between spaces kept encoded from batch to batch by one Python worker.
KEPT_PIECES = 200_000
#: Characters of the pieces that stay when that table is full.
SHORT_PIECE = 9
#: Documents taken at once within a batch, by characters.
CHUNK_CHARS = 2_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    letters.update({b: chr(256 + k) for k, b in enumerate(rest)})
    return letters


def ascending(at: np.ndarray) -> np.ndarray:
    """Positions in order, each once."""
    at = np.sort(at)
    return at[np.append(True, at[1:] != at[:-1])] if len(at) > 1 else at


class WordBPE:
    """A tokenizer file's vocabulary, merges and text rules.

    Reads files whose normalizer is NFC, white space to one space and lower
    case, whose pre-tokenizer keeps the matches of a pattern as words, and whose
    words end in a suffix.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, letters = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        if (
            kinds != ["NFC", "Replace", "Lowercase"]
            or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True)
            or (letters["type"], letters["use_regex"]) != ("ByteLevel", False)
            or model["type"] != "BPE"
            or model["unk_token"] is not None
            or spec["post_processor"] is not None
        ):
            raise ValueError("not a word BPE file of a known form")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = (
            regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        )
        self.letters = byte_letters()
        # -1 where the vocabulary lacks a letter: such a symbol is left out
        self.first = np.array([vocab.get(self.letters[b], -1) for b in range(256)], dtype=np.int64)
        self.final = np.array(
            [vocab.get(self.letters[b] + self.suffix, -1) for b in range(256)], dtype=np.int64
        )
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        pairs, merged = [], []
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pairs.append(vocab[left] * self.size + vocab[right])
            merged.append(vocab[left + right])
        ranks = np.arange(len(pairs))
        keys = np.array(pairs, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        last = np.append(keys[order][1:] != keys[order][:-1], True)  # of equal pairs, the last rank
        order = order[last]
        self.keys, self.ranks = keys[order], ranks[order]
        self.left, self.right = keys // self.size, keys % self.size
        self.merged = np.array(merged, dtype=np.int64)
        # A rank after which a pair of a smaller rank can arise: one merge a word at a time.
        lowest = np.full(self.size, len(pairs))
        np.minimum.at(lowest, self.left[self.ranks], self.ranks)
        np.minimum.at(lowest, self.right[self.ranks], self.ranks)
        self.careful = lowest[self.merged] < ranks
        self.pieces = np.empty(self.size, dtype=object)
        self.pieces[:] = ""
        for token, k in chain(vocab.items(), self.specials.items()):
            self.pieces[k] = token
        self.byte_of = {letter: b for b, letter in self.letters.items()}
        self.rules = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it doesn't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word; words are UTF-8, ids unsigned 32-bit integers."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes)
        symbol = self.first[flat]
        if len(flat):
            symbol[ends[sizes > 0] - 1] = self.final[flat[ends[sizes > 0] - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        lacking = symbol < 0
        if lacking.any():
            symbol, owner = symbol[~lacking], owner[~lacking]
        n = len(symbol)
        here = np.arange(n)
        edge = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, dtype=bool)
        after = np.where(edge, -1, here + 1)
        before = np.where(np.append(True, edge[:-1]), -1, here - 1) if n else here
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(left: np.ndarray) -> None:
            """List positions under the rank of the pair that starts there."""
            left = left[after[left] >= 0]
            rank = self.rank_of(symbol[left], symbol[after[left]])
            left, rank = left[rank >= 0], rank[rank >= 0]
            if not len(left):
                return
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            stops = [*cuts[1:].tolist(), len(left)]
            for r, start, stop in zip(rank[cuts].tolist(), cuts.tolist(), stops):
                part = left[start:stop]
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(part)

        enter(here)
        while queue:
            rank = heapq.heappop(queue)
            at = np.concatenate(index.pop(rank))
            a, b = self.left[rank], self.right[rank]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = ascending(at[symbol[after[at]] == b])
            if not len(at):
                continue
            if self.careful[rank]:
                first = np.append(True, owner[at[1:]] != owner[at[:-1]])
                rest, at = at[~first], at[first]
                if len(rest):
                    index[rank] = [rest]
                    heapq.heappush(queue, rank)
            elif a == b:  # in a row of equal symbols every other pair merges, from the left
                chained = np.append(False, after[at[:-1]] == at[1:])
                start = np.flatnonzero(~chained)
                place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at = at[place % 2 == 0]
            gone = after[at]
            symbol[at] = self.merged[rank]
            symbol[gone] = -1
            behind = after[gone]
            after[at] = behind
            before[behind[behind >= 0]] = at[behind >= 0]
            front = before[at]
            enter(ascending(np.concatenate((at, front[front >= 0]))))
        left_over = symbol >= 0
        data = symbol[left_over].astype("<u4").tobytes()
        stops = 4 * np.cumsum(np.bincount(owner[left_over], minlength=len(words)))
        starts = np.append(0, stops[:-1])
        return [data[a:b] for a, b in zip(starts.tolist(), stops.tolist())]

    def words_of(self, piece: str) -> list[bytes]:
        """UTF-8 words of a piece of text without special tokens."""
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            # characters newer than Python's tables: the file's own rules decide
            ruled = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(piece))
            return [bytes(map(self.byte_of.__getitem__, word)) for word, _ in ruled]
        plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        return [word.encode() for word in self.pattern.findall(plain)]

    def add_pieces(self, pieces: list[str]) -> None:
        """Encode pieces between spaces and keep their ids."""
        words = [self.words_of(p) for p in pieces]
        distinct = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        ids = self.merge_words(list(distinct))
        self.known.update(
            (p, b"".join([ids[distinct[w]] for w in found])) for p, found in zip(pieces, words)
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers.

        No rule looks across a space or a line end, so texts are cut there and
        a piece is encoded once however often it occurs.
        """
        parts: list[list[str]] = []
        for text in texts:
            if self.special_pattern is None or self.special_pattern.search(text) is None:
                parts.append(text.replace("\n", " ").split(" "))
                continue
            found: list[str] = []
            at = 0
            for m in self.special_pattern.finditer(text):
                found += text[at : m.start()].replace("\n", " ").split(" ")
                found.append(m.group())
                at = m.end()
            parts.append(found + text[at:].replace("\n", " ").split(" "))
        if len(self.known) > KEPT_PIECES:  # short pieces come again more often
            self.known = {p: v for p, v in self.known.items() if len(p) <= SHORT_PIECE}
            if len(self.known) > KEPT_PIECES // 2:
                self.known.clear()
        self.known.update({c: int(k).to_bytes(4, "little") for c, k in self.specials.items()})
        known = self.known
        fresh = set(chain.from_iterable(parts)).difference(known)
        if fresh:
            self.add_pieces(list(fresh))
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces: the file names no decoder."""
        return " ".join(self.pieces[np.frombuffer(ids, dtype="<u4")].tolist())


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    """The tokenizer of a file, read once by each Python worker."""
    return WordBPE(path)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together; a long text is one alone."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_decode(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    Ids are hashed as little-endian unsigned 32-bit integers, the decoded text
    as UTF-8. ``keep`` may name ``ids`` (array<int>) and ``decoded`` to be added. A null
    text counts as empty: no ids and an empty text. Null and repeated ids are
    passed on; other columns are ignored. ``tokenizer`` is a path that every
    worker can read.
    """
    read = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    schema = f"__id {read.schema['__id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    kinds = {"ids": "array<int>", "decoded": "string"}
    schema += "".join(f", {name} {kinds[name]}" for name in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            for a, b in chunks(texts):
                ids = bpe.encode(texts[a:b])
                decoded = [bpe.decode(x) for x in ids]
                arrays = [
                    batch.column("__id").slice(a, b - a),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                names = ["__id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if "ids" in keep:
                    stops = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    added = {"ids": pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))}
                else:
                    added = {}
                if "decoded" in keep:
                    added["decoded"] = pa.array(decoded, pa.string())
                arrays += [added[name] for name in keep]
                names += keep
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return read.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
