"""Secrets in texts: known forms, and strings that pass as random.

The base forms are patterns. Other candidates, long unbroken runs of letters,
digits and ``+/_-``, go through a battery of tests in the smallest alphabet that
fits (hexadecimal, base 32, or the classes of symbols present, of either case):

- chi-squared uniformity of the symbols, in terms of pairs of equal symbols;
- runs, counted as changes between letters and digits;
- serial correlation of neighbouring symbols.

``-`` and ``_`` may be symbols or separators, as in UUIDs and prefixed keys: a
candidate is read with them, without them and part by part, and the most even
reading counts. Its encoding, for the classes below, is that without them.

A candidate must be as even as a uniform draw (the three tests combined), and
less like words than chance allows: words repeat letters and seldom change
between letters and digits. The second p-value is held against a false
discovery rate among all candidates of its encoding and length class, so short
strings, which say little, need stronger evidence where words are many.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import staged

# Fixed forms of the base scan.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_STEMS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Runs taken as candidates.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Share of false discoveries allowed in each encoding and length class.
FALSE_SHARE = 0.01
#: A candidate less even than this, tests combined, isn't a uniform draw.
UNEVEN = 0.001
#: Words: chance that two letters are equal, the same for three, and changes
#: between letters and digits per character.
PAIR_CHANCE = 0.065
TRIPLE_CHANCE = 0.0055
CHANGE_RATE = 0.05
#: Lower ends of the length classes.
LENGTHS = (16, 20, 24, 32, 40, 64, 128)
#: Bins of ten times the negative decimal logarithm of a p-value.
BINS = 400

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
ENCODINGS = tuple(ALPHABETS)
PLACES = {name: {c: k for k, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
#: Classes of symbols.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/")
SEPARATOR = re.compile(r"[-_]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base forms, by start and kind."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(stem in low for stem in ASSIGN_STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20
        ]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def infer_encoding(symbols: str) -> str | None:
    """Encoding with the smallest alphabet that fits; digits only are a number."""
    if symbols.isdigit():
        return None
    one_case = symbols.lower() == symbols or symbols.upper() == symbols
    folded = symbols.lower() if one_case else symbols
    for name, read in (("hex", folded), ("base32", symbols), ("base36", folded), ("base64", symbols)):
        if all(c in PLACES[name] for c in read):
            return name
    return None


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _fisher(p: list[float]) -> float:
    """Fisher's combination: upper tail of chi-squared with 2 len(p) degrees of freedom."""
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    term = total = 1.0
    for k in range(1, len(p)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total) if half < 700 else 0.0


def _poisson_upper(k: int, mean: float) -> float:
    """Chance of ``k`` or more events."""
    if k <= 0:
        return 1.0
    term = math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
    total, j = term, k
    while term > total * 1e-12:
        j += 1
        term *= mean / j
        total += term
    return min(1.0, total)


@lru_cache(64)
def _alphabet(kind: str | tuple[str, ...]) -> tuple[dict[str, int], float]:
    """Places of an alphabet's symbols and the share of digits among letters and digits."""
    letters = ALPHABETS[kind] if isinstance(kind, str) else "".join(kind)
    digits, words = sum(c.isdigit() for c in letters), sum(c.isalnum() for c in letters)
    return {c: k for k, c in enumerate(letters)}, digits / max(1, words)


def _evenness(parts: list[str]) -> float:
    """P-value of parts as uniform draws, each from the smallest alphabet of its symbols."""
    equal = even_mean = even_var = changes = change_mean = change_var = 0.0
    together = spread = drift = 0.0
    size = 0
    for part in parts:
        n = len(part)
        if n < 2:
            continue
        name = infer_encoding(part)
        if name == "hex":
            part = part.lower()
        elif name != "base32" or part.isalpha():
            name = tuple(c for c in CLASSES if not set(part).isdisjoint(c))
        place, share = _alphabet(name)
        pairs, chance = n * (n - 1) / 2, 1 / len(place)
        equal += sum(c * (c - 1) for c in Counter(part).values()) / 2
        even_mean += pairs * chance
        even_var += pairs * chance * (1 - chance)
        digits = [c.isdigit() for c in part if c.isalnum()]
        if len(digits) > 1 and 0 < share < 1:
            steps, change = len(digits) - 1, 2 * share * (1 - share)
            changes += sum(a != b for a, b in zip(digits, digits[1:]))
            change_mean += steps * change
            change_var += steps * change * (1 - change) + (steps - 1) * share * (1 - share) * (1 - 2 * share) ** 2
        places = [place[c] for c in part]
        mean, scale = sum(places) / n, 12 / (len(place) ** 2 - 1)
        together += scale * sum((a - mean) * (b - mean) for a, b in zip(places, places[1:]))
        spread += scale * sum((x - mean) ** 2 for x in places)
        drift += (n - 1) / n
        size += n - 1
    if not size:
        return 0.0
    p = [_upper((equal - even_mean) / math.sqrt(even_var))]
    if change_var > 0:
        p.append(_two_sided((changes - change_mean) / math.sqrt(change_var)))
    serial = together / spread if spread else 1.0
    p.append(_two_sided((serial + drift / size) * math.sqrt(size + drift)))
    return _fisher(p)


def battery(raw: str) -> tuple[str, float, float] | None:
    """``(encoding, evenness, wordiness)`` p-values of a candidate.

    The first is small when the symbols aren't a uniform draw, the second when
    words would hardly come out like this.
    """
    raw = raw.rstrip("=")
    parts = [part for part in SEPARATOR.split(raw) if part]
    symbols = "".join(parts)
    name = infer_encoding(symbols) if symbols else None
    if name is None:
        return None
    evenness = _evenness([symbols])
    if len(symbols) < len(raw):
        with_them = raw.replace("-", "+").replace("_", "/")
        as_symbols = _evenness([with_them])
        evenness = max(evenness, as_symbols, _evenness(parts))
        if as_symbols >= UNEVEN:
            parts, symbols = [with_them], with_them
    if name == "hex":
        symbols = symbols.lower()
    # against words, which may change to digits at a separator
    n = len(symbols)
    pairs = n * (n - 1) / 2
    equal = sum(c * (c - 1) for c in Counter(symbols).values()) / 2
    digits = [[c.isdigit() for c in part if c.isalnum()] for part in parts]
    changes = sum(a != b for d in digits for a, b in zip(d, d[1:]))
    steps = max(1, sum(len(d) - 1 for d in digits if d))
    word_sd = math.sqrt(
        pairs * PAIR_CHANCE * (1 - PAIR_CHANCE)
        + n * (n - 1) * (n - 2) * (TRIPLE_CHANCE - PAIR_CHANCE**2)
    )
    few_equal = _upper((pairs * PAIR_CHANCE - equal) / word_sd) if word_sd else 1.0
    many_changes = _poisson_upper(changes, CHANGE_RATE * steps)
    return name, evenness, _fisher([few_equal, many_changes])


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``(start, end, stratum, bin)`` of even candidates apart from base spans.

    Candidates that fail evenness have bin -1: they count, but are never found.
    """
    out = []
    # Both go from left to right, so each base span is passed once.
    taken: list[list[int]] = []
    for s, _, e in sorted(base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        tested = battery(m.group())
        if tested is None:
            continue
        name, evenness, wordiness = tested
        length = bisect_right(LENGTHS, len(m.group().rstrip("=")))
        stratum = ENCODINGS.index(name) * (len(LENGTHS) + 1) + length
        place = -1
        if evenness >= UNEVEN:
            place = min(BINS, int(-10 * math.log10(max(wordiness, 1e-40))))
        out.append((start, end, stratum, place))
    return out


def cut_offs(tested: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """Smallest bin found of each stratum, of rows ``(stratum, bin)``.

    Benjamini and Hochberg's rule on binned p-values: the largest p at which
    the stratum's candidates times p stay within ``share`` of those found.
    """
    bins = tested.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("stratum")
    down = whole.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ruled = bins.select(
        "stratum",
        "bin",
        F.sum("n").over(whole).alias("all"),
        F.sum("n").over(down).alias("found"),
    ).filter(
        (F.col("bin") >= 0)
        & (F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / 10) <= F.lit(share) * F.col("found"))
    )
    # at most one row for each of the fixed strata
    return {r[0]: r[1] for r in ruled.groupBy("stratum").agg(F.min("bin")).collect()}


SCANNED = (
    "base array<struct<start:int,kind:int,end:int>>, "
    "tested array<struct<start:int,end:int,stratum:int,bin:int>>"
)
SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
TESTED = pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32())]
)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(__id, base, tested)`` of each document."""
    read = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = read.schema["__id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tested = [], []
            for text in batch.column("__text").to_pylist():
                spans = base_spans(text or "")
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                tested.append(
                    [dict(zip(("start", "end", "stratum", "bin"), c)) for c in candidates(text or "", spans)]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"),
                    pa.array(base, pa.list_(SPAN)),
                    pa.array(tested, pa.list_(TESTED)),
                ],
                names=["__id", "base", "tested"],
            )

    return read.mapInArrow(run, f"__id {kind}, {SCANNED}")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def _is_kind(kind: int):
    return lambda span: span["kind"] == kind


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_SHARE
) -> DataFrame:
    """One row per document: its spans of secrets, in code points.

    ``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_random,
    found``: counts of the base forms, the digest of their spans, all spans as
    text (``kind:start:end``) and as an array of structs. Null and empty texts
    have none. Rows with null or repeated ids are kept as they are; other
    columns are ignored.
    """
    scanned = staged(scan(docs, id_col, text_col), "secret-scan")
    tested = scanned.select(F.explode("tested").alias("t")).select("t.stratum", "t.bin")
    limits = cut_offs(tested, share)
    table = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else None
    random = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if table is not None:
        over = F.filter(
            "tested", lambda t: t["bin"] >= F.coalesce(table[t["stratum"]], F.lit(BINS + 1))
        )
        random = F.transform(
            over,
            lambda t: F.struct(
                t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")
            ),
        )
    count = [F.size(F.filter("base", _is_kind(k))).cast("bigint") for k in range(3)]
    return scanned.withColumn("found", F.array_sort(F.concat("base", random))).select(
        F.col("__id").alias(id_col),
        count[0].alias("n_assign"),
        count[1].alias("n_access"),
        count[2].alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("bigint").alias("n_random"),
        "found",
    )


def redacted(docs: DataFrame, share: float = FALSE_SHARE, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced by ``mark``.

    Overlapping spans are replaced together. ``n_chars``, where present, is
    counted anew for changed texts. Every row is kept, a null text stays null.
    """
    columns = docs.columns
    tested = (
        scan(docs, "doc_id", "text").select(F.explode("tested").alias("t")).select("t.stratum", "t.bin")
    )
    limits = cut_offs(tested, share)

    def clean(text: str) -> str:
        base = base_spans(text)
        spans = [(s, e) for s, _, e in base]
        spans += [
            (s, e) for s, e, stratum, place in candidates(text, base) if place >= limits.get(stratum, BINS + 1)
        ]
        if not spans:
            return text
        out, at = [], 0
        for start, end in sorted(spans):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            old = batch.column(at).to_pylist()
            new = [None if t is None else clean(t) for t in old]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                sizes = [
                    size if a == b else len(b)
                    for size, a, b in zip(batch.column(k).to_pylist(), old, new)
                ]
                arrays[k] = pa.array(sizes, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, docs.schema).select(*columns)
