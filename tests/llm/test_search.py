"""Phrases of test items, ranked documents and whitening against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import items as item_sets
from pageloom.llm import lexical, phrase_index, whitening, words

DOCS = "doc_id long, text string, score string, items int, rank int, n_words string"
ITEMS = "item_id long, text string, doc_id string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RARE = [f"r{k}" for k in range(300)]
COMMON = ["the", "of", "É", "naïve", "日本", "x1"]


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_equal_the_pattern():
    texts = ["", None, "One,TWO three", "É日本 ßÀ\x00a\x7fb", "a", " ", "x" * 10, "1a-B2_c\n", "tail", "head end "]
    distinct, numbers, first = words.cut_words(pa.array(texts, pa.string()))
    got = [[distinct[n].as_py().decode() for n in numbers[a:b]] for a, b in zip(first[:-1], first[1:])]
    assert got == [plain_words(t) for t in texts]
    part = pa.array(["zz top", *texts], pa.string()).slice(1, 3)
    assert [len(w) for w in words.word_lists(part.to_pylist())] == [0, 0, 3]
    known, first = words.numbered(part, pa.array([b"two", b"one"]))
    assert known.tolist() == [1, 0, -1] and first.tolist() == [0, 0, 0, 3]
    assert len(words.numbered(part, pa.array([], pa.binary()))[0]) == 3


def test_slices_hold_whole_texts():
    texts = pa.array(["a" * 30, None, "b" * 200, "", "c" * 10, "d" * 95], pa.string())
    assert list(words.slices(texts, 100)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert list(words.slices(texts.slice(3, 3), 300)) == [(0, 3)]
    assert list(words.slices(texts.slice(0, 0), 300)) == []


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    some = lambda n: [str(w) for w in rng.choice(RARE + COMMON * 20, n)]
    items = [(k, " ".join(some(rng.integers(11, 30)))) for k in range(12)]
    items += [(20, "only Four short words"), (21, "one"), (22, ""), (23, None), (24, "..."), (3, items[3][1])]
    items += [(30, items[4][1].upper()), (31, " ".join(["the"] * 15)), (None, " ".join(some(12))), (5, "another text of 5")]
    docs = []
    for k in range(60):
        text = some(rng.integers(0, 120))
        if k % 3 == 0:
            source = plain_words(items[k % 12][1])
            at = int(rng.integers(0, len(source) - 9))
            text[len(text) // 2 : len(text) // 2] = source[at : at + int(rng.integers(8, 20))]
        docs.append((k, ", ".join(text)))
    docs += [(100, items[0][1]), (100, items[0][1]), (None, "x " + items[1][1] + "\n" + items[1][1]), (101, None)]
    docs += [(102, ""), (103, "only four"), (104, "only four short words; only FOUR short words one")]
    docs += [(105, "the " * 4000), (106, "the " * 9), (107, "the " * 10), (108, items[-2][1]), (109, "?!")]
    shuffled = plain_words(items[2][1])[:10]
    docs.append((110, " ".join(shuffled[::-1])))
    return docs, items


def frames(spark, docs, items):
    docs = [(i, t, "x", 1, 2, "y") for i, t in docs]
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(*r, "z") for r in items], ITEMS)


def plain_matches(text, items, size=10):
    ws = plain_words(text)
    hit, names = set(), set()
    for item_id, item_text in items:
        item = plain_words(item_text)
        n = min(size, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if item else set()
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in windows:
                hit.update(range(k, k + n))
                names.add("null" if item_id is None else str(item_id))
    return len(ws), sorted(hit), sorted(names)


@pytest.mark.parametrize("blocks", [1, 4])
def test_phrases_equal_brute_force(spark, monkeypatch, blocks):
    docs, items = corpus()
    if blocks > 1:
        monkeypatch.setattr(
            phrase_index, "item_blocks", lambda *a: item_sets.item_blocks(*a, rows=len(items) // blocks)
        )
        monkeypatch.setattr(phrase_index, "slices", lambda texts: words.slices(texts, 2000))
    d, i = frames(spark, docs, items)
    got = phrase_index.find_items(d, i)
    assert got.columns == ["doc_id", "n_words", "spans", "items", "near"]
    got = [
        (r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.stop)], r["items"]) for r in got.collect()
    ]
    want = [(doc_id, *plain_matches(text, items)) for doc_id, text in docs]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(bool(w[2]) for w in want) > 10
    digests = phrase_index.contamination(d, i).collect()
    assert sorted(
        (str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in digests
    ) == sorted(
        (str(w[0]), w[1], len(w[2]), len(w[3]), hashlib.sha256(",".join(w[3]).encode()).hexdigest(), bool(w[2]))
        for w in want
    )


def test_near_matches_equal_brute_force(spark):
    docs, items = corpus(8)
    total = Counter(w for _, t in docs for w in plain_words(t))
    reach, want = 12, {}
    for doc_id, text in docs:
        ws = plain_words(text)
        at = {}
        for k, w in enumerate(ws):
            at.setdefault(w, []).append(k)
        names = set()
        for item_id, item_text in items:
            item = plain_words(item_text)
            n = min(10, len(item))
            for k in range(len(item) - n + 1 if item else 0):
                terms = set(item[k : k + n])
                fewest = min(total[t] for t in terms)
                rarest = [t for t in terms if total[t] == fewest]
                ok = [
                    any(all(any(abs(p - q) <= reach for q in at.get(t, [])) for t in terms) for p in at.get(r, []))
                    for r in rarest
                ]
                # Ties of rarity go to the word first in byte order.
                if ok[rarest.index(min(rarest, key=lambda w: w.encode()))]:
                    names.add("null" if item_id is None else str(item_id))
        want.setdefault(doc_id, []).append(sorted(names))
    d, i = frames(spark, docs, items)
    got = {}
    for r in phrase_index.find_items(d, i, reach=reach).collect():
        got.setdefault(r.doc_id, []).append(r.near)
        assert set(r["items"]) <= set(r.near)
    assert got == want
    assert want[110][0]


def test_phrases_of_empty_tables(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    none_d, none_i = frames(spark, [], [])
    assert phrase_index.contamination(none_d, i).count() == 0
    without = phrase_index.contamination(d, none_i).collect()
    assert len(without) == len(docs) and not any(r.contaminated for r in without)
    assert phrase_index.contamination(none_d, none_i).count() == 0


def plain_ranking(docs, items, count):
    lists = [(doc_id, Counter(plain_words(t))) for doc_id, t in docs]
    lists = [(i, c, sum(c.values())) for i, c in lists if c]
    n_docs, n_terms = len(lists), sum(n for *_, n in lists)
    df = Counter(t for _, c, _ in lists for t in c)
    out = []
    for item_id, text in set(items):
        terms = set(plain_words(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for doc_id, c, n in lists:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:count])]
    return out


@pytest.mark.parametrize("count,bucket_rows", [(3, 5), (50, 4096), (7, 1)])
def test_ranking_equals_brute_force(spark, monkeypatch, count, bucket_rows):
    docs, items = corpus(5)
    if bucket_rows == 5:
        monkeypatch.setattr(lexical, "SCOUTS", 3)
        monkeypatch.setattr(lexical, "item_blocks", lambda *a: item_sets.item_blocks(*a, rows=8))
    d, i = frames(spark, docs, items)
    got = lexical.best_documents(d, i, count, bucket_rows=bucket_rows)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_ranking(docs, items, count)))


def test_ranking_ties_go_to_the_smaller_id(spark):
    docs = [(k, "same words here") for k in (9, 4, 7, None, 4, 1)] + [(20 + k, f"w{k} other") for k in range(30)]
    d, i = frames(spark, docs, [(1, "words HERE same"), (2, "nothing known")])
    got = sorted(map(tuple, lexical.best_documents(d, i, 4, bucket_rows=2).collect()))
    assert [r[:3] for r in got] == [(1, 1, 1), (1, 2, 4), (1, 3, 4), (1, 4, 7)]


def test_buckets_are_pruned_by_both_bounds():
    weight = np.array([100, 50, 10, 1], dtype=np.int64)
    queries = lexical.Queries([np.array([0, 1]), np.array([2, 3]), np.array([], dtype=np.int64)], weight)
    largest = np.array([10.0, 0, 500.0, 0])
    assert queries.open(1e6, largest, np.array([1, 1, 1])).tolist() == [0, 1]
    assert queries.open(1e6, largest, np.array([1001, 5000, 1])).tolist() == [1]  # coordinates
    assert queries.open(5.0, largest, np.array([1000, 50, 1])).tolist() == [1]  # Cauchy-Schwarz
    # One document with word 0, one with words 0 and 1; the filter drops the first.
    here = lexical.Bucket(
        np.array([10.0, np.hypot(9, 4)]), np.array([0, 1]), np.array([2, 1]), np.array([0, 1, 1]), np.array([10, 9, 4]), 4
    )
    assert here.search(np.array([0, 1]), weight[:2], 1100)[0].tolist() == [1]
    assert here.search(np.array([0, 1]), weight[:2], 1100)[1].tolist() == [1100]


def test_ranking_of_empty_tables(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    none_d, none_i = frames(spark, [], [])
    assert lexical.best_documents(none_d, i).count() == 0
    assert lexical.best_documents(d, none_i).count() == 0
    assert lexical.best_documents(d, none_i).columns == ["item_id", "rank", "doc_id", "score"]


VECTORS = "vec_id long, embedding array<float>, component string, n int, whitened int"


def plain_whitening(rows, count=4):
    """``{dims: (x by row, n, S, eigenvalues, eigenvectors, trace)}`` of usable rows."""
    out = {}
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for dims in {len(v) for _, v in usable} - {0}:
        mine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in usable if len(v) == dims]
        x = [(i, np.floor(256 * v).astype(np.int64)) for i, v in mine]
        fit = np.unique(np.array([v for _, v in x]), axis=0)
        gap = fit - fit.sum(axis=0) / len(fit)
        values, axes = np.linalg.eigh(gap.T @ gap / len(fit))
        out[dims] = (x, len(fit), fit.sum(axis=0), values[::-1][:count], axes[:, ::-1][:, :count], values.sum())
    return out


@pytest.mark.parametrize("shape", ["flat", "steep", "low rank"])
def test_whitening_equals_dense_eigenvectors(spark, shape):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 40)) * {"flat": 1, "steep": 0.8 ** np.arange(40), "low rank": 1}[shape]
    if shape == "low rank":
        base = np.round(rng.normal(size=(300, 2)) * 40) @ np.round(rng.normal(size=(2, 40)) * 5) / 256
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(0, rows[0][1])] * 20 + [(None, rows[1][1]), (900, None), (901, []), (902, [None] + [1.0] * 39)]
    rows += [(903, [float("nan")] * 40), (904, [float("inf")] + [0.0] * 39)]
    rows += [(905, [1.0, 2.0]), (906, [1.0, 2.0]), (907, [3.0]), (908, [4.0]), (909, [4.5])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)
    got = whitening.whitened(df)
    assert got.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]
    got = got.collect()
    want = plain_whitening(rows)
    assert len(got) == 321 * 4 + 2 * 2 + 3
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.component), []).append(r)
    x, n, s, values, axes, trace = want[40]
    zero = values < 1e-10 * trace
    signs = np.zeros(4)
    for i, v in x:
        y = (v - s / n) @ axes
        for k in range(4):
            r = by_row[i, k + 1][0]
            assert (r.n, r.deviation) == (n, int(((n * v - s) ** 2).sum()))
            assert r.explained == pytest.approx(max(values[k], 0) / trace, rel=1e-9, abs=1e-12)
            assert r.identity_error < 1e-9
            if zero[k]:
                assert r.whitened is None
                continue
            y_k = y[k] / np.sqrt(values[k])
            signs[k] = signs[k] or np.sign(y_k * r.whitened)
            assert r.whitened == pytest.approx(signs[k] * y_k, abs=1e-8)
    assert zero.sum() == (2 if shape == "low rank" else 0)
    # Vectors of other lengths are lists of their own; equal vectors have no spread.
    assert [(r.n, r.whitened, r.explained, r.deviation) for r in by_row[905, 1]] == [(1, None, None, 0)]
    assert sorted(r.component for key, rs in by_row.items() if key[0] == 907 for r in rs) == [1]
    assert by_row[909, 1][0].explained == pytest.approx(1)


def test_whitening_of_no_rows_and_huge_entries(spark):
    df = spark.createDataFrame([], VECTORS)
    assert whitening.whitened(df).count() == 0
    rows = [(k, [float(2**40 * k), 1.0 + k % 2]) for k in range(4)]
    got = whitening.whitened(spark.createDataFrame([(*r, "", 1, 1) for r in rows], VECTORS)).collect()
    assert {r.deviation for r in got} == {None} and all(r.explained is not None for r in got)
    assert whitening.whitened(spark.createDataFrame([(1, None, "", 1, 1)], VECTORS)).count() == 0


def test_whitening_certifies_or_raises(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in v], "", 1, 1) for k, v in enumerate(rng.normal(size=(200, 40)))]
    monkeypatch.setattr(whitening, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="certificate"):
        whitening.whitened(spark.createDataFrame(rows, VECTORS)).count()
