import numpy as np
import pytest

from pageloom.llm import embedding_dedup, simhash_dedup
from pageloom.llm.common import components

from . import brute

WORDS = [f"w{k}" for k in range(60)]
SCHEMA = "doc_id long, text string, fingerprint int, component_id string"


def documents():
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.choice(WORDS, 80)), 1, "x") for k in range(2, 30)]
    rows += [(100 + k, rows[k % 3][1] + f" end{k}", None, None) for k in range(12)]
    rows += [(5, rows[0][1], 0, ""), (5, rows[0][1], 0, ""), (None, rows[1][1], 0, "")]
    rows += [(200, None, 0, ""), (201, "", 0, ""), (202, " \t\n", 0, ""), (203, "One Two", 0, "")]
    rows += [(204, "one\ttwo", 0, ""), (205, "word " * 30_000, 0, ""), (206, "word word", 0, "")]
    return rows


def test_simhash_equals_brute_force(spark):
    rows = documents()
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints, low = brute.simhash_classes([r[:2] for r in rows])
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, low)]
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_simhash_of_no_rows(spark):
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_of_each_group(spark):
    rows = documents()
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fingerprint", "component_id"]
    prints, low = brute.simhash_classes([r[:2] for r in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low))


@pytest.mark.parametrize("bits", [0, 1, 2, 4])
def test_gray_index_finds_all_links(bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    codes = [base]
    for _ in range(6):
        flip = np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
        codes.append(codes[-1] ^ flip)
    codes = np.unique(np.concatenate(codes))
    run = rng.integers(0, 2, len(codes))
    order = np.lexsort((simhash_dedup.gray_rank(codes), run))
    codes, run = codes[order], run[order]
    pairs = [
        (a, b)
        for a in range(len(codes))
        for b in range(a + 1, len(codes))
        if run[a] == run[b] and int(codes[a] ^ codes[b]).bit_count() <= bits
    ]
    want = brute.roots(list(range(len(codes))), pairs)
    assert simhash_dedup.linked_roots(codes, run, bits).tolist() == want


def test_a_full_segment_is_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CELL_ROWS", 7)
    codes = [k << 40 for k in range(64)]  # all in one lower segment
    prints = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "__id long, __fp long")
    got = {r["__fp"]: r.component_id for r in simhash_dedup.fingerprint_groups(prints, 2).collect()}
    assert set(got.values()) == {0} and len(got) == 64


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 91), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 91: 90}


def vectors():
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        v = rng.normal(size=16)
        rows.append((1000 - k, v.tolist(), "a"))
        for j in range(k % 4):
            rows.append((2000 + 10 * k + j, (v + rng.normal(size=16) * 0.07).tolist(), "b"))
    rows += [(1, rows[0][1], "copy"), (1, rows[0][1], "copy"), (2, [2 * x for x in rows[4][1]], "")]
    rows += [(3, None, ""), (4, [0.0] * 16, ""), (5, [float("nan")] * 16, ""), (6, [1.0, None] * 8, "")]
    rows += [(7, [float("inf")] * 16, ""), (8, [], ""), (9, [1.0, 2.0, 3.0], ""), (10, [2.0, 4.0, 6.0], "")]
    return rows


@pytest.mark.parametrize("cell_rows", [4096, 5])
def test_embedding_links_equal_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")
    pairs = [
        (a, b)
        for a in range(len(rows))
        for b in range(a + 1, len(rows))
        if brute.usable(rows[a][1])
        and brute.usable(rows[b][1])
        and len(rows[a][1]) == len(rows[b][1])
        and brute.cosine(rows[a][1], rows[b][1]) >= 0.95
    ]
    low = brute.roots([r[0] for r in rows], pairs)
    links = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    want = sorted((r[0], int(n), c, r[0] == c) for r, n, c in zip(rows, links, low))
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == want


def test_embeddings_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(df).count() == 0


@pytest.mark.parametrize(("funcs", "least"), [(2, 0.995), (3, 0.99)])
def test_pairs_at_the_threshold_meet(funcs, least):
    rng = np.random.default_rng(1)
    a = embedding_dedup.unit(rng.normal(size=(4000, 64)))
    z = rng.normal(size=a.shape)
    z = embedding_dedup.unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * z
    probes = embedding_dedup.probes_for(funcs)
    x, y = (embedding_dedup.buckets(v, 3, funcs, probes, 7) for v in (a, b))
    met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean()
    assert met >= least


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose((embedding_dedup.hadamard(x) ** 2).sum(axis=1), (x**2).sum(axis=1))
