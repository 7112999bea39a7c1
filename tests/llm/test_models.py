"""Toxicity, quality, nearest neighbours."""

import random
import zlib

import numpy as np
import pytest

from pageloom.llm import nearest, quality, toxicity

from . import brute

SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def toxic_table(seed=3, n=700):
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        words = prose(rng, rng.randint(20, 120)).split()
        bad = k % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "vilest" + rng.choice(SYLLABLES)]))
        rows.append((k, " ".join(words), "en", 1.0))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxic_documents_are_told_apart(spark):
    rows, labels = toxic_table()
    more = [(9000, None, "", 0.0), (9001, "", "", 0.0), (None, rows[0][1], "", 0.0), (0, rows[0][1], "", 0.0)]
    more.append((9002, "clean words " * 30_000 + "nastyword nastyword nastyword", "", 0.0))
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, grade double")
    table = spark.createDataFrame(labels[:500] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.grade_documents(docs, table).collect()
    assert len(got) == len(rows) + len(more)
    unseen = [r for r in got if r.doc_id is not None and 500 <= r.doc_id < 700]
    assert all(r.toxic == labels[r.doc_id][1] for r in unseen)
    by_id = {r.doc_id: r for r in got}
    assert by_id[9000].toxic == by_id[9001].toxic == 0 and by_id[None].toxic == 1 and by_id[9002].toxic == 1
    assert all(0 <= r.expected_severity <= toxicity.GRADES for r in got)
    kept = toxicity.without_toxic(docs, table)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.toxic)


def test_without_labels_nothing_is_toxic(spark):
    rows, _ = toxic_table(n=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, grade double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxic for r in toxicity.grade_documents(docs, none).collect()} == {0}
    assert toxicity.without_toxic(docs.filter("false"), none).count() == 0


def test_thresholds_are_in_order_and_grades_rise():
    rng = np.random.default_rng(0)
    n = 600
    grades = rng.integers(0, 4, n)
    rows = np.repeat(np.arange(n), grades)
    terms = rng.integers(0, 5, len(rows))
    weights, cuts = toxicity.fit_cumulative(rows, terms, np.ones(len(rows)), grades, 5)
    assert (np.diff(cuts) > 0).all() and (weights > 0).all()
    model = toxicity.Model({"=w": 1.0}, cuts.tolist())
    severe = [s for s, _ in model.severities(["", "w", "w w", "w w w w"], {})]
    assert severe == sorted(severe)


def test_best_cut_lies_between():
    score = np.array([3.0, 2.0, 1.0, -1.0, -1.5])
    assert toxicity.best_cut(score, np.array([1, 1, 1, 0, 0], dtype=bool)) == 0.0
    assert toxicity.best_cut(np.zeros(3), np.array([1, 0, 0], dtype=bool)) == 0.0


def quality_table(n=900):
    rng, rows, labels = random.Random(6), [], []
    for k in range(n):
        bad = k % 5 == 0
        text = prose(rng, rng.randint(30, 200))
        if bad:
            text = [text.upper().replace(" ", "!! "), " ".join([text[:9]] * 60), text.replace(" ", "### ")][k % 3]
        rows.append((k, text, "x", 5))
        if k % 2:
            labels.append((k, 0 if bad else 1))
    return rows, labels


def test_quality_of_the_held_out_fold(spark):
    rows, labels = quality_table()
    more = [(9000, None, "", 0), (9001, " \n", "", 0), (None, rows[1][1], "", 0), (1, rows[1][1], "", 0)]
    more.append((9002, "word " * 50_000, "", 0))
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, score string, predicted int")
    got = quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    fold = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in fold) and len(fold) > 100
    right = sum(r.predicted == (r.doc_id % 5 != 0) for r in fold)
    assert right / len(fold) >= 0.95


def test_held_out_labels_change_nothing(spark):
    rows, labels = quality_table(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, q in labels]
    scores = [
        sorted((r.doc_id, r.score) for r in quality.score_documents(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())
        for x in (labels, flipped)
    ]
    assert scores[0] == scores[1]
    assert quality.score_documents(docs.filter("false"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


@pytest.mark.parametrize("prior", [0.15, 0.5, 0.85])
def test_prior_is_found_from_positives_and_all(prior):
    rng = np.random.default_rng(9)
    n, n_p = 20_000, 4000
    good = rng.random(n) < prior
    places = np.rint(np.where(good, rng.normal(2, 1, n), rng.normal(-2, 1, n)) * 10).astype(int)
    positives = np.rint(rng.normal(2, 1, n_p) * 10).astype(int)
    span = range(-80, 81)
    found = [np.array([(x == k).sum() for k in span], dtype=float) for x in (positives, places)]
    seen = found[1] > 0
    assert abs(quality.estimate_prior(found[0][seen], found[1][seen]) - prior) < 0.06


def ann_rows(n=700, width=24):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, width))
    rows = [(k, (centres[k % 12] + rng.normal(size=width) * 0.6).tolist(), "x") for k in range(n)]
    rows += [(2000 + k, rows[50][1], "copy") for k in range(30)] + [(50, rows[50][1], "again")]
    rows += [(3000, None, ""), (3050, [0.0] * width, ""), (3100, [float("nan")] * width, "")]
    rows += [(3150, [1.0, 2.0], ""), (3151, [2.0, 1.0], ""), (None, rows[3][1], ""), (3200, [], "")]
    return rows


@pytest.mark.parametrize("cell_rows", [8192, 40])
def test_nearest_equal_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(nearest, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 6)
    rows = ann_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got: dict[int, list] = {}
    for r in nearest.nearest_rows(df, lambda c: c % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and brute.usable(v)}
    hits = total = 0
    for q, v in sorted(good):
        if q % 50:
            continue
        near = sorted((-brute.cosine(v, w), i) for i, w in good if i != q and len(w) == len(v))[:5]
        assert len(got[q]) == len(near)
        assert all(abs(s + n[0]) < 1e-9 for (_, s), n in zip(got[q], near)) or cell_rows == 40
        hits += len({i for i, _ in got[q]} & {i for _, i in near})
        total += len(near)
    assert hits / total >= 0.99
    assert [i for i, _ in got[50]] == [2000, 2001, 2002, 2003, 2004]
    assert set(got) == {q for q, _ in good if q % 50 == 0}


def test_nearest_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest_rows(df, lambda c: c % 50 == 0).count() == 0


def test_projected_points_come_in_order():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3000, nearest.DIMS))
    tree = nearest.ChunkTree(points)
    q = rng.normal(size=nearest.DIMS)
    far = ((points - q) ** 2).sum(axis=1)
    seen, last = [], 0.0
    for least, rows in tree.ascending(q):
        assert least >= last - 1e-12 and abs(least - far[rows].min()) < 1e-12
        last = far[rows].max()
        seen += rows.tolist()
    assert sorted(seen) == list(range(3000))


def test_chi_squared_quantile():
    draws = (np.random.default_rng(0).normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert abs(np.quantile(draws, 0.99) - nearest.chi_squared_quantile(0.99, 8)) < 0.2


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    """Multiples of one vector, and binary vectors at one cosine."""
    rng = np.random.default_rng(4)
    order = rng.permutation(40) + 1
    rows = [(0, [1.0, 2.0, 3.0, 4.0])] + [(int(i), [float(k + 1) * c for c in (1, 2, 3, 4)]) for k, i in enumerate(order)]
    rows += [(100 + k, [float(x) for x in rng.normal(size=4)]) for k in range(1, 40)]
    width = 12
    rows += [(200, [1.0] * width)]
    rows += [(int(i), [0.0 if j == k % width else 1.0 for j in range(width)]) for k, i in enumerate(rng.permutation(60) + 201)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.nearest_rows(df, lambda c: c.isin(0, 200)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got[0]) == [(k, k) for k in range(1, 6)]
    assert sorted(got[200]) == [(k, 200 + k) for k in range(1, 6)]


def plain_ordinal_loss(p, x, grades, count):
    """Mean log loss of ordered cuts, row by row; ``p`` holds weights, the first cut and gaps."""
    w, first, raw = p[: x.shape[1]], p[x.shape[1]], p[x.shape[1] + 1 :]
    cuts = [first]
    for r in raw:
        cuts.append(cuts[-1] + np.log1p(np.exp(r)))
    total = 0.0
    for row, grade in zip(x, grades):
        for k in range(count):
            above = 1 / (1 + np.exp(cuts[k] - row @ w))
            total -= np.log(above if grade > k else 1 - above)
    return total / len(grades), np.array(cuts)


def test_ordinal_fit_equals_a_plain_descent():
    rng = np.random.default_rng(5)
    n, width = 150, 3
    x = rng.integers(0, 3, (n, width)).astype(float)
    drive = x @ np.array([1.2, 0.6, -0.3]) + rng.logistic(size=n)
    grades = (drive[:, None] > np.array([0.5, 2.0, 3.0])).sum(axis=1)
    rows, terms = np.nonzero(x)
    weights, cuts = toxicity.fit_cumulative(rows, terms, x[rows, terms], grades, width)
    p = np.zeros(width + toxicity.GRADES)
    loss, _ = plain_ordinal_loss(p, x, grades, toxicity.GRADES)
    step = 1.0
    for _ in range(120):
        slope = np.array(
            [
                (plain_ordinal_loss(p + 1e-5 * e, x, grades, toxicity.GRADES)[0] - loss) / 1e-5
                for e in np.eye(len(p))
            ]
        )
        while (there := plain_ordinal_loss(p - step * slope, x, grades, toxicity.GRADES)[0]) > loss and step > 1e-6:
            step /= 2
        p, loss, step = p - step * slope, min(loss, there), step * 2
    _, plain_cuts = plain_ordinal_loss(p, x, grades, toxicity.GRADES)

    def severity(w, at):
        return (1 / (1 + np.exp(at[None, :] - (x @ w)[:, None]))).sum(axis=1)

    assert np.abs(severity(weights, cuts) - severity(p[:width], plain_cuts)).max() < 0.15


def test_risk_of_the_classifier_is_least(spark):
    """Sums of a pass against a plain loop, and no near weights with a smaller risk."""
    rng = np.random.default_rng(8)
    n = 400
    good = rng.random(n) < 0.3
    f = rng.normal(size=(n, len(quality.FEATURES)))
    f[:, 0] += good * 1.5
    f[:, 1] -= good
    rows = [([float(v) for v in r], bool(g), 1 if g else None) for r, g in zip(f, good)]
    df = spark.createDataFrame(rows, "__f array<double>, __good boolean, __q int").repartition(3)
    borders = [np.array([-0.5, 0.5]) if k < 2 else np.zeros(0) for k in range(len(quality.FEATURES))]
    x = np.zeros((n, 1 + sum(len(b) + 1 for b in borders)))
    for k in range(n):
        x[k, 0], at = 1, 1
        for j, cuts in enumerate(borders):
            x[k, at + sum(f[k, j] >= c for c in cuts)] = 1
            at += len(cuts) + 1
    w = rng.normal(size=x.shape[1])
    found = quality.sums(df, borders, w)
    g = x @ w
    s = 1 / (1 + np.exp(-g))
    assert (found["rows"], found["good"]) == (n, good.sum())
    assert found["loss_u"] == pytest.approx(sum(np.log1p(np.exp(v)) for v in g))
    assert found["loss_p"] == pytest.approx(sum(np.log1p(np.exp(v)) for v in g[good]))
    assert found["grad_u"] == pytest.approx(sum(a * b for a, b in zip(s, x)))
    assert found["curve"] == pytest.approx(sum(a * (1 - a) * np.outer(b, b) for a, b in zip(s, x)))
    prior = 0.4
    best = quality.train(df, borders, prior)
    keep = np.full(x.shape[1], quality.DECAY)
    keep[0] = 1e-8

    def risk(v):
        z = x @ v
        return np.logaddexp(0, z).mean() - prior * z[good].mean() + 0.5 * (keep * v * v).sum()

    z = x @ best
    assert np.logaddexp(0, z).mean() - prior * np.logaddexp(0, z[good]).mean() >= 0
    least = risk(best)
    assert all(risk(best + rng.normal(size=len(best)) * size) >= least - 1e-4 for size in (0.05, 0.3, 1) for _ in range(50))
