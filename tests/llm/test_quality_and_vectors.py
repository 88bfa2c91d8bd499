from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from strandline.llm import embedding_dups as ed
from strandline.llm import quality as qu
from tests.llm.helpers import components, frame, prose


def graded(n: int):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        words = prose(r, r.randrange(20, 200)).split()
        if not good:
            words = [w + r.choice(["***", "%%%", "$$$"]) for w in words] if r.random() < 0.5 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = graded(900)
    marks = spark.createDataFrame([*labels[:600], (0, None, 0), (None, 1, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*rows, (5000, None), (5001, ""), (5, rows[5][1]), (None, "x y")])
    got = qu.score_documents(docs, marks).collect()
    assert len(got) == 904
    truth = {d: q for d, q, _ in labels}
    hits = [x["predicted"] == truth[x["doc_id"]] for x in got if x["held_out"] and x["doc_id"] in truth]
    assert len(hits) > 150 and sum(hits) / len(hits) > 0.98
    for x in got:
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"] if x["doc_id"] is not None else "").encode()) % 5 == 0)
    kept = qu.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert kept.count() == sum(x["predicted"] for x in got)


def test_matches_a_direct_fit(spark):
    """The tasks' summed equations, folds and bins against the same model fitted over all rows at once."""
    rows, labels = graded(400)
    got = {x["doc_id"]: x["score"] for x in qu.score_documents(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    s = np.array([qu.statistics_of(t) for _, t in rows])
    fold = np.array([zlib.crc32(str(d).encode()) % 5 for d, _ in rows])
    y = np.array([float(q) for _, q, _ in labels])
    learn = fold != 0
    sd = s[learn].std(0)
    model = qu.Model(s[learn].mean(0), np.where(sd > 1e-9, sd, 1.0))
    z = model.features(s)

    def ridge(at):
        penalty = np.diag([1e-9, *[qu.RIDGE * at.sum() / qu.FEATURES] * qu.FEATURES])
        return np.linalg.solve(z[at].T @ z[at] + penalty, z[at].T @ y[at])

    out = np.zeros(len(y))
    for f in (1, 2, 3, 4):
        out[fold == f] = np.clip(z[fold == f] @ ridge(learn & (fold != f)), 0, 1)
    at = np.minimum((out * qu.BINS).astype(int), qu.BINS - 1)
    used = sorted(set(at[learn].tolist()))
    mean = np.array([y[learn & (at == b)].mean() for b in used])
    weight = np.array([(learn & (at == b)).sum() for b in used], dtype=float)
    calm = [max(min(np.average(mean[i : j + 1], weights=weight[i : j + 1]) for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]  # isotonic by its minimax rule
    raw = np.clip(z @ ridge(learn), 0, 1)
    centre = np.array([(b + 0.5) / qu.BINS for b in used])
    steps = np.split(np.arange(len(used)), np.flatnonzero(~np.isclose(calm[1:], calm[:-1])) + 1)
    knots = [np.average(centre[b], weights=weight[b]) for b in steps], [calm[b[0]] for b in steps]
    want = 0.99 * np.interp(raw, *knots) + 0.01 * raw
    assert np.allclose([got[d] for d, _ in rows], want, atol=1e-6)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = graded(200)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    scores = [sorted((x["doc_id"], x["score"]) for x in qu.score_documents(frame(spark, rows), spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect()) for m in (labels, turned)]
    assert np.allclose([s for _, s in scores[0]], [s for _, s in scores[1]], atol=1e-9)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x["score"] for x in qu.score_documents(frame(spark, [(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert qu.score_documents(frame(spark, []).where("false"), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert qu.score_documents(frame(spark, [(1, "a"), (2, None)]), one).count() == 2


def test_isotonic():
    x, y = qu.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 0.6, 0.4, 1.0]), np.array([1.0, 1.0, 1.0, 2.0]))
    assert np.allclose(x, [0.1, 0.25, 0.4]) and np.allclose(y, [0, 0.5, 1])


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    s = rng.standard_normal((40, len(qu.STATS)))
    z = qu.Model(np.zeros(len(qu.STATS)), np.ones(len(qu.STATS))).features(s)[:, 1:]
    exact = np.exp(-((s[:, None] - s[None]) ** 2).sum(2) / 2 / len(qu.STATS))
    assert np.abs(z @ z.T - exact).mean() < 0.08


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, many int")


def expected(rows, threshold=0.9):
    x = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and len(v) and None not in v]
    x = [(i, v / np.linalg.norm(v)) for i, v in x if np.isfinite(v).all() and v.any()]
    links = [(a, b) for k, (a, v) in enumerate(x) for b, w in x[:k] if len(v) == len(w) and v @ w >= threshold]
    part = components({i for i, _ in rows}, links)
    return sorted((i, sum(i in p for p in links), part[i], part[i] == i) for i, _ in rows)


def many(seed: int, n: int, d: int = 24):
    rng = np.random.default_rng(seed)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((n, d)))]
    for k in range(n // 4):  # near copies and scaled ones
        v = np.array(rows[k % 17][1])
        rows.append((n + k, (v * rng.uniform(0.5, 3) + 0.18 * rng.standard_normal(d)).astype(np.float32).tolist()))
    rows += [(5000 + k, rows[3][1]) for k in range(30)]
    return rows


@pytest.mark.parametrize(("block", "chunk", "lists"), [(1024, 16_384, 256), (8, 20, 16)])
def test_vectors_match_brute_force(spark, monkeypatch, block, chunk, lists):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("LIST_ROWS", lists)):
        monkeypatch.setattr(ed, name, value)
    rows = many(3, 300)
    d = len(rows[0][1])
    rows += [(8000 + k, rows[k][1][:20]) for k in range(60)] + [(8100 + k, rows[k][1][:5]) for k in range(9)] + [(8200, rows[0][1][:20]), (8201, rows[0][1][:5] + [0.0])]
    rows += [(9000, None), (9001, []), (9002, [0.0] * d), (9003, [float("nan")] * d), (9004, [float("inf")] + [1.0] * (d - 1)), (9005, [None] + [1.0] * (d - 1)), (9006, [1.0, 2.0])]
    monkeypatch.setattr(ed, "FOLDED", 50)
    got = sorted(tuple(r) for r in ed.near_duplicates(vectors(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect())
    want = expected(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) and sum(g[1] > w[1] for g, w in zip(got, want)) == 0
    assert sum(g == w for g, w in zip(got, want)) >= 0.99 * len(want)


def test_few_vectors(spark):
    assert ed.near_duplicates(vectors(spark, []).where("false")).count() == 0
    assert [tuple(r) for r in ed.near_duplicates(vectors(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
    got = sorted(tuple(r) for r in ed.near_duplicates(vectors(spark, [(4, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])])).collect())
    assert got == [(2, 1, 2, True), (3, 0, 3, True), (4, 1, 2, False)]


def test_doubles_and_repeated_ids(spark):
    rows = [(1, [3.0, 4.0]), (1, [4.0, -3.0]), (2, [6.0, 8.0]), (3, [1e200, -7.5e199]), (4, [0.6, 0.8])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ed.near_duplicates(docs).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False)]


SPREADS = {
    "low rank": lambda rng: rng.standard_normal((500, 3)) @ rng.standard_normal((3, 48)) + 0.01 * rng.standard_normal((500, 48)),
    "clusters": lambda rng: np.repeat(rng.standard_normal((25, 32)), 20, axis=0) + 0.25 * rng.standard_normal((500, 32)),
    "even": lambda rng: np.vstack([x := rng.standard_normal((250, 24)), x + 0.3 * rng.standard_normal((250, 24))]),
}


@pytest.mark.parametrize("spread", SPREADS)
def test_no_link_is_lost_whatever_the_spread(spark, monkeypatch, spread):
    monkeypatch.setattr(ed, "LIST_ROWS", 16)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(SPREADS[spread](np.random.default_rng(5)))]
    got = sorted(tuple(r) for r in ed.near_duplicates(vectors(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect())
    want = expected(rows)
    assert got == want and sum(w[1] for w in want) > 100  # recall 1


def test_exact_ties_link(spark):
    """Integer vectors whose cosine is 9/10 exactly, or the least bit beside it."""
    r, pairs = random.Random(12), []
    while len(pairs) < 40:
        a, b = [r.randrange(-9, 10) for _ in range(4)], [r.randrange(-9, 10) for _ in range(4)]
        dot, squares = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) * sum(y * y for y in b)
        if dot > 0 and 100 * dot * dot == 81 * squares:
            pairs.append((a, b))
    assert ((5, 5, 1, -7) and ed.reaches(np.array([5.0, 5, 1, -7]), np.array([2.0, 2, 0, -1]), 0.9))
    near = [([9.0, 19.0**0.5, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0])]  # the root is not exact, so neither is the tie
    rows = []
    for k, (a, b) in enumerate(pairs + near):  # each pair in dimensions of its own
        for j, v in enumerate((a, b)):
            rows.append((2 * k + j, [0.0] * (4 * k) + [float(x) for x in v] + [0.0] * (4 * (len(pairs) - k))))
    got = {x["vec_id"]: x["n_links"] for x in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 1 for k in range(len(pairs)))
    from fractions import Fraction

    expected = Fraction(9) ** 2 * 100 >= 81 * (Fraction(9) ** 2 + Fraction(19.0**0.5) ** 2)
    assert got[2 * len(pairs)] == int(expected)
