from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import centroids as ce
from strandline.llm import spellings as sp
from tests.llm.helpers import frame, lower


def brute_words(rows) -> dict[str, int]:
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def spelt(seed: int):
    """Texts of words with variants of every kind, several levels of forms, and letters beyond ASCII."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abéÀ") for _ in range(r.randrange(6, 9))) for _ in range(25)]
    bag = []
    for s in stems:
        for n in (250, 40, 6, 5, 1):
            bag += [s] * n
            at, kind = r.randrange(len(s)), r.randrange(3)
            s = s[:at] + ("" if kind == 0 else r.choice("abéß÷")) + s[at + (kind < 2) :]
    r.shuffle(bag)
    cuts = [0, *sorted(r.sample(range(len(bag)), 60)), len(bag)]
    return [(i, r.choice([" ", ", ", "7"]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in bag[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(sp, "HELD", 40)
    monkeypatch.setattr(sp, "PLACES", 50)
    monkeypatch.setattr(sp, "WORDS", 20)
    long = "x" * 3000
    rows = [*spelt(seed), (500, None), (501, ""), (None, "Abcdefg abcdefg"), (3, "abcdefg " * 3), (3, "abcdefg " * 3), (502, f"{long} {long}y " * 6), (503, "日本 abcdeé")]
    got = {tuple(x) for x in sp.spelling_variants(frame(spark, rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    expected = brute_variants(rows)
    assert got == expected
    assert any(form and root != form for _, _, _, form, _, root in expected) and any(n_near > 1 for _, _, n_near, *_ in expected)


def test_no_words(spark):
    assert sp.spelling_variants(frame(spark, []).where("false")).count() == 0
    assert sp.spelling_variants(frame(spark, [(1, "short of six"), (2, None)])).count() == 0


def test_edits_are_all_and_distinct():
    alphabet = np.array([ord(c) for c in "abé"])
    for words in (["aabb", "éaab"], ["a"], ["bbbb"]):
        made = Counter()
        for h, word, place, letter in sp.edits(words, alphabet):
            for x, w, p, c in zip(h.tolist(), word.tolist(), place.tolist(), letter.tolist()):
                text = sp.edited(words[w], p, c)
                assert sp.hash_of(text) == x if text else True
                made[w, text] += 1
        assert set(made.values()) == {1}
        for w, word in enumerate(words):
            every = {"".join(t) for n in (len(word) - 1, len(word), len(word) + 1) for t in itertools.product("abé", repeat=n)}
            assert {t for v, t in made if v == w} == {t for t in every if one_edit(t, word)}


def lloyd(vectors, many=8, rounds=10):
    """All distances in every round, in Python's integers."""
    first = sorted(vectors, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:many]
    centroids = [list(v) for _, v in first]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in vectors]
    for _ in range(rounds):
        owners = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, o) in zip(vectors, owners) if o == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    final = assign()
    total = Counter()
    for d, k in final:
        total[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, k, d, total[k], sum(total.values()), digest[k]) for (i, _), (d, k) in zip(vectors, final))


@pytest.mark.parametrize("seed", range(3))
def test_clusters_are_those_of_full_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, [0.1, 1.0, 0.002][seed], (120, 64)) + rng.integers(0, 4, (120, 1))
    rows = [(i, [float(np.float32(c)) for c in v], "x", 1) for i, v in enumerate(x)]
    rows += [(None, rows[5][1], "x", 1), (7, rows[7][1], "y", 2), (7, rows[9][1], "y", 2), (900, [0.0] * 64, "y", 2)]
    bad = [(901, None, "z", 0), (902, [1.0] * 63, "z", 0), (903, [float("nan")] + [0.0] * 63, "z", 0), (904, [None] + [0.0] * 63, "z", 0), (905, [float("-inf")] + [0.0] * 63, "z", 0), (906, [], "z", 0)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, owner string, v int").repartition(5)
    got = Counter(tuple(r) for r in ce.cluster(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == lloyd([(i, [int(np.floor(1024 * c)) for c in v]) for i, v, *_ in rows])


def test_few_far_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert ce.cluster(spark.createDataFrame([], schema)).count() == 0
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-3.0] * 64)]
    got = Counter(tuple(r) for r in ce.cluster(spark.createDataFrame(few, schema)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == lloyd([(i, [int(np.floor(1024 * c)) for c in v]) for i, v in few])
    far = ce.cluster(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), *((i, [float(2**20 + i)] * 64) for i in range(3, 20))], schema)).collect()
    assert len(far) == 19 and all(r["distance"] >= 0 for r in far)


def test_only_changed_centroids_and_moved_owners_are_compared(monkeypatch):
    rng = np.random.default_rng(1)
    v, seen = rng.integers(-50, 50, (500, 4)).astype(np.int32), []
    real = ce.squared_distances
    monkeypatch.setattr(ce, "squared_distances", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    c = rng.integers(-50, 50, (8, 4))
    owner, distance = ce.assigned(v, np.full(500, -1, dtype=np.int32), np.zeros(500, dtype=np.int64), c, np.ones(8, dtype=bool))
    assert sum(seen) == 4000
    moved, changed = c.copy(), np.zeros(8, dtype=bool)
    moved[2] += 9
    changed[2] = True
    seen.clear()
    again, d = ce.assigned(v, owner, distance, moved, changed)
    assert sum(seen) == 8 * (owner == 2).sum() + (owner != 2).sum() < 2000
    full = real(v, moved)
    assert (again == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
