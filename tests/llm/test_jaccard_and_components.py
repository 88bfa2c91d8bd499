from __future__ import annotations

import itertools
import random

import pyarrow as pa
import pytest

from strandline.llm import jaccard_join as jj
from strandline.llm import shingles as sh
from strandline.llm.common import Workspace
from strandline.llm.components import connected_components
from tests.llm.helpers import WORD, components, frame, lower, prose, shingles


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    ids = {d for d, _ in sets}
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2) if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    part = components(ids, links)
    return sorted((d, len(s), part[d]) for d, s in sets)


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def corpus(seed: int):
    r = random.Random(seed)
    rows, line = [], prose(r, 12)
    base = prose(r, 150).split()
    for i in range(40):  # one group of near copies, some of them too far from each other
        copy = list(base)
        for _ in range(r.randrange(1, 7)):
            copy[r.randrange(len(copy))] = f"edit{r.randrange(1000)}"
        rows.append((1000 - i, " ".join(copy)))
    rows += [(2000 + i, prose(r, r.randrange(1, 80)) + "\n" + line) for i in range(60)]  # a common line
    rows += [(3000 + i, line) for i in range(15)] + [(3100 + i, line.upper() + " ") for i in range(3)]
    rows += [(4000 + i, " ".join([line, *(f"t{j}" for j in range(i % 4))])) for i in range(20)]
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "One"), (5005, "a b c"), (5006, "a  b\nc"), (5007, prose(r, 6000))]
    rows += [(5007, rows[-1][1]), (6000, "é É word Ü"), (6001, "é é word Ü")]
    return rows


@pytest.mark.parametrize(("short", "rare"), [(12, 32), (2, 2), (1, 0)])
def test_matches_brute_force(spark, monkeypatch, short, rare):
    monkeypatch.setattr(jj, "SHORT", short)
    monkeypatch.setattr(jj, "RARE", rare)
    rows = corpus(7)
    assert found(jj.jaccard_components(frame(spark, rows))) == brute(rows)


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(84)]  # 80 shingles
    other = [*words[:80], "x1", "x2", "x3", "x4"]  # 76 of them
    rows = [(1, " ".join(words)), (2, " ".join(words[:-16])), (3, " ".join(words[:-17])), (4, " ".join(other))]
    assert len(shingles(rows[1][1])) == 64
    assert found(jj.jaccard_components(frame(spark, rows))) == brute(rows)


def test_few_rows(spark):
    assert jj.jaccard_components(frame(spark, []).where("false")).count() == 0
    got = {(r[0], r[1], r[2]) for r in jj.jaccard_components(frame(spark, [(4, "a b"), (None, "a b"), (3, "c")])).collect()}
    assert got == {(4, 1, 4), (None, 1, 4), (3, 1, 3)}


@pytest.mark.parametrize("ids", [jj.BROADCAST_IDS, 0])
def test_one_document_of_each_group_stays(spark, monkeypatch, ids):
    monkeypatch.setattr(jj, "BROADCAST_IDS", ids)
    monkeypatch.setattr(jj, "LEAST_BITS", 64)  # so full that it lets other rows pass too
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "z"), (None, "a b c d e f g"), (2, "other"), *((10 + i, f"q{i}") for i in range(40))]
    docs = frame(spark, rows)
    kept = jj.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, *range(10, 50)]


def test_word_hashes_follow_the_words():
    r = random.Random(1)
    texts = ["", " ", "A b\n\tc  D e F", "x" * 5000 + " y", "Éa éA", prose(r, 3000)]
    for text in texts:
        words = WORD.findall(lower(text))
        h = sh.word_hashes(text.encode())
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
        assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words))
        assert len(sh.shingle_set(text.encode(), 5)) == len(shingles(text))


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_texts_hashed_together_are_hashed_alike(at_once):
    r = random.Random(3)
    texts = ["", "a", "b", " ", "a b c d e", "x" * 50, "", "no end", "\n", "word", *(prose(r, r.randrange(30)) for _ in range(30)), "Éa\u00a0éA", ""]
    for column in (pa.array(texts), pa.array(["before", *texts, "z"])[1:-1], pa.array(texts, pa.large_string()), pa.array([], pa.string()), pa.array([""])):
        got = list(sh.shingle_sets(column, 5, at_once))
        assert [g.tolist() for g in got] == [sh.shingle_set(t.encode(), 5).tolist() for t in column.to_pylist()]


def test_words_of_few_letters_do_not_collide():
    for size in (8, 9, 64, 1024, 4096):
        swap = bytes.maketrans(b"ab", b"ba")
        word = b"a"
        while len(word) < size:  # the sequence on which sums of powers modulo 2**64 fail
            word += word.translate(swap)
        words = [word[:size], word[:size].translate(swap), b"a" * size, b"b" * size, b"a" * (size - 1) + b"b", b"b" + b"a" * (size - 1), b"\0" * size, b"\0" * (size + 1)]
        assert len({int(sh.word_hashes(w)[0]) for w in words}) == len(words)


def test_common_line_without_near_copies_makes_no_pairs(spark, tmp_path):
    """Documents that share most of their shingles, but too few: index skipping leaves nothing to compare."""
    line = " ".join(f"common{i}" for i in range(104))
    rows = [(i, line + " " + " ".join(f"own{i}x{j}" for j in range(18))) for i in range(120)]
    index = jj.Index(frame(spark, rows), 5, "doc_id", Workspace(spark, "t"))
    assert index.lists.count() > 120 and index.pairs.count() == 0
    classes = spark.createDataFrame([], "node long, component long")
    none = spark.createDataFrame([], "a long, b long, low double, high double")
    assert jj.open_pairs(index, classes, none).count() == 0
    assert found(jj.jaccard_components(frame(spark, rows))) == brute(rows)


def test_rows_without_an_id_link_too(spark):
    r = random.Random(8)
    words = prose(r, 60).split()
    near = " ".join([*words[:-1], "other"])
    got = {(r[0], r[2]) for r in jj.jaccard_components(frame(spark, [(None, near), (7, " ".join(words)), (7, prose(r, 30)), (None, prose(r, 9))])).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (1000, 1000)]
    got = connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long"), Workspace(spark, "t"))
    nodes = {x for a, b in links for x in (a, b) if a != b}
    expected = components({x for link in links for x in link}, links)
    assert {r[0]: r[1] for r in got.collect()} == {n: expected[n] for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("short", [12, 2])
def test_every_link_counts(spark, monkeypatch, short):
    monkeypatch.setattr(jj, "SHORT", short)
    rows = corpus(7)
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = [(d, sum(i in p for p in links)) for i, (d, _) in enumerate(rows)]
    assert sorted(tuple(r) for r in jj.jaccard_links(frame(spark, rows)).collect()) == sorted(want)
    distinct = {frozenset((sets[i], sets[j])) for i, j in links if sets[i] != sets[j]}
    got = [(r["a"], r["b"]) for r in jj.linked_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) == len(distinct) and all(a < b for a, b in got)
