from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm import packing as pk
from strandline.llm import token_counts as tc
from strandline.llm.common import most_frequent
from tests.llm.helpers import frame, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    "", " ", "  a  b ", "\n", "\n\na b", "a\n b", "a▁b  x", "<s> </s> <unk>", "x\0y z", " \n", "\t\ta", "é x", "日本 語", "a" * 3000, "Ａ ﬁ ½", "it's  '' 's", "<|endoftext|> a", "½ x²", "\x1c a \x85b", "a b  \n\n c  ", "🙂 ok",
]


@pytest.mark.parametrize("head", [0, 3, 200_000])
def test_counts_are_the_library_s(spark, monkeypatch, head):
    import sentencepiece

    r = random.Random(1)
    texts = TEXTS + [prose(r, 200), "".join(r.choice(" \nab▁é.") for _ in range(400))]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = frame(spark, [*enumerate(texts), (500, None), (0, texts[0]), (None, texts[5])])
    got = tc.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), head=head).collect()  # the rest is joined by a shuffle
    assert len(got) == len(texts) + 3
    report = tc.token_report(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=100)
    assert sorted((x["n_tokens"], x["over_limit"]) for x in report.collect()) == sorted((x["n_tokens"], x["n_tokens"] > 100) for x in got)
    for x in got:
        text = texts[5 if x["doc_id"] is None else x["doc_id"]] if x["doc_id"] != 500 else ""
        assert (x["n_bytes"], x["n_tokens"]) == (len(text.encode()), len(model.encode(text))), text
    monkeypatch.setattr(tc, "HELD_CHARS", 10)
    monkeypatch.setattr(tc, "SENT", 2)
    counted = tc.with_pieces(tc.distinct_pretokens(docs), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len({x["p"] for x in counted}) == len(counted)  # each distinct pre-token is counted once
    assert tc.count_tokens(frame(spark, []).where("false"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_most_frequent_rows(spark):
    rows = spark.createDataFrame([(i, 1 + i // 3) for i in range(300)], "i int, n long")
    got = [r["n"] for r in most_frequent(rows, 50).collect()]
    assert 25 < len(got) <= 50 and min(got) > 80
    assert most_frequent(rows, 2).count() == 0 and most_frequent(rows, 300).count() == 300 and most_frequent(rows.where("false"), 5).count() == 0


def test_a_model_that_could_cross_a_cut_is_refused():
    class Crossing:
        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")

    with pytest.raises(ValueError):
        tc.check_model(Crossing())


def test_cut():
    assert pk.cut(1, 4) == [(0, 1)] and pk.cut(4, 4) == [(0, 4)] and pk.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def best_fit_decreasing(lengths) -> int:
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = min((k for k in range(len(room)) if room[k] >= n), key=lambda k: room[k], default=None)
        if k is None:
            room.append(2048 - n)
        else:
            room[k] -= n
    return len(room)


@pytest.mark.parametrize("fast", [True, False])
def test_packing_round_trip(spark, fast):
    from tokenizers import Tokenizer

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    r = random.Random(2)
    rows = [*enumerate(TEXTS), *((100 + i, prose(r, r.randrange(1, 900))) for i in range(60)), (300, prose(r, 3000)), (301, None), (300, "again")]
    got = pk.pack(frame(spark, rows), path, ranks if fast else None).collect()
    library = Tokenizer.from_file(path)
    expected = []
    for d, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(pk.cut(len(ids), 2048))]
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == sorted(expected)
    sequences = defaultdict(list)
    for x in got:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= best_fit_decreasing([e[3] for e in expected])
    assert pk.pack(frame(spark, []).where("false"), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(2049, dtype=np.int64)
    top = [2048, 300, 2048, 1500][seed]
    np.add.at(counts, rng.integers(1, top + 1, [20_000, 500, 37, 3][seed]), 1)
    plan = pk.Plan(counts)
    lengths = np.repeat(np.arange(2049), counts)
    number = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = plan.place(lengths, number)
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], lengths[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all() and (o + n).max() <= 2048
    assert len(set(s.tolist())) == plan.sequences
    assert plan.sequences <= pk.Draft(counts, 2048, 32, []).sequences  # never more than best fit alone
    if seed == 0:
        assert plan.sequences <= 1.005 * -(-lengths.sum() // 2048)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_cost_no_sequence(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(2049, dtype=np.int64)
    np.add.at(counts, np.clip(rng.lognormal(6, 1, 400 * (seed + 1)).astype(int), 1, 2048), 1)
    plan, alone = pk.Plan(counts), pk.Draft(counts, 2048, 32, [])
    assert plan.sequences <= alone.sequences
    assert plan.by_pattern > 0.05 * counts.sum()


def test_nonnegative_fit():
    rng = np.random.default_rng(1)
    a, x = rng.random((6, 20)), np.zeros(20)
    x[[2, 7]] = 3.0, 1.5
    fit = pk.nonnegative_fit(a, a @ x, 5000)
    assert (fit >= 0).all() and np.linalg.norm(a @ fit - a @ x) < 1e-2
    assert all(sum(p) == 12 and len(p) <= 3 and list(p) == sorted(p, reverse=True) for p in pk.patterns(12, 3))
