from __future__ import annotations

import hashlib
import random

import pytest

from strandline.llm import piece_spans as ps
from tests.llm.helpers import frame, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  a  b ", "\n", "\n\na b", "a\n b", "a▁b  x", "<s> </s> <unk>", "x\0y z", " \n", "\t\ta", "é x", "日本 語", "a" * 3000, "Ａ ﬁ ½", "𓀀𓀁 b", "à́b", "　x　", "½½ﬁ", "﻿", "ｶﾞ ㌀", "é   z",
]


def random_texts(n: int) -> list[str]:
    r = random.Random(5)
    return ["".join(r.choice(" \nab▁é.日𓀀ﬁ½Ａ̀　 ｶﾞ㌀") for _ in range(r.randrange(60))) for _ in range(n)]


def test_ids_spans_and_texts_are_the_library_s(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(6)
    texts = TEXTS + random_texts(150) + [prose(r, 5000)]
    docs = frame(spark, [*enumerate(texts), (1000, None), (0, texts[4]), (None, texts[5])])
    rows = ps.encode_with_spans(docs, PATH).collect()
    assert len(rows) == len(texts) + 3
    for x in rows:
        options = [""] if x["doc_id"] == 1000 else [texts[5]] if x["doc_id"] is None else [texts[0], texts[4]] if x["doc_id"] == 0 else [texts[x["doc_id"]]]
        text = next(t for t in options if library.encode(t, add_eos=True) == list(x["ids"]))
        assert x["decoded"] == library.decode(list(x["ids"]))
        proto = library.encode(text, return_type="proto").pieces
        assert list(zip(x["ids"], x["begins"], x["ends"]))[:-1] == [(p.id, p.begin, p.end) for p in proto]
        raw = text.encode()
        assert x["begins"][-1] == x["ends"][-1] == len(raw) and b"".join(raw[a:b] for a, b in zip(x["begins"], x["ends"])) == raw
    report = {(y["doc_id"], y["ids_sha256"]): y for y in ps.encoding_report(docs, PATH).collect()}
    for x in rows:
        y = report[x["doc_id"], hashlib.sha256(" ".join(map(str, x["ids"])).encode()).hexdigest()]
        assert y["n_tokens"] == len(x["ids"]) and y["decoded_sha256"] == hashlib.sha256(x["decoded"].encode()).hexdigest()
    assert ps.encode_with_spans(frame(spark, []).where("false"), PATH).count() == 0


def test_pieces_of_the_source(spark):
    docs = frame(spark, [(1, "né à la  mode")])
    back = ps.encode_with_spans(docs, PATH).join(docs, "doc_id").select(ps.surfaces(*map(ps.F.col, ("text", "begins", "ends"))).alias("s"))
    assert b"".join(back.first()["s"]).decode() == "né à la  mode"


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("merged", [True, False])
def test_rewriting_is_the_library_s(rule, merged):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": merged}
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **spec)
    model = ps.Model(PATH)
    model.rules = sentencepiece_model_pb2.NormalizerSpec.FromString(library.serialized_normalizer_spec())
    model.rules.add_dummy_prefix, model.rules.escape_whitespaces, model.rules.remove_extra_whitespaces = True, True, merged
    model.map = ps.CharacterMap(model.rules.precompiled_charsmap)
    for text in TEXTS + random_texts(300):
        expected, places = library.normalize(text, with_offsets=True)
        new, origin = model.normalised(text)
        assert new.decode() == expected, text
        if not expected:
            continue
        raw, at = text.encode(), 0
        got = []
        for c in [*expected, ""]:  # characters, as the library counts
            got.append(len(raw[: origin[at]].decode()))
            at += len(c.encode())
        assert got == list(places), text
