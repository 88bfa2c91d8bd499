from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat as ch
from strandline.llm import warc as wa
from strandline.llm.common import Workspace
from tests.llm.helpers import prose


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def test_round_trip(spark):
    r = random.Random(1)
    long = prose(r, 60_000)
    rows = [(5, "http://a/\r\nX: y", long), (2, "http://b", long), (9, None, long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "é" * 50), (1, "u", "é" * 50), (10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9), (11, "u", "z" * 99), (12, "u", "z" * 99), (2, "http://b", long)]
    got = sorted(tuple(x) for x in wa.round_trip(pages(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    expected = []
    for p, _, h in rows:
        raw = (h or "").encode()
        first = min(q for q, _, g in rows if (g or "") == (h or ""))
        again = len(raw) >= 100 and first != p
        expected.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert [(*x[:4], x[4] or 0) for x in got] == sorted((*x[:4], x[4] or 0) for x in expected)


def test_archives_hold_whole_records(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, f"http://h/{i}", prose(r, 300 * i)) for i in range(1, 30)]
    path = f"{tmp_path}/archive"
    wa.write_warc(pages(spark, rows), path, segment_bytes=4000)
    kinds = []
    for file in (tmp_path / "archive").glob("part*"):
        raw = file.read_bytes()
        while raw:  # a member holds one record and no more
            member = zlib.decompressobj(31)
            one = list(wa.parse(io.BytesIO(member.decompress(raw))))
            raw = member.unused_data
            assert member.eof and len(one) == 1 and one[0][1] is not None
            kinds.append(one[0][0]["warc-type"])
    assert kinds.count("response") == 29 and kinds.count("continuation") > 29
    back = {x["page_id"]: x for x in wa.read_warc(spark, path).collect()}
    assert {k: v["payload"].decode() for k, v in back.items()} == {p: h for p, _, h in rows} and all(x["complete"] for x in back.values())
    records = wa.read_records(spark, path)
    lost = wa.reassemble(records.where("segment is null or segment <> 2")).where("not complete")
    assert lost.count() == sum(len(wa.HEAD + wa.chunked(h.encode())) > 4000 for _, _, h in rows) and lost.where("payload is not null").count() == 0
    short = wa.reassemble(records.withColumn("total", F.col("total") + 1)).where("not complete").count()
    assert short == lost.count()


def test_files_take_a_bounded_number_of_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wa, "BUNDLE_BYTES", 3000)
    monkeypatch.setattr(wa, "BUNDLES_PER_FILE", 2)
    rows = [(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 9) for i in range(200)]
    wa.write_warc(pages(spark, rows).coalesce(1), f"{tmp_path}/a")
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part*")]
    assert len(sizes) > 5 and max(sizes) < 10_000
    assert sorted(r["page_id"] for r in wa.read_warc(spark, f"{tmp_path}/a").collect()) == list(range(200))


def test_foreign_and_damaged_archives(spark, tmp_path):
    made = [wa.records_of(i, "u", b"payload %d" % i, "d", None, 1 << 16)[0] + wa.CRLF * 2 for i in range(4)]
    big = gzip.compress(b"x" * 9 + hashlib.sha512(b"a").digest() * 40)
    bad = made[2].replace(b"Content-Length: ", b"Content-Length: many")
    files = {
        "plain": b"".join(made), "one": gzip.compress(b"".join(made)), "cut": gzip.compress(b"".join(made))[:-30], "cutplain": b"".join(made)[:-20],
        "noise": made[0] + b"\x00\xff no record\nmore\n" + made[1], "length": made[0] + bad + made[3], "foreign": bytes(range(256)) * 20, "empty": b"", "broken": big[:40], "crc": big[:60] + b"zzz" + big[63:],
    }
    got = {}
    for name, raw in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.warc").write_bytes(raw)
        rows = wa.read_warc(spark, f"{tmp_path}/{name}").collect()
        got[name] = (sorted(r["page_id"] for r in rows if r["complete"]), sum(not r["complete"] for r in rows))
        assert all(r["payload"] == b"payload %d" % r["page_id"] for r in rows if r["complete"]) and all(r["payload"] is None for r in rows if not r["complete"])
    assert got["plain"] == got["one"] == ([0, 1, 2, 3], 0) and got["empty"] == ([], 0)
    assert got["cut"][0] == [0, 1, 2, 3][: len(got["cut"][0])] and got["cut"][1] == 1 and got["cutplain"] == ([0, 1, 2], 1)
    assert got["noise"] == ([0, 1], 1) and got["length"] == ([0, 3], 2)
    assert all(got[n] == ([], 1) for n in ("foreign", "broken", "crc"))


def test_empty_archive(spark):
    assert wa.round_trip(pages(spark, []).where("false")).count() == 0


def test_framing():
    for payload in (b"", b"a", b"x" * 20_000):
        assert wa.dechunk(wa.chunked(payload)) == payload == wa.http_payload(wa.HEAD + wa.chunked(payload))
    assert wa.dechunk(b"5\r\nab\r\n0\r\n\r\n") is None and wa.dechunk(b"zz\r\n") is None and wa.dechunk(b"") is None
    assert wa.dechunk(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc" and wa.http_payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def talk(spark, rows):
    return spark.createDataFrame([(*r, b"h", 1) for r in rows], "conv_id long, turn long, role string, text string, hash binary, k int")


def test_snapshots_collapse(spark):
    long = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    convs = {1: long[:1], 2: long[:2], 3: long, 4: long, 5: long[:3], 6: [("user", "a"), ("assistant", "x")], 7: [("user", "z")], 8: [("user", "ab"), ("assistant", "")], 9: [("usera", "b"), ("assistant", "")]}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)] + [(3, 0, "user", "a"), (None, 0, "user", "lost"), (10, 0, None, None), (11, None, "user", "n"), (11, 1, "user", "m")]
    random.Random(1).shuffle(rows)
    got = {r["conv_id"]: r for r in ch.format_chats(talk(spark, rows)).collect()}
    assert sorted(got) == [3, 6, 7, 8, 9, 10, 11]
    assert (got[3]["n_turns"], got[3]["n_copies"]) == (4, 2) and got[7]["n_copies"] == 1
    assert got[3]["rendered"] == "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in long)
    assert got[10]["rendered"] == "<||>\n<|end|>\n" and got[11]["rendered"].startswith("<|user|>\nn")
    assert ch.format_chats(talk(spark, []).where("false")).count() == 0


def test_rendering_can_be_undone(spark):
    marks = ["<|end|>\n<|user|>\n", "<\\|end|>", "<\\\\|x", "|>", "<|", "a" * 200_000]
    rows = [(c, 0, role, text) for c, (role, text) in enumerate([("user", m) for m in marks] + [(m[:9], "t") for m in marks])]
    got = {r["conv_id"]: r["rendered"] for r in ch.format_chats(talk(spark, rows)).collect()}
    back = lambda s: re.sub(r"\|\\(\\*)>", r"|\1>", re.sub(r"<\\(\\*)\|", r"<\1|", s))
    for c, _, role, text in rows:
        found = re.fullmatch(r"<\|(.*?)\|>\n(.*)<\|end\|>\n", got[c], re.S)
        assert (back(found[1]), back(found[2])) == (role, text) and got[c].count("<|end|>") == 1


def test_hashes_survive_small_batches(spark):
    rows = [(c, t, "user", f"{t}") for c in range(30) for t in range(1 + c % 7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = ch.maximal(Workspace(spark, "t").save(ch.prefix_hashes(ch.turns_of(talk(spark, rows))), "h")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in got] == [(6, 7, 4)]


@pytest.mark.parametrize("body", [b"1\r\na\r\n-6\r\n", b"+1\r\na\r\n0\r\n\r\n", b"1_0\r\n" + b"a" * 16 + b"\r\n0\r\n\r\n", b"ffffffffffffffff\r\na", b"\r\na", b"0x1\r\na\r\n0\r\n\r\n", b"4\r\nab\r\n", b"", b"5"])
def test_damaged_chunks(body):
    assert wa.dechunk(body) is None
    assert wa.dechunk(b"2;name=x\r\nab\r\nA \r\n0123456789\r\n0\r\n\r\n") == b"ab0123456789"


def test_framing_that_is_not_chunks_is_not_complete():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: %s\r\n\r\n"
    assert wa.http_payload(head % b"gzip, chunked" + b"1\r\na\r\n0\r\n\r\n") is None and wa.http_payload(head % b"gzip" + b"x") is None
    assert wa.http_payload(head % b"Chunked" + b"1\r\na\r\n0\r\n\r\n") == b"a" and wa.http_payload(head % b"identity" + b"x") == b"x" and wa.http_payload(b"HTTP/1.1 200 OK\r\n\r\nx") == b"x"


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_lengths_and_lines(spark, tmp_path, packed):
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: %s\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    odd = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: %s\r\nX: " + b"y" * (3 << 20) + b"\r\nContent-Length: 5\r\n\r\nWARC/\r\n\r\n"
    none = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: n\r\n\r\nabc\r\n\r\n"
    huge = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: h\r\nContent-Length: %d\r\n\r\nabc" % (1 << 62)
    data = good % b"a" + odd % b"o" + b"z" * (2 << 20) + b"WARC/ within a line\r\n" + none + good % b"b" + huge
    (tmp_path / ("f.warc.gz" if packed else "f.warc")).write_bytes(gzip.compress(data) if packed else data)
    rows = [(r["record_id"], r["record_type"], None if r["block"] is None else bytes(r["block"])) for r in wa.read_records(spark, str(tmp_path)).collect()]
    assert rows[0] == ("a", "resource", b"abc") and ("b", "resource", b"abc") in rows and ("o", wa.DAMAGED, None) in rows
    assert ("n", wa.DAMAGED, None) in rows and rows[-1] == ("h", "resource", None)
    assert len(rows) == 7  # what lies between records is one damaged row each time


def test_batches_of_records_and_payloads_are_bounded():
    r = random.Random(5)
    payloads = [r.randbytes(40_000) for _ in range(150)]
    made = [x for i, p in enumerate(payloads) for x in wa.records_of(i, "u", p, "d", None, 1 << 16 if i % 2 else 30_000)]
    raw = pa.py_buffer(b"".join(wa.member(x) for x in made))
    every = {k: list(wa.record_batches(raw, k)) for k in (None, True, False)}
    assert {k: sum(b.num_rows for b in v) for k, v in every.items()} == {None: 225, True: 150, False: 75}
    got = [b for found in every[False] for b in wa.payload_batches(found, (x.as_py() for x in found.column(9)))]
    assert max(b.nbytes for b in [*every[None], *every[True], *every[False], *got]) < 2 << 20
    assert {i: x for b in got for i, x in zip(b.column(3).to_pylist(), b.column(6).to_pylist())} == {i: p for i, p in enumerate(payloads) if i % 2}


def test_files_are_small_enough_to_be_rows_of_a_task(spark, tmp_path):
    html = F.expr("array_join(transform(sequence(1, 800), x -> sha2(concat(id, ':', x), 256)), '')")
    rows = spark.range(0, 1000, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html")).localCheckpoint()
    plan = wa.marked(rows)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan  # payloads are not sorted
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        wa.write_warc(rows, f"{tmp_path}/a")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part*")]
    assert sum(sizes) > 24_000_000 and max(sizes) < 20_000_000
    bundles = spark.read.option("lineSep", "\0").text(f"{tmp_path}/a")
    assert bundles.count() >= sum(sizes) // 400_000


def test_whole_records_are_decoded_as_by_reassemble(spark, tmp_path):
    r = random.Random(6)
    wa.write_warc(pages(spark, [(i, "u", prose(r, 200 * (i % 9))) for i in range(1, 40)]), f"{tmp_path}/a", segment_bytes=4000)
    (tmp_path / "a" / "damaged.warc").write_bytes(b"".join(wa.records_of(99, "u", b"x" * 9, "d", None, 1 << 16)) + b"\r\n\r\nno record\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\nab")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(wa.read_warc(spark, f"{tmp_path}/a")) == rows(wa.reassemble(wa.read_records(spark, f"{tmp_path}/a")))
