"""Chat formatting: snapshots of the same conversation collapse to the longest before rendering.

A log often holds a conversation again after every turn. Each turn has a digest; a rolling hash
over the digests names every prefix of a conversation. A conversation whose last hash is a proper
prefix of another one's goes (anti-join), of equal ones that with the smallest id stays. Only what
stays is rendered.

The rolling hash runs over rows sorted by conversation and turn, one row at a time, without the
texts; conversations are never gathered for it. Equal last hashes and prefixes are pre-aggregated
before they are shuffled, so the anti-join has one row per key on either side.

Edge cases: null roles and texts are empty ones; rows that are the same in id, turn, role and text
are one turn; turns with the same number are put in order by role and text, a null number first;
rows without a conv_id belong to no conversation and are left out; very long turns are rendered
whole; marks inside a text or role get a backslash, ``<|`` and ``|>`` as ``<\\|`` and ``|\\>`` (another one
if there are some), so a rendering can be undone; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace

CLOSE = "<|end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, hash, last): the rolling hash after each of a conversation's turns."""
    framed = F.concat_ws(":", F.length("role").cast("string"), "role", "text")  # the length keeps role and text apart
    digests = turns.select("conv_id", "turn", "role", F.sha2(F.col("text"), 256).alias("order"), F.unhex(F.sha2(framed, 256)).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, before, k, chain = None, None, None, 0, b""
        for batch in batches:
            out = []
            for conv, turn, digest in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv == now and (turn, digest) == before:
                    continue  # the same turn again
                if held is not None:
                    out.append((*held, conv != now))
                k, chain = (k + 1, chain) if conv == now else (1, b"")
                chain = hashlib.sha256(chain + digest).digest()
                held, now, before = (conv, k, chain), conv, (turn, digest)
            yield table_of(out)
        yield table_of([] if held is None else [(*held, True)])

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv_id", "k", "hash", "last"])

    dealt = digests.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "order")
    return dealt.select("conv_id", "turn", "digest").mapInArrow(run, "conv_id long, k long, hash binary, last boolean")


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no prefix of another; n_copies: how many are equal."""
    ends = hashes.where("last").groupBy("k", "hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = hashes.where("not last").select("k", "hash").distinct()
    return ends.join(inner, ["k", "hash"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def escaped(text: Column) -> Column:
    """Text in which nothing reads as a mark."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, rendered): a conversation's turns as one text. A row is one conversation and as long as that is."""
    turn = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", F.sha2("text", 256).alias("order"), "text")
    listed = turns.distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    one = lambda t: F.concat(F.lit("<|"), escaped(t["role"]), F.lit("|>\n"), escaped(t["text"]), F.lit(CLOSE))
    return listed.select("conv_id", F.concat_ws("", F.transform("t", one)).alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of every maximal conversation."""
    space = Workspace(conversations.sparkSession, "chat")
    turns = turns_of(conversations)
    kept = space.save(maximal(space.save(prefix_hashes(turns), "hashes")), "kept")
    space.drop("hashes")
    return render(turns.join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
