"""Token counts of whole texts: pieces of each distinct pre-token once, joined to documents' frequencies.

A text is cut into pre-tokens over which no vocabulary entry reaches.

1. Tasks count the pre-tokens of their texts and send each with its number; added up, there is one
   row per distinct pre-token of the corpus.
2. The tokenizer sees each of these rows once. It gives the number of its pieces; no ids are kept,
   and those of a document never exist.
3. The texts are read again for each document's frequencies. The HEAD most frequent pre-tokens, a
   bounded number of bounded length, are joined to them where the document is read, as they make up
   nearly all of a text. The others of a document are written with its row number and joined to
   the table of step 2 by a shuffle. Products are summed.

So the shuffles move distinct pre-tokens and rare ones, not the corpus, at any size.

Why the cut is exact: in the model every space becomes U+2581, which in a vocabulary entry only
stands at the front, and no entry holds a line feed. Hence no merge crosses from a non-space to
a space or touches a line feed. ``check_model`` verifies this when the model is loaded.

Edge cases: a null text counts as empty and has no tokens; a text with the character U+0000, at which
the library's interface ends in some versions, is given to it as a whole; very long texts and
pre-tokens are counted like others; repeated rows each give a row and null ids stay; an empty table
gives an empty one; other columns are ignored; nothing is cut off.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, most_frequent, text_of

PRETOKEN = re.compile(r" *[^ \n]+| +|\n")
SPACE = "▁"
#: Pre-tokens that are joined where the document is read, and their greatest length in bytes: 25 MB at most.
HEAD, HEAD_BYTES = 200_000, 128
#: A task sends what it has counted after so many pre-tokens or characters.
HELD, HELD_CHARS = 300_000, 32 << 20
SENT = 50_000


def check_model(model) -> None:
    """Raise if pieces of ``model`` could reach over a cut of PRETOKEN."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE) or "\n" in piece or " " in piece:
            raise ValueError(f"piece {piece!r} reaches over the end of a pre-token")
    if len(model.encode("a  b ", out_type=str)) < 4 or len(model.encode("\n")) != 2:
        raise ValueError("the model drops or rewrites white space")


def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(model)
    return model


def pretokens(text: str) -> Counter:
    """How often each pre-token occurs in ``text``, which gets the model's space in front."""
    return Counter(PRETOKEN.findall(" " + text.replace(SPACE, " "))) if text else Counter()


def pieces(model, some: list[str]) -> list[int]:
    """The number of pieces of each pre-token."""
    # after a line feed no prefix is added to the pre-token: two pieces are the feed's own
    return [1 if p == "\n" else len(made) - 2 for p, made in zip(some, model.encode(["\n" + p for p in some], num_threads=1), strict=True)]


def distinct_pretokens(texts: DataFrame) -> DataFrame:
    """(p, n): every pre-token of the column ``text`` with its number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[pa.RecordBatch]:
            keys, numbers = list(held), list(held.values())
            for a in range(0, len(keys), SENT):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + SENT], pa.string()), pa.array(numbers[a : a + SENT], pa.int64())], ["p", "n"])

        held, chars = Counter(), 0
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if "\0" in text:
                    continue
                held.update(pretokens(text))
                chars += len(text)
                if len(held) > HELD or chars > HELD_CHARS:
                    yield from sent()
                    held, chars = Counter(), 0
        yield from sent()

    return texts.select(text_of().alias("text")).mapInArrow(run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))


def with_pieces(distinct: DataFrame, model_path: str) -> DataFrame:
    """``distinct`` (p, n) with the number of pieces of each pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for whole in batches:
            for a in range(0, whole.num_rows, SENT):
                batch = whole.slice(a, SENT)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces(model, batch.column(0).to_pylist()), pa.int64())], ["p", "n", "pieces"])

    return distinct.mapInArrow(run, "p string, n long, pieces long")


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every whole text, by the sentencepiece model at ``model_path``."""
    spark = docs.sparkSession
    space = Workspace(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    counted = space.save(with_pieces(distinct_pretokens(rows), model_path), "pretokens")
    first = most_frequent(counted.where(F.octet_length("p") <= HEAD_BYTES), head).select("p", "pieces").toPandas()  # at most HEAD rows
    known = spark.sparkContext.broadcast(dict(zip(first["p"].tolist(), first["pieces"].tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, sizes, row = None, known.value, TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("p", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            total, rest = [], []
            for value in batch.column(2):
                text, others, n = value.as_py(), [], 0
                if "\0" in text:
                    model = model or load(model_path)
                    n = len(model.encode(text, num_threads=1))
                else:
                    for p, times in pretokens(text).items():
                        size = sizes.get(p)
                        if size is None:
                            others.append({"p": p, "n": times})
                        else:
                            n += times * size
                total.append(n)
                rest.append(others)
            number = range(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), *batch.columns[:2], pa.array(total, pa.int64()), pa.array(rest, kind)], ["row", "_id", "n_bytes", "known", "rest"])

    kind = rows.schema["_id"].dataType.simpleString()
    by_row = space.save(rows.mapInArrow(run, f"row long, _id {kind}, n_bytes long, known long, rest array<struct<p:string,n:long>>"), "rows")
    rest = by_row.select("row", F.explode("rest").alias("x")).select("row", F.col("x.p").alias("p"), F.col("x.n").alias("times"))
    rest = rest.join(counted.select("p", "pieces"), "p").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return by_row.join(rest, "row", "left").select(F.col("_id").alias(id_col), "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def token_report(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    return count_tokens(docs, model_path).withColumn("over_limit", F.col("n_tokens") > limit)
