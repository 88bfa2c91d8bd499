"""Secret scan: keyword automaton, anchored expressions at its hits, embedded checksums.

One Aho-Corasick automaton runs over the ASCII-lower-cased text. A regular expression is only
tried, anchored, where a keyword begins. Runs of hex digits have no keyword, so the automaton
also holds every four-digit hex gram (built from a rule): a run of 24 or more begins with one.
Tokens that embed a checksum (the last six of 36 base-62 digits are the CRC-32 of the first
30) are only reported when the checksum is right.

Edge cases: a null text is an empty text; an empty text has no span; repeated rows each give
their own row; very long texts are scanned whole; of spans with the same start the kinds' order
decides; an empty table gives an empty one; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with the same start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")

# Keywords and the expressions that are tried at them.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_GRAM = 4
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

SPANS = "array<struct<kind:string,start:long,end:long>>"


def base62(value: int, width: int) -> str:
    """``value`` in base 62, padded with zeros to ``width`` digits."""
    digits = ""
    while value:
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits.rjust(width, "0")


def checksum_holds(body: str) -> bool:
    return base62(zlib.crc32(body[:30].encode()), 6) == body[30:]


def automaton():
    """Keywords and hex grams with the kind that each may begin."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for digits in itertools.product("0123456789abcdef", repeat=HEX_GRAM):
        made.add_word("".join(digits), ("hex", HEX_GRAM))
    for word in ASSIGN_WORDS:
        made.add_word(word, ("assign", len(word)))
    made.add_word("akia", ("access", 4))
    for prefix, kind in CHECKED_PREFIXES.items():
        made.add_word(prefix, (kind, len(prefix)))
    made.make_automaton()
    return made


def scan(text: str, words) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, sorted. ``words`` is ``automaton()``."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: no offset moves
    found, free = [], dict.fromkeys(KINDS, 0)  # free: where the next match of a kind may begin
    for last, (kind, length) in words.iter(lower):
        start = last + 1 - length
        if start < free[kind]:
            continue
        if kind == "hex":
            m, good = HEX.match(text, start), None
            good = m and m.end() - start >= MIN_HEX
        elif kind == "assign":
            m = ASSIGN.match(lower, start)
            good = m and len(m[2]) >= MIN_ASSIGN
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and m.end() - start >= MIN_ACCESS
        else:
            m = CHECKED.match(text, start)
            good = m and checksum_holds(m[1])
        if m and (good or kind in BASE_KINDS):
            free[kind] = m.end()  # a match that fails a length test still uses up its text
            if good:
                found.append((start, KINDS.index(kind), m.end()))
    return sorted(found)


def redact_text(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every maximal covered stretch replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: str | None = None) -> DataFrame:
    """One row per document: its id, ``spans`` and, where ``redact`` names a mark, ``redacted``.

    Offsets are code points, ends exclusive. A null text has no spans and stays null in
    ``redacted``; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans, texts = [], []
            for value in batch.column(1):
                text = value.as_py()
                got = scan(text, words) if text else []
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in got])
                if redact is not None:
                    texts.append(redact_text(text, got, redact) if got else text)
            columns = [batch.column(0), pa.array(spans, pa.list_(kind))]
            names = ["_id", "spans"]
            if redact is not None:
                columns.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, spans {SPANS}" + ", redacted string" * (redact is not None)
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars`` (where there is one) counted anew.

    All rows, columns and their order stay; rows without a secret are unchanged.
    """
    rows = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            at, texts, chars = batch.schema.get_field_index("text"), [], {}
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                if text and (got := scan(text, words)):
                    text = redact_text(text, got, mark)
                    chars[i] = len(text)
                texts.append(text)
            if chars:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if (at := batch.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(batch.schema.field(at).type):
                    numbers = [chars.get(i, n) for i, n in enumerate(batch.column(at).to_pylist())]
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(numbers, batch.schema.field(at).type))
            yield batch

    return rows.mapInArrow(run, rows.schema)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the SHA-256 of the base spans and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return find_secrets(docs).select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
