"""Benchmark decontamination by spaced seeds.

A document is contaminated by an item if SPAN consecutive tokens of both agree but for at most
SUBSTITUTIONS of them, position by position. Fixed masks, each ignoring IGNORED of the SPAN
positions, are chosen so that wherever the substitutions fall some mask ignores them all. Hashes
of the masked windows of the items are joined with those of the documents, and the windows around
each hit are compared in full.

Tokens are runs of word characters (\\w: letters, digits and underscores of any script) in lower
case, so no-break spaces, dashes and curly quotes part them. An item of fewer than SPAN tokens, but
at least LEAST, counts if all its tokens occur in a row; from ten tokens on one of them may be
substituted, by masks of the item's own width. Shorter items are no evidence and match nothing;
``unsearched`` lists them.

The items' windows are held in memory by every task only if there are at most ``most_windows``;
otherwise a filter of fixed size stands in, and hits are joined with the table of windows. Both
ways give the same rows.

Edge cases: null or empty texts and items match nothing; very long texts are read whole; repeated
items each count under their id, repeated documents each give their rows once per (id, item), also if
a repeated id stands for different texts; ids may be null and then match nothing; ties cannot arise;
an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, text_of
from strandline.llm.shingles import TOKENS, mixed, words_of_texts

SPAN, SUBSTITUTIONS, IGNORED, LEAST = 13, 2, 6, 8
MOST_WINDOWS = 200_000
AT_ONCE = 1 << 15  # windows that are hashed together
FILTER_BITS = 1 << 26
APART = re.compile(r"[^\x00-\x7f\w]+")  # beyond ASCII; TOKENS knows which ASCII characters part tokens
WINDOW = "h long, item_id long, width int, tokens binary"


def spaced_masks(span: int = SPAN, ignored: int = IGNORED, substitutions: int = SUBSTITUTIONS) -> list[tuple[int, ...]]:
    """The positions that each mask keeps; greedily, until every choice of substituted positions is ignored by a mask."""
    open_ = set(itertools.combinations(range(span), substitutions))
    options = [(s, frozenset(itertools.combinations(s, substitutions))) for s in itertools.combinations(range(span), ignored)]
    masks = []
    while open_:
        best, covers = max(options, key=lambda o: len(o[1] & open_))
        open_ -= covers
        masks.append(tuple(p for p in range(span) if p not in best))
    return masks


def substitutions_of(width: int) -> int:
    """How many tokens of a window may differ: 2 of SPAN, 1 of ten or more, else none."""
    return max(0, (width - 7) // 3)


#: By width of window: the positions that each mask keeps.
MASKS = {w: spaced_masks(w, IGNORED if w == SPAN else w // 3, n) if (n := substitutions_of(w)) else [tuple(range(w))] for w in range(LEAST, SPAN + 1)}
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(SPAN)], dtype=np.uint64)


def tokens_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per token of all texts, one behind the other, and the number of the first token of each text and of the end."""
    raw = []
    for text in texts:
        low = (text or "").lower()
        raw.append((low if low.isascii() else APART.sub(" ", low)).encode("utf-8", "replace"))
    return words_of_texts(b"".join(raw), np.cumsum([0, *map(len, raw)]), TOKENS)


def masked_hashes(tokens: np.ndarray, width: int = SPAN) -> list[np.ndarray]:
    """One array per mask: the hash of the kept tokens of every window."""
    n = len(tokens) - width + 1
    if n <= 0:
        return []
    scaled = [tokens[k : k + n] * _FACTORS[k] for k in range(width)]
    out = []
    for i, mask in enumerate(MASKS[width]):
        total = scaled[mask[0]] + np.uint64((width << 8) + i + 1)
        for k in mask[1:]:
            total = total + scaled[k]
        out.append(mixed(total))
    return out


def seeds(tokens: np.ndarray, widths) -> Iterator[tuple[int, np.ndarray]]:
    """(window width, hashes by position) for every mask of the ``widths``."""
    for w in widths:
        for h in masked_hashes(tokens, w):
            yield w, h


def hits_of(tokens: np.ndarray, first: np.ndarray, bits: np.ndarray, widths) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, hashes, texts, places) of the windows that pass the filter ``bits`` and lie within a text, AT_ONCE places at a time."""
    for a in range(0, len(tokens), AT_ONCE):
        for width, h in seeds(tokens[a : a + AT_ONCE + SPAN - 1], widths):
            h = h.view(np.int64)[:AT_ONCE]
            at = np.flatnonzero(has_bits(bits, h))
            text = np.searchsorted(first, at + a, side="right") - 1
            good = at + a + width <= first[text + 1]
            if good.any():
                yield width, h[at[good]], text[good], at[good] + a


def agree(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether windows (rows) are the same but for the substitutions that their width allows."""
    return (a != b).sum(axis=1) <= substitutions_of(width)


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per item, window and mask: hash, item, width and the window's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = tokens_of([text.as_py()])[0]
                for width, h in seeds(t, [min(len(t), SPAN)] if len(t) >= LEAST else []):
                    rows += [(int(x), item, width, t[p : p + width].tobytes()) for p, x in enumerate(h.view(np.int64))]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], [x.split()[0] for x in WINDOW.split(", ")])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, WINDOW).distinct()


class Index:
    """The windows of all items in memory: sorted hashes, the distinct windows of each, and whose they are."""

    def __init__(self, rows):
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[tuple[int, bytes], list[int]] = {}
        for width, item, tokens in zip(rows["width"], rows["item_id"], rows["tokens"]):
            self.items.setdefault((int(width), bytes(tokens)), []).append(int(item))
        self.items = {k: sorted(set(v)) for k, v in self.items.items()}
        for width, part in rows.groupby("width"):
            part = part.drop_duplicates(["h", "tokens"]).sort_values("h", kind="stable")
            windows = np.frombuffer(b"".join(part["tokens"]), dtype=np.uint64).reshape(len(part), int(width))
            self.by_width[int(width)] = (part["h"].to_numpy(dtype=np.int64), windows)
        self.bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        set_bits(self.bits, rows["h"].to_numpy(dtype=np.int64))

    def found(self, texts: Iterable[str | None]) -> list[tuple[int, int]]:
        """(number of the text, item) for every text and item of which it holds a window, in order."""
        tokens, first = tokens_of(texts)
        pairs: set[tuple[int, int]] = set()
        for width, h, text, at in hits_of(tokens, first, self.bits, self.by_width):
            keys, windows = self.by_width[width]
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = high - low
            position, text = np.repeat(at, n), np.repeat(text, n)
            entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            good = agree(tokens[position[:, None] + np.arange(width)], windows[entry], width)
            for t, e in np.unique(np.stack([text[good], entry[good]], axis=1), axis=0).tolist():
                pairs.update((t, item) for item in self.items[width, windows[e].tobytes()])
        return sorted(pairs)


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return (u & np.uint64(FILTER_BITS - 1)).astype(np.int64), ((u >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def set_bits(bits: np.ndarray, h: np.ndarray) -> None:
    for place in _places(h):
        np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))


def has_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _places(h)
    out = (bits[one >> 3] >> (one & 7).astype(np.uint8)) & 1 == 1
    at = np.flatnonzero(out)
    out[at] = (bits[two[at] >> 3] >> (two[at] & 7).astype(np.uint8)) & 1 == 1
    return out


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the long column ``h``: its words are put together by an aggregate."""
    place = F.explode(F.array(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(FILTER_BITS - 1))))
    words = hashes.select("h").distinct().select(place.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set")).toPandas()  # at most FILTER_BITS / 64 rows
    made = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    made[found["word"].to_numpy()] = found["set"].to_numpy()
    return made.view(np.uint8)


def unsearched(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n_tokens) of the items that have too few tokens to be searched for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(np.diff(tokens_of(batch.column(1).to_pylist())[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["item_id", "n_tokens"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "item_id long, n_tokens int").where(F.col("n_tokens") < LEAST)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(doc_id, item_id) for every document and item that share a window."""
    spark = docs.sparkSession
    space = Workspace(spark, "leaks")
    windows = space.save(item_windows(items, item_col, item_text), "windows")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if windows.count() <= most_windows:
        index = spark.sparkContext.broadcast(Index(windows.toPandas()))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches:
                pairs = known.found(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([p[0] for p in pairs], pa.int64())), pa.array([p[1] for p in pairs], pa.int64())], ["doc_id", "item_id"])

        return rows.mapInArrow(look, "doc_id long, item_id long").distinct()

    widths = [r["width"] for r in windows.select("width").distinct().collect()]  # at most SPAN numbers
    bits = spark.sparkContext.broadcast(filter_of(windows))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            tokens, first = tokens_of(batch.column(1).to_pylist())
            for width, h, text, at in hits_of(tokens, first, bits.value, widths):
                seen = tokens[at[:, None] + np.arange(width)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[text]), pa.array(np.full(len(h), width, dtype=np.int32)), pa.array([row.tobytes() for row in seen], pa.binary())], ["h", "doc_id", "width", "seen"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for width, seen, tokens in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                a, b = np.frombuffer(seen, dtype=np.uint64), np.frombuffer(tokens, dtype=np.uint64)
                good.append(bool(agree(a[None], b[None], width)[0]))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["doc_id", "item_id"]).filter(pa.array(good, pa.bool_()))

    met = rows.mapInArrow(hits, "h long, doc_id long, width int, seen binary").distinct().join(windows, ["h", "width"])
    return met.select("doc_id", "item_id", "width", "seen", "tokens").mapInArrow(verify, "doc_id long, item_id long").distinct()


def clean_of(docs: DataFrame, items: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, columns unchanged.

    Each row is judged by its own text. With the items in memory the rows are filtered where they
    stand, otherwise a hash of id and text names them.
    """
    spark = docs.sparkSession
    windows = Workspace(spark, "leaks").save(item_windows(items, "item_id", "text"), "windows")
    if windows.count() > most_windows:
        own = F.xxhash64("doc_id", "text")  # ids may be null, or repeated with another text
        name = "_" * (max(map(len, docs.columns)) + 1)  # no column of ``docs``
        gone = contaminated(docs.select(own.alias("doc_id"), "text"), items, most_windows=most_windows).select(F.col("doc_id").alias(name)).distinct()
        return docs.join(gone, own == F.col(name), "left_anti").select(*docs.columns)
    index, at = spark.sparkContext.broadcast(Index(windows.toPandas())), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            good[[t for t, _ in known.found(batch.column(at).to_pylist())]] = False
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
