"""Best-fit packing: pattern counts by non-negative least squares over the length histogram.

1. Tokenise: each whole document becomes its ids and a closing id; a longer one is cut into full
   pieces from its end. A task numbers its pieces of each length as it writes them.
2. Plan, on the driver, from the histogram alone (a number for each of at most ``size`` lengths):
   patterns of few length classes that fill a sequence are enumerated, their repeat counts are
   fitted to the histogram by non-negative least squares and rounded, realised by lengths that fill
   a sequence, and what is left is packed best-fit-decreasing into the gaps and into new sequences,
   whole runs of equal lengths at a time. Short pieces fill gaps best, so a few such drafts are made
   that keep the shortest classes out of the patterns, from none to all below half a sequence (there
   best fit places all but full pieces). The first one with the fewest sequences is the plan; no draft
   follows one that reaches the total length divided by ``size``. The plan's size depends on the
   number of lengths, not of documents.
3. Place: a piece's number among all pieces of its length decides its sequence and offset.

Edge cases: a null or empty text is one piece with the closing id alone; very long texts are many
pieces; repeated rows are packed each, and pieces of equal length are placed in order of task and
row; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, text_of

SEQUENCE = 2_048
CLOSING_ID = 0
CLASSES = 64
PATTERN_DOCS = 4
# The vocabulary's expression for pre-tokens, and characters whose classes do not differ between libraries.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]*")
#: Of CLASSES, the shortest ones that a draft keeps out of the patterns.
KEPT_OUT = (0, 4, 8, 12, 16, 24, 32)
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local long"


class Ids:
    """Ids of whole texts, as bytes of little-endian 32-bit integers.

    The tokenizer file decides. Its vocabulary also exists as ranks for a library that is three
    times as fast; texts of characters on which both are known to cut alike (``PLAIN``), without
    the strings of special tokens, go there, all others to the file's own library.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            if len(ranks) != len(vocabulary) - len(set(self.special) & set(vocabulary)):
                raise ValueError("the ranks are not the tokenizer's vocabulary")
            self.fast = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def bytes_of(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids: full ones from the end, the first may be shorter."""
    first = (total - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, total, size))]


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """The pieces of every document, numbered by (task, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        ids, part, used = Ids(tokenizer_path, ranks_path), TaskContext.get().partitionId(), [0] * (size + 1)
        end = CLOSING_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = ids.bytes_of(text.as_py()) + end
                for k, (start, length) in enumerate(cut(len(raw) // 4, size)):
                    rows.append((doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, used[length]))
                    used[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, PIECES)


def patterns(classes: int, docs: int) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``docs`` classes (1 to ``classes``) that sum to ``classes``."""

    def extend(rest: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif left:
            for c in range(min(rest, most), 0, -1):
                if c * left < rest:
                    return
                yield from ((c, *tail) for tail in extend(rest - c, c, left - 1))

    return list(extend(classes, classes, docs))


def nonnegative_fit(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| small: accelerated projected gradient."""
    step = 1.0 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def fitted(counts: np.ndarray, size: int, classes: int, docs: int, out: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) of the fit to the histogram without its ``out`` shortest classes, most frequent first."""
    width = size // classes
    if width * classes != size:
        return []
    klass = -(-np.arange(size + 1) // width)
    histogram = np.bincount(klass, weights=counts, minlength=classes + 1)[1:]
    histogram[:out] = 0
    made = [p for p in patterns(classes, docs) if min(p) > out]
    a = np.zeros((classes, len(made)))
    for j, pattern in enumerate(made):
        for c in pattern:
            a[c - 1, j] += 1
    weight = np.sqrt(np.arange(1, classes + 1) / classes)[:, None]  # a long piece that finds no place costs more
    repeats = np.rint(nonnegative_fit(a * weight, histogram * weight[:, 0])).astype(np.int64)
    return [(made[j], int(repeats[j])) for j in np.argsort(-repeats, kind="stable") if repeats[j]]


class Draft:
    """Places for all pieces: the repeats by pattern, each sequence full, the rest best-fit."""

    def __init__(self, counts: np.ndarray, size: int, width: int, repeats: list[tuple[tuple[int, ...], int]]):
        self.size, self.left, self.next = size, counts.astype(np.int64).copy(), np.zeros(size + 1, dtype=np.int64)
        self.rows: list[tuple[int, int, int, int]] = []  # length, first piece number, first sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # free space: runs (first sequence, how many)
        self.sequences = 0
        for pattern, many in repeats:
            self._realise(pattern, many, width)
        self.by_pattern = int(counts.sum() - self.left.sum())
        self._fill()

    def _put(self, length: int, many: int, first: int, offset: int) -> None:
        self.rows.append((length, int(self.next[length]), first, offset))
        self.next[length] += many
        self.left[length] -= many

    def _realise(self, pattern: tuple[int, ...], many: int, width: int) -> None:
        while many > 0 and (chosen := self._lengths(pattern, width)):  # what has no such lengths is left to best fit
            run = min(many, *(int(self.left[n]) // chosen.count(n) for n in set(chosen)))
            offset = 0
            for n in chosen:
                self._put(n, run, self.sequences, offset)
                offset += n
            self.sequences += run
            many -= run

    def _lengths(self, pattern: tuple[int, ...], width: int) -> list[int] | None:
        """Lengths still left, one of each class of ``pattern``, the last as long as the room that the others leave."""
        lead: list[int] = []
        for c in pattern[:-2]:
            n = next((n for n in range(c * width, (c - 1) * width, -1) if self.left[n] > lead.count(n)), None)
            if n is None:
                return None
            lead.append(n)
        room = self.size - sum(lead)
        if len(pattern) == 1:
            return [room] if self.left[room] else None
        for n in range(min(room - 1, pattern[-2] * width), (pattern[-2] - 1) * width, -1):
            chosen = [*lead, n, room - n]
            if all(self.left[x] >= chosen.count(x) for x in chosen[-2:]):
                return chosen
        return None

    def _fill(self) -> None:
        """Best fit decreasing of the rest, a run of equal lengths and equal gaps at a time."""
        for n in range(self.size, 0, -1):
            while self.left[n] > 0:
                gap = next((g for g in range(n, self.size) if self.open.get(g)), None)
                if gap is None:
                    each = self.size // n  # nothing is open: equal pieces side by side
                    many = max(1, int(self.left[n]) // each)
                    fits = min(each, int(self.left[n]))
                    for k in range(fits):
                        self._put(n, many, self.sequences, k * n)
                    if self.size > fits * n:
                        self.open.setdefault(self.size - fits * n, []).append((self.sequences, many))
                    self.sequences += many
                    continue
                first, run = self.open[gap].pop()
                many = min(run, int(self.left[n]))
                if many < run:
                    self.open[gap].append((first + many, run - many))
                self._put(n, many, first, self.size - gap)
                if gap > n:
                    self.open.setdefault(gap - n, []).append((first, many))


class Plan:
    """Intervals of piece numbers, by length, with the sequence and offset that they go to."""

    def __init__(self, counts: np.ndarray, size: int = SEQUENCE, classes: int = CLASSES, docs: int = PATTERN_DOCS):
        """``counts[n]``: pieces of length n, n from 0 to ``size``."""
        least, best = -(-int((counts * np.arange(size + 1)).sum()) // size), None
        for out in KEPT_OUT:
            draft = Draft(counts, size, size // classes, fitted(counts, size, classes, docs, out))
            if best is None or draft.sequences < best.sequences:
                best = draft
            if best.sequences == least:
                break
        self.sequences, self.by_pattern, rows = best.sequences, best.by_pattern, sorted(best.rows)
        self.keys = np.array([(n << 44) | lo for n, lo, _, _ in rows], dtype=np.int64)
        self.lo, self.base, self.offset = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2, 3))

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and number among the pieces of that length."""
        at = np.searchsorted(self.keys, (length.astype(np.int64) << 44) | number, side="right") - 1
        return self.base[at] + number - self.lo[at], self.offset[at]


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    space = Workspace(docs.sparkSession, "packing")
    cut_up = space.save(pieces(docs, tokenizer_path, ranks_path, size), "pieces")
    per_task = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    plan = Plan(counts, size)
    # a row per length and task: pieces of the length in the tasks before
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut_up.join(bases, ["length", "part"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("base") + F.col("local")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(np.asarray(batch.column(3)), np.asarray(batch.column(5)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
