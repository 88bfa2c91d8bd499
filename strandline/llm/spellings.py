"""Spelling variants by full neighbourhood generation: words one inserted, deleted or replaced character apart.

1. Tasks count the words of their texts and send each with its number; added up, there is one row per
   distinct word. A word stays with at least LETTERS characters and OCCURRENCES occurrences.
2. Every word gives all distinct strings that one deletion, replacement or insertion over the observed
   alphabet makes of it: a deletion within a run of equal letters, or an insertion beside an equal letter,
   is made at the run's first place only. Strings are hashed as they are made, from running sums over
   the word, so a string is written only if a filter of the vocabulary's hashes lets it pass. The
   filter has a fixed size; with a vocabulary too large for it more strings pass and go on.
3. Strings are joined to the vocabulary on equality: what meets is one edit apart, and no distance is computed.
   A string has no more makers than one word has neighbours, so no key of the join is hot.
4. A word's form is its near word with the largest number, if that is at least RATIO times its own. Numbers
   grow along forms by that factor, so there are few levels: roots are found from the top, one level
   a round, each a join on forms (a form has no more followers than neighbours).

Edge cases: null texts have no words; a null id counts as the empty text in the hash that garbles; empty
tables give empty ones; repeated rows count each; very long texts and words are taken whole; ties of a form go
to the smallest word in code-point order; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, text_of
from strandline.llm.decontaminate import FILTER_BITS, has_bits

LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: One in so many occurrences loses a character, chosen by a hash of document and word.
GARBLED = 199
RUN = re.compile("[a-zÀ-ÿ]+")
#: A task sends what it has counted after so many words or characters.
HELD, HELD_CHARS = 300_000, 32 << 20
SENT = 50_000
#: Places of words that are edited at once, and words per task.
PLACES, WORDS = 1 << 14, 4_000
#: Bits of the filter that one group puts together.
SEGMENT = 1 << 15

# the hash of a word: the sum of letter value times power of the place
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def words_of(doc_id: object, text: str) -> Counter:
    """The words of a text, with A-Z as a-z, some of them garbled, and how often each occurs."""
    found, seed = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode("utf-8", "replace").lower().decode())).items():  # bytes.lower changes A-Z only
        h = zlib.crc32(run.encode(), seed)
        if h % GARBLED == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LETTERS:
            found[run] += n
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[pa.RecordBatch]:
            keys, numbers = list(held), list(held.values())
            for a in range(0, len(keys), SENT):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + SENT], pa.string()), pa.array(numbers[a : a + SENT], pa.int64())], ["word", "n"])

        held, chars = Counter(), 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                held.update(words_of(doc_id, text))
                chars += len(text)
                if len(held) > HELD or chars > HELD_CHARS:
                    yield from sent()
                    held, chars = Counter(), 0
        yield from sent()

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def codes_of(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("latin-1"), dtype=np.uint8)


def hash_of(word: str) -> int:
    codes = codes_of(word)
    return int((_VALUE[codes] * _powers(len(codes) + 1)[:-1]).sum(dtype=np.uint64))


def edits(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All distinct strings one edit away from each of ``words`` (of one length): hash, number of the word, place, letter.

    The letter is its code for a replacement, 256 more for an insertion before the place, and -1 for a deletion.
    """
    codes = np.stack([codes_of(w) for w in words])
    many, size = codes.shape
    power = _powers(size + 2)
    before = np.zeros((many, size + 1), dtype=np.uint64)
    np.cumsum(_VALUE[codes] * power[:size], axis=1, out=before[:, 1:])
    padded = np.concatenate([np.full((many, 1), -1), codes, np.full((many, 1), -1)], axis=1)  # -1 is no letter
    letter = _VALUE[alphabet][None, :]
    for a in range(0, many * (size + 1), PLACES):
        word, place = np.divmod(np.arange(a, min(a + PLACES, many * (size + 1))), size + 1)
        left, total = before[word, place], before[word, size]
        own, previous = padded[word, place + 1], padded[word, place]
        fresh = (own >= 0) & (own != previous)
        w, p = word[fresh], place[fresh]
        yield left[fresh] + (total[fresh] - before[w, p + 1]) * np.uint64(_BASE_INVERSE), w, p, np.full(len(w), -1)
        put = letter * power[place][:, None]
        for shift, base, wrong in (
            (0, total - np.where(own >= 0, before[word, np.minimum(place + 1, size)] - left, 0), own),
            (256, left + (total - left) * np.uint64(_BASE), previous),
        ):
            row, column = np.nonzero(alphabet[None, :] != wrong[:, None]) if shift else np.nonzero((alphabet[None, :] != wrong[:, None]) & (own >= 0)[:, None])
            yield base[row] + put[row, column], word[row], place[row], alphabet[column].astype(np.int64) + shift


def edited(word: str, place: int, letter: int) -> str:
    if letter < 0:
        return word[:place] + word[place + 1 :]
    return word[:place] + chr(letter & 255) + word[place + (letter < 256) :]


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits over the long column ``h``: groups of at most SEGMENT distinct places put its segments together."""

    def segment(part: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT, dtype=bool)
        bits[part.column("place").to_numpy() & (SEGMENT - 1)] = True
        return pa.table({"segment": part.column("segment")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    place = F.explode(F.array(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(FILTER_BITS - 1))))
    places = hashes.select(place.alias("place")).distinct().withColumn("segment", F.shiftright("place", SEGMENT.bit_length() - 1).cast("int"))
    made = np.zeros((FILTER_BITS // SEGMENT, SEGMENT // 8), dtype=np.uint8)
    for row in places.groupBy("segment").applyInArrow(segment, "segment int, bits binary").collect():  # FILTER_BITS in all
        made[row["segment"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return made.reshape(-1)


def near_pairs(words: DataFrame, space: Workspace) -> DataFrame:
    """(word, n, near, near_n) for every two of ``words`` (word, n) that are one edit apart, in both orders."""
    spark = words.sparkSession
    alphabet = np.array(sorted(ord(r["c"]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), dtype=np.int64)  # 90 letters at most

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([hash_of(w) for w in batch.column(0).to_pylist()], dtype=np.uint64).view(np.int64))], ["h"])

    bits = spark.sparkContext.broadcast(filter_of(words.select("word").mapInArrow(hashed, "h long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelt, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for k, w in enumerate(spelt):
                by_size.setdefault(len(w), []).append(k)
            for rows in by_size.values():
                for h, word, place, letter in edits([spelt[k] for k in rows], alphabet):
                    good = has_bits(bits.value, h.view(np.int64))
                    at = [rows[k] for k in word[good].tolist()]
                    near = [edited(spelt[k], p, c) for k, p, c in zip(at, place[good].tolist(), letter[good].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([spelt[k] for k in at], pa.string()), pa.array([numbers[k] for k in at], pa.int64()), pa.array(near, pa.string())], ["word", "n", "near"])

    tasks = max(1, words.count() // WORDS)
    made = words.repartition(tasks).mapInArrow(run, "word string, n long, near string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(links: DataFrame, space: Workspace) -> DataFrame:
    """(word, root) of every word that has a form, from ``links`` (word, form): the end of its chain of forms."""
    heads = links.select(F.col("word").alias("form"))
    done = space.save(links.join(heads, "form", "left_anti").select("word", F.col("form").alias("root")), "roots-0")
    left, out, k = space.save(links.join(heads, "form", "left_semi").select("word", "form"), "left-0"), done, 0
    while not left.isEmpty():  # numbers grow by RATIO along a chain, so there are few rounds
        k += 1
        above = done.select(F.col("word").alias("form"), "root")
        done, left = space.save(left.join(above, "form").select("word", "root"), f"roots-{k}"), space.save(left.join(above, "form", "left_anti").select("word", "form"), f"left-{k}")
        out = out.unionByName(done)
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary."""
    space = Workspace(docs.sparkSession, "spellings")
    words = space.save(vocabulary(docs, id_col, text_col), "words")
    pairs = near_pairs(words, space).unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near"))).alias("best")
    found = pairs.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    formed = -F.col("best.m") >= RATIO * F.col("n")
    forms = space.save(found.select("word", "n", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(forms.where("form is not null").select("word", "form"), space)
    return forms.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
