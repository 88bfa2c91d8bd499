"""Word shingles of whole texts as 64-bit hashes, from the UTF-8 bytes as they lie in an Arrow buffer.

Words are maximal runs of bytes other than ASCII white space, with A-Z as a-z. A word is read in
pieces of eight bytes; each piece, with its place in the word, goes through a bijective mixer, and
the mixed pieces and the length are added up and mixed again. Words of up to eight bytes and the
same length never share a hash; other two do with a probability of about 2**-64, also words
of few different letters. A shingle's hash mixes its words' hashes in order. Hashes stand for
shingles everywhere: two sets of n and m shingles are compared wrongly with a probability of about
n * m / 2**64.

Many texts are hashed at once, as they lie one behind the other in an Arrow column, which spares the
cost of a dozen small arrays per text.

``TOKENS`` is another way to cut: runs of ASCII letters, digits, underscores and of all characters
beyond ASCII, as they stand; characters beyond ASCII that are to part words must be blanks by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX, _MIX_AGAIN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # masks of the first k bytes


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def piece_hashes(value: np.ndarray, k) -> np.ndarray:
    """One for each of the eight bytes in ``value``, the ``k``-th of their words; bijective for a place."""
    h = (value + k * _ODD) * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX_AGAIN
    h ^= h >> np.uint64(29)
    return h


class Cut:
    """Which bytes part words, and what stands for each byte value."""

    def __init__(self, parting, same_case: bool):
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(parting)] = False
        self.fold = bytes(range(256)).lower() if same_case else None  # bytes.lower changes A-Z only


WORDS = Cut([32, *range(9, 14)], True)
TOKENS = Cut(set(range(128)) - set(b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), False)


def words_of_texts(text: bytes | memoryview, borders: np.ndarray, cut: Cut = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of texts that lie one behind the other, and the number of the first word of each.

    ``borders``: the place of each text's first byte, ascending from 0, and the end of the last one.
    """
    raw = bytes(text) if cut.fold is None else bytes(text).translate(cut.fold)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    np.take(cut.inside, np.frombuffer(raw, dtype=np.uint8), out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    within = np.unique(borders)
    within = within[inside[within] & inside[within + 1]]  # a border between texts ends a word and begins another
    if len(within):
        edge = np.sort(np.concatenate([edge, within, within]), kind="stable")
    if not len(edge):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(borders), dtype=np.int64)
    start, end = edge[::2], edge[1::2]
    at = np.ndarray(len(raw) + 1, dtype="<u8", buffer=raw + bytes(8), strides=(1,))  # eight bytes from any place
    size = end - start
    total = piece_hashes(at[start] & _FIRST[np.minimum(size, 8)], np.uint64(1))
    if len(long := np.flatnonzero(size > 8)):
        more = (size[long] - 1) >> 3
        first = np.cumsum(more) - more
        k = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        place = np.repeat(start[long], more) + 8 * k
        value = at[place] & _FIRST[np.minimum(np.repeat(end[long], more) - place, 8)]
        total[long] += np.add.reduceat(piece_hashes(value, (k + 1).astype(np.uint64)), first)
    return mixed(total + size.astype(np.uint64) * _ODD), np.searchsorted(start, borders)


def word_hashes(text: bytes | memoryview, cut: Cut = WORDS) -> np.ndarray:
    """A hash per word of a text given as bytes."""
    return words_of_texts(text, np.array([0, len(text)]), cut)[0]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-word windows in order; of the whole sequence if it is shorter; none of no words."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    h = mixed(words[: n - width + 1] + np.uint64(width))
    for k in range(1, width):
        h = h * _ODD + words[k : n - width + 1 + k]
        h ^= h >> np.uint64(31)
    return mixed(h)


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values of an array, ascending; sorts it in place."""
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h


def shingle_set(text: bytes | memoryview | None, width: int) -> np.ndarray:
    """The distinct shingles of a UTF-8 text, ascending; empty for null, empty and blank texts."""
    return distinct(shingle_hashes(word_hashes(text), width)) if text else np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
    """``shingle_set`` of each text of an Arrow column without nulls, about ``at_once`` bytes at a time."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    borders = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(borders, borders[a] + at_once, side="right")) - 1)
        data = texts.buffers()[2]
        raw = data.slice(int(borders[a]), int(borders[b] - borders[a])) if data is not None else b""
        words, first = words_of_texts(raw, borders[a : b + 1] - borders[a])
        windows = shingle_hashes(words, width) if len(words) >= width else words
        for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
            yield distinct(windows[low : high - width + 1].copy() if high - low >= width else shingle_hashes(words[low:high], width).copy())
        a = b
