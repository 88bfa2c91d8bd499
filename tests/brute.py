"""The rules spelled out one base at a time, to compare the engine with."""

from __future__ import annotations

from collections import Counter

COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


def reverse_complement(s: str) -> str:
    return "".join(COMPLEMENT[c] for c in reversed(s))


def number(s: str) -> int:
    value = 0
    for c in s:
        value = value * 4 + "ACGT".index(c)
    return value


def allowed(s: str) -> bool:
    if len(s) == 1:
        return False
    if len(s) == 2:
        return s[0] != "A" and s != "CA"
    return "AA" not in s and s[:3] != "ACA"


def norm(s: str) -> int:
    return min([number(t) for t in (s, reverse_complement(s)) if allowed(t)] or [4 ** len(s)])


def windows(seq: str, k: int):
    for i in range(len(seq) - k + 1):
        if set(seq[i : i + k]) <= set("ACGT"):
            yield i, seq[i : i + k]


def counts(seqs, k: int, canonical: bool = True) -> Counter:
    return Counter(min(w, reverse_complement(w)) if canonical else w for s in seqs for _, w in windows(s, k))


def super_kmers(seq: str, k: int, m: int) -> list[tuple[int, int, int, int]]:
    """(start, n, signature, place of the signature)"""
    out: list[list[int]] = []
    before = None
    for i, w in windows(seq, k):
        value, at = min((norm(w[j : j + m]), j) for j in range(k - m + 1))
        if out and before == i - 1 and out[-1][3] == i + at:
            out[-1][1] += 1
        else:
            out.append([i, 1, value, i + at])
        before = i
    return [tuple(x) for x in out]


def kx_mers(seq: str, k: int, m: int, x: int) -> list[tuple[int, int, int, str]]:
    """(start, x, orientation, bases)"""
    out = []
    for start, n, _, _ in super_kmers(seq, k, m):
        run: list[int] = []
        turned = None

        def flush():
            if run:
                s = seq[run[0] : run[-1] + k]
                out.append((run[0], len(run) - 1, turned, reverse_complement(s) if turned else s))

        for i in range(start, start + n):
            w = seq[i : i + k]
            o = 0 if w < reverse_complement(w) else 1
            if o != turned or len(run) == x + 1:
                flush()
                run = []
            turned = o
            run.append(i)
        flush()
    return out


def bin_of(s: int, bins: int) -> int:
    cut = 0xFFFFFFFF
    v = (s ^ 61) ^ (s >> 16)
    v = v * 9 & cut
    v ^= v >> 4
    v = v * 0x27D4EB2D & cut
    v ^= v >> 15
    return (v & 0x7FFFFFFF) % bins
