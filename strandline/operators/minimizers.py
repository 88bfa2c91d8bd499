"""Super-k-mers, signatures and (k,x)-mers of reads, computed where the read is: no shuffle, no sort.

The kernels work on the 2-bit codes of a whole read at a time with vectorised sums and sliding
minima; the same rules as column expressions are in ``functions.minimizer``. Very long reads are
taken in blocks whose borders heal, because a super-k-mer is named by its signature's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.bases import bin_of
from strandline.functions.minimizer import DEFAULT

BLOCK = 1 << 20
AT_ONCE = 1 << 15  # stretches of a read that become texts together
_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[[65, 67, 71, 84]] = range(4)
_REVERSE = np.frombuffer(bytes.maketrans(b"ACGT", b"TGCA"), dtype=np.uint8)


def codes_of(seq: bytes) -> np.ndarray:
    """0 to 3 for A, C, G, T; 4 for anything else."""
    return _CODE[np.frombuffer(seq, dtype=np.uint8)]


def packed_windows(codes: np.ndarray, width: int) -> list[np.ndarray]:
    """Each window as base-4 numbers of up to 31 codes, the leading one first."""
    n, out = len(codes) - width + 1, []
    for a in range(0, width, 31):
        value = np.zeros(n, dtype=np.int64)
        for j in range(a, min(a + 31, width)):
            value = value * 4 + codes[j : j + n]
        out.append(value)
    return out


def orientations(codes: np.ndarray, k: int) -> np.ndarray:
    """For each window 0 if it is smaller than its reverse complement, else 1. Windows must be bases."""
    forward, backward = packed_windows(codes, k), [v[::-1] for v in packed_windows(3 - codes[::-1].astype(np.int64), k)]
    out = np.ones(len(forward[0]), dtype=np.int8)
    open_ = np.ones(len(out), dtype=bool)
    for f, b in zip(forward, backward):
        out[open_ & (f < b)] = 0
        open_ &= f == b
    return out


def stretches(codes: np.ndarray, k: int) -> np.ndarray:
    """The codes without what no k-mer can lie in, a code that is no base behind each stretch."""
    bad = np.flatnonzero(codes > 3)
    edge = np.concatenate([[-1], bad, [len(codes)]])
    long = np.diff(edge) > k
    keep = np.repeat(long, np.diff(edge))[:-1]  # each stretch with the place behind it, the last one without
    return codes[keep]


def windows_of(codes: np.ndarray, width: int, turned: bool = False) -> np.ndarray:
    """Each window of up to 31 bases as a base-4 number, or that of its reverse complement, put together from windows half as wide."""
    kind = np.int32 if width <= 15 else np.int64
    one = (3 - (codes & 3) if turned else codes & 3).astype(kind)
    value, have = one, 1
    for bit in f"{width:b}"[1:]:
        low, high = value[:-have], value[have:]
        value, have = (high << 2 * have | low) if turned else (low << 2 * have | high), 2 * have
        if bit == "1":
            low, high = value[:-1], one[have:]
            value, have = (high << 2 * have | low) if turned else (low << 2 | high), have + 1
    return value


def least_of_windows(key: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window, from windows half as wide."""
    have = 1
    while have < width:
        step = min(have, width - have)
        key, have = np.minimum(key[:-step], key[step:]), have + step
    return key


def bad_windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Whether each window holds something else than bases."""
    return least_of_windows(codes < 4, width) == 0


def norms(codes: np.ndarray, m: int) -> np.ndarray:
    """The norm of each m-mer as a number, 4**m if it has none (or is no m-mer)."""
    value, reverse = windows_of(codes, m), windows_of(codes, m, turned=True)
    default = value.dtype.type(4**m)
    least = np.minimum(np.where(allowed(value, m), value, default), np.where(allowed(reverse, m), reverse, default))
    return np.where(bad_windows(codes, m), default, least).astype(np.int64)


def allowed(value: np.ndarray, m: int) -> np.ndarray:
    """m-mers without AA that don't begin with ACA, on base-4 numbers."""
    if m == 1:
        return np.zeros(len(value), dtype=bool)
    if m == 2:
        return (value >> 2 != 0) & (value != 4)  # nothing that begins with A, and not CA
    some = (value | value >> 1) & int("01" * m, 2)  # a bit for each base that is not A
    return (value >> (2 * m - 6) != 4) & ((some | some >> 2) & int("01" * (m - 1), 2) == int("01" * (m - 1), 2))  # ACA is 0 1 0


@dataclass
class Supers:
    """Arrays of super-k-mers: first place, number of k-mers, signature and its place."""

    start: np.ndarray
    n: np.ndarray
    sig: np.ndarray
    pos: np.ndarray


def signatures(codes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, signature, its place) of every valid k-mer."""
    valid = np.flatnonzero(~bad_windows(codes, k)) if len(codes) >= k else np.zeros(0, dtype=np.int64)
    if not len(valid):
        return valid, valid, valid
    norm = norms(codes, m)
    if m > 15:
        at = np.lib.stride_tricks.sliding_window_view(norm, k - m + 1).argmin(axis=1)[valid] + valid
        return valid, norm[at], at
    least = least_of_windows(norm << 32 | np.arange(len(norm)), k - m + 1)[valid]  # the leftmost of equal ones
    return valid, least >> 32, least & 0xFFFFFFFF


def super_kmers_of(seq: bytes, k: int, m: int, block: int = BLOCK) -> Supers:
    """Maximal runs of neighbouring valid k-mers whose signature is the same occurrence."""
    found: list[np.ndarray] = []
    for a in range(0, max(1, len(seq) - k + 1), block):
        valid, sig, pos = signatures(codes_of(seq[a : a + block + k - 1]), k, m)
        if len(valid):
            first = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (valid[1:] != valid[:-1] + 1)]))
            part = np.stack([valid[first] + a, np.diff(np.append(first, len(valid))), sig[first], pos[first] + a])
            if found and found[-1][3, -1] == part[3, 0] and found[-1][0, -1] + found[-1][1, -1] == part[0, 0]:
                found[-1][1, -1] += part[1, 0]
                part = part[:, 1:]
            found.append(part)
    rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), dtype=np.int64)
    return Supers(*rows)


def kx_mers_of(seq: bytes, supers: Supers, k: int, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number of k-mers, orientation) of each run of one orientation within a super-k-mer, cut at x + 1."""
    if not len(supers.start):
        return supers.start, supers.n, supers.n
    place = np.repeat(supers.start, supers.n) + np.arange(supers.n.sum()) - np.repeat(np.cumsum(supers.n) - supers.n, supers.n)
    which = np.repeat(np.arange(len(supers.n)), supers.n)
    codes = codes_of(seq)
    turn = np.concatenate([orientations(codes[a : a + BLOCK + k - 1] & 3, k) for a in range(0, len(seq) - k + 1, BLOCK)])[place]
    fresh = np.concatenate([[True], (which[1:] != which[:-1]) | (turn[1:] != turn[:-1])])
    begin = np.flatnonzero(fresh)
    rank = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
    first = np.flatnonzero(rank % (x + 1) == 0)
    return place[first], np.diff(np.append(first, len(place))), turn[first]


def signature_text(value: int, m: int) -> str:
    return DEFAULT if value == 4**m else "".join("ACGT"[value >> (2 * j) & 3] for j in range(m - 1, -1, -1))


def signature_texts(values: np.ndarray, m: int) -> pa.Array:
    """The text of each signature number, made once per distinct one."""
    distinct, at = np.unique(values, return_inverse=True)
    return pa.array([signature_text(v, m) for v in distinct.tolist()], pa.string()).take(pa.array(at))


def cuts(seq: bytes, start: np.ndarray, length: np.ndarray, turned: np.ndarray | None = None) -> pa.Array:
    """The stretches of a read as texts, many at once; those that are turned as reverse complements."""
    if len(start) > AT_ONCE:
        return pa.concat_arrays([cuts(seq, start[a : a + AT_ONCE], length[a : a + AT_ONCE], None if turned is None else turned[a : a + AT_ONCE]) for a in range(0, len(start), AT_ONCE)])
    raw = np.frombuffer(seq, dtype=np.uint8)
    ends = np.cumsum(length)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    place = np.arange(int(offsets[-1])) - np.repeat(ends - length, length)
    if turned is None:
        data = raw[np.repeat(start, length) + place]
    else:
        back = np.repeat(turned == 1, length)
        data = raw[np.repeat(start, length) + np.where(back, np.repeat(length, length) - 1 - place, place)]
        data = np.where(back, _REVERSE[data], data)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data.astype(np.uint8)))


def mapped(reads: DataFrame, rows_of, schema: str, keep: tuple[str, ...]) -> DataFrame:
    """``rows_of(seq)`` gives an array per column of ``schema``, of Arrow for texts, for each read."""
    rows = reads.select(*keep, F.encode(F.coalesce("seq", F.lit("")), "utf-8").alias("seq"))
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, at, size = [], [], 0
            for i, seq in enumerate(batch.column(len(keep))):
                columns = rows_of(seq.as_py())
                parts.append(columns)
                at.append(np.full(len(columns[0]), i, dtype=np.int32))
                size += len(columns[0])
                if size > 200_000:
                    yield made(batch, parts, at)
                    parts, at, size = [], [], 0
            yield made(batch, parts, at)

    def made(batch: pa.RecordBatch, parts: list, at: list) -> pa.RecordBatch:
        source = pa.array(np.concatenate(at) if at else np.zeros(0, dtype=np.int32))
        columns = [pa.array([], t) if not parts else pa.concat_arrays([p[j] for p in parts]) if t == pa.string() else pa.array(np.concatenate([p[j] for p in parts]).astype(t.to_pandas_dtype()), t) for j, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*(batch.column(j).take(source) for j in range(len(keep))), *columns], [*keep, *names])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, {schema}" if keep else schema)


def super_kmers(reads: DataFrame, k: int, m: int, bins: int | None = None, *keep: str) -> DataFrame:
    """(read_id, keep..., start, sig, sig_number, sig_pos, super_kmer, n_kmers and, if ``bins`` is given, bin)."""

    def rows_of(seq: bytes):
        s = super_kmers_of(seq, k, m)
        return s.start, signature_texts(s.sig, m), s.sig, s.pos, cuts(seq, s.start, s.n + (k - 1)), s.n

    made = mapped(reads, rows_of, "start bigint, sig string, sig_number bigint, sig_pos bigint, super_kmer string, n_kmers bigint", ("read_id", *keep))
    return made if bins is None else made.withColumn("bin", bin_of(F.col("sig_number"), bins))


def kmer_signatures(reads: DataFrame, k: int, m: int) -> DataFrame:
    """(read_id, i, sig, sig_pos) of every valid k-mer."""

    def rows_of(seq: bytes):
        s = super_kmers_of(seq, k, m)
        place = np.repeat(s.start, s.n) + np.arange(s.n.sum()) - np.repeat(np.cumsum(s.n) - s.n, s.n)
        return place, signature_texts(np.repeat(s.sig, s.n), m), np.repeat(s.pos, s.n)

    return mapped(reads, rows_of, "i bigint, sig string, sig_pos bigint", ("read_id",))


def signatures_of_kmers(kmers: DataFrame, k: int, m: int) -> DataFrame:
    """(kmer, sig, sig_pos) of a table of k-mers that all have k bases, many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                kmer = batch.column(0).slice(a, AT_ONCE)
                codes, n = codes_of(b"".join(kmer.cast(pa.binary()).to_pylist())), len(kmer)
                norm = np.append(norms(codes, m), np.zeros(m - 1, dtype=np.int64)).reshape(n, k)[:, : k - m + 1]
                at = norm.argmin(axis=1)  # the leftmost
                yield pa.RecordBatch.from_arrays([kmer, number_texts(norm[np.arange(n), at], m), pa.array(at.astype(np.int32))], ["kmer", "sig", "sig_pos"])

    return kmers.select("kmer").mapInArrow(run, "kmer string, sig string, sig_pos int")


def number_texts(values: np.ndarray, m: int) -> pa.Array:
    """``signature_texts`` where nearly all numbers are different: digit by digit."""
    letters = np.frombuffer(b"ACGT", dtype=np.uint8)[(values[:, None] >> (2 * np.arange(m - 1, -1, -1))) & 3]
    none = values == 4**m
    letters[none, 0] = ord(DEFAULT)
    used = np.where(none, 1, m)
    data = letters[np.arange(m) < used[:, None]]
    return pa.StringArray.from_buffers(len(values), pa.py_buffer(np.concatenate([[0], np.cumsum(used)]).astype(np.int32)), pa.py_buffer(data))


def counted_super_kmers(reads: DataFrame, k: int, m: int, *keep: str) -> DataFrame:
    """(keep..., sig_number, read_id, at, n, n_kmers): super-k-mers added up by number and ``keep`` in each batch of reads.

    Of chunks of long sequences, which have a ``chunk_start``, those that touch a border come one by one with their read and
    the place ``at`` of their signature; both are null else.
    """
    chunked = "chunk_start" in reads.columns
    start = F.col("chunk_start").cast("long") if chunked else F.lit(0).cast("long")
    rows = reads.select(*keep, F.encode(F.coalesce("seq", F.lit("")), "utf-8").alias("seq"), F.col("read_id").cast("long").alias("read_id"), start.alias("chunk_start"))
    kinds, names = [rows.schema[c].dataType.simpleString() for c in keep], [*keep, "sig_number", "read_id", "at", "n", "n_kmers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers: dict[tuple, int] = {}  # of the different values of ``keep``
            of = [numbers.setdefault(key, len(numbers)) for key in zip(*(batch.column(j).to_pylist() for j in range(len(keep))))] if keep else [0] * batch.num_rows
            where, seqs = [batch.column(len(keep) + j).to_numpy() for j in (1, 2)], batch.column(len(keep)).to_pylist()
            s = super_kmers_of(b"N".join(seqs), k, m)  # no k-mer reaches over the end of a read
            size = np.array([len(x) for x in seqs])
            begin = np.cumsum(size + 1) - size - 1
            i = np.searchsorted(begin, s.start, side="right") - 1
            border = (s.start == begin[i]) | (s.start + s.n + (k - 1) == begin[i] + size[i]) if chunked else np.zeros(len(i), dtype=bool)
            e = np.flatnonzero(border)
            group = np.array(of, dtype=np.int64)[i]
            parts = list(zip(group[e].tolist(), s.sig[e].tolist(), where[0][i[e]].tolist(), (where[1][i[e]] + s.pos[e] - begin[i[e]]).tolist(), [1] * len(e), s.n[e].tolist()))
            both, at = np.unique(group[~border] * (4**m + 1) + s.sig[~border], return_inverse=True)
            total = np.bincount(at, weights=s.n[~border], minlength=len(both)).astype(np.int64)
            parts += [(x // (4**m + 1), x % (4**m + 1), None, None, many, t) for x, many, t in zip(both.tolist(), np.bincount(at, minlength=len(both)).tolist(), total.tolist())]
            key, *columns = zip(*parts) if parts else [()] * 6
            source = {v: of.index(v) for v in set(of)}
            kept = pa.array([source[x] for x in key], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(kept) for j in range(len(keep))), *(pa.array(c, pa.int64()) for c in columns)], names)

    return rows.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in zip(keep, kinds)), "sig_number long, read_id long, at long, n long, n_kmers long"]))


def kx_mers(reads: DataFrame, k: int, m: int, x: int) -> DataFrame:
    """(read_id, start, x, orientation, kxmer): a run's bases, as the reverse complement if it is turned."""

    def rows_of(seq: bytes):
        start, n, turn = kx_mers_of(seq, super_kmers_of(seq, k, m), k, x)
        return start, n - 1, turn, cuts(seq, start, n + (k - 1), turn)

    return mapped(reads, rows_of, "start bigint, x bigint, orientation int, kxmer string", ("read_id",))
