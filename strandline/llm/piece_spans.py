"""SentencePiece ids of whole texts with the span of source bytes that each piece stands for, and back.

1. A text is normalised as the model says: at each place the longest prefix that the compiled character
   map has a rule for is rewritten, everything else stays; spaces are put in front, merged and escaped as the model asks.
   Every byte of the normalised text records the place of the source characters that it was made of.
2. The library encodes the text. A piece covers as many bytes of the normalised text as it is long (a
   byte piece covers one), so running sums of lengths give its place there, and the records give
   its span in the source. That the lengths add up to the normalised text is checked for every text.
3. The library decodes the ids again.

Texts are taken whole, each where it is read; nothing is shuffled, and a lost executor repeats its
tasks. Characters that begin no rule, all of them with a model without rules, never come to
the rewriting loop: their records are made by arrays.

Of several byte pieces of one character the last one has its span and the others are empty at its
start, as in the library; a closing id is empty at the end of the text.

Edge cases: a null text is an empty one, whose only id is the closing one; very long texts are encoded whole,
as one row; repeated rows each give a row and null ids stay; characters without a piece become byte
pieces, or the model's unknown piece; U+0000 and control strings inside a text are ordinary characters to the library;
an empty table gives an empty one; other columns, whatever their names, are ignored; ties cannot arise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import text_of

SPACE = "▁".encode()
BLANK = 32
ENCODED = "ids array<int>, begins array<int>, ends array<int>, decoded string"


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 bytes, and the texts that it points to.

    Fixed values, the published layout of the trie's 32-bit units: bit 31 and the low eight bits label a unit,
    bit 8 says that it has a value, bits 10 to 30 are the distance to its children, in units or, with bit 9, in 256 of them;
    a unit with bit 31 set is a value. The map begins with the trie's size in bytes.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]
        self._begins: dict[str, bool] = {}

    def _walk(self, data: bytes, at: int) -> Iterator[tuple[int, int | None]]:
        """(end, value or None) of each node on the way of ``data`` from ``at``."""
        place = self._children(0)
        for end in range(at, len(data)):
            place ^= data[end]
            unit = self.units[place]
            if unit & 0x800000FF != data[end]:
                return
            place ^= self._children(place)
            yield end + 1, self.units[place] & 0x7FFFFFFF if unit >> 8 & 1 else None

    def _children(self, place: int) -> int:
        unit = self.units[place]
        return unit >> 10 << (8 if unit >> 9 & 1 else 0)

    def begins(self, c: str) -> bool:
        """Whether a rule begins with this character."""
        if c not in self._begins:
            raw = c.encode()
            self._begins[c] = bool(self.units) and any(end == len(raw) for end, _ in self._walk(raw, 0))
        return self._begins[c]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(end, replacement) of the longest prefix with a rule."""
        found = None
        for end, value in self._walk(data, at):
            if value is not None:
                found = end, value
        return found and (found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])])


class Model:
    """A SentencePiece model with the alignment of its pieces to source bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rules, self.map = proto.normalizer_spec, CharacterMap(proto.normalizer_spec.precompiled_charsmap)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are kept from rewriting; such models are not supported")
        length = {kinds.BYTE: lambda p: 1, kinds.CONTROL: lambda p: 0, kinds.UNKNOWN: lambda p: -1}
        self.length = np.array([length.get(p.type, lambda p: len(p.piece.encode()))(p) for p in proto.pieces], dtype=np.int64)

    def rewritten(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The bytes after the character map, and for each the place of its source."""
        raw = np.frombuffer(data, dtype=np.uint8)
        place = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0)) if len(raw) else np.zeros(0, dtype=np.int64)
        first = [re.escape(c.encode()) for c in set(text) if self.map.begins(c)]
        if not first:
            return raw, place
        new, origin, done = [], [], 0
        for met in re.finditer(b"|".join(first), data):
            at = met.start()
            if at < done or not (rule := self.map.longest(data, at)):
                continue
            end, text_of_rule = rule
            new += [raw[done:at], np.frombuffer(text_of_rule, dtype=np.uint8)]
            origin += [place[done:at], np.full(len(text_of_rule), at)]
            done = end
        return np.concatenate([*new, raw[done:]]), np.concatenate([*origin, place[done:]])

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the place in the source of each of its bytes and of its end."""
        data = text.encode()
        new, origin = self.rewritten(text, data)
        end = len(data)
        if self.rules.remove_extra_whitespaces and len(new):
            blank = new == BLANK
            kept = np.flatnonzero(~(blank & np.concatenate([[True], blank[:-1]])))
            new, origin = new[kept], origin[kept]
            left = len(new.tobytes().decode("utf-8", "replace").rstrip(" ▁" if self.rules.escape_whitespaces else " ").encode())
            if left < len(new):
                new, origin, end = new[:left], origin[:left], origin[left]
        if not len(new):
            return b"", np.array([end])
        if self.rules.add_dummy_prefix:
            extra = np.array([BLANK], dtype=np.uint8)
            new, origin = (np.concatenate([new, extra]), np.append(origin, end)) if self.suffix else (np.concatenate([extra, new]), np.concatenate([origin[:1], origin]))
        if self.rules.escape_whitespaces:
            origin = np.repeat(origin, np.where(new == BLANK, len(SPACE), 1))
            return new.tobytes().replace(b" ", SPACE), np.append(origin, end)
        return new.tobytes(), np.append(origin, end)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with a closing one, and the first byte and the end of each in the source."""
        ids = np.array(self.library.encode(text, add_bos=False, add_eos=True, enable_sampling=False, num_threads=1), dtype=np.int32)
        length = self.length[ids]
        if (length < 0).any():  # an unknown piece is as long as what it stands for
            length = np.array([0 if i == self.library.eos_id() else len(p.encode()) for i, p in zip(ids, self.library.encode(text, add_eos=True, out_type=str), strict=True)])
        new, origin = self.normalised(text)
        border = np.concatenate([[0], np.cumsum(length)])
        if border[-1] != len(new):
            raise ValueError(f"pieces cover {border[-1]} bytes of a normalised text of {len(new)}")
        return ids, origin[border[:-1]].astype(np.int32), origin[border[1:]].astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *values])))


def encode_with_spans(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, begins and ends (places in the text's UTF-8 bytes, as long as ids) and the decoded text of every whole text."""
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for batch in batches:
            made, back = [], []
            for value in batch.column(1):
                made.append(model.encode(value.as_py()))
                back.append(model.decode(made[-1][0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_lists([m[k] for m in made]) for k in range(3)), pa.array(back, pa.string())], [id_col, "ids", "begins", "ends", "decoded"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, {ENCODED}")


def surfaces(text: Column, begins: Column, ends: Column) -> Column:
    """The source bytes of every piece."""
    return F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda s: F.substring(text.cast("binary"), s["a"] + 1, s["b"] - s["a"]))


def encoding_report(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the bytes that the spans cover."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    covered = F.aggregate(F.zip_with("ends", "begins", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return encode_with_spans(docs, model_path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), covered.alias("spanned_bytes")
    )
