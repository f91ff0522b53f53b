"""SentencePiece encoding and decoding with source offsets.

A text is normalised by longest-prefix replacement through the model's compiled character map, and every byte of the normalised text keeps
the source byte it came from. The library segments the normalised text (a copy of the model whose own normaliser does nothing), and each
piece is projected back to the source bytes that it covers.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorelake.llm.common import kept, model_file, ship, slices, utf8

MARK = "▁"
SCHEMA = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("spans", T.BinaryType()), T.StructField("decoded", T.StringType())])


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def proto_fields(b: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(field number, value, raw bytes) of a serialised protocol-buffer message."""
    i = 0
    while i < len(b):
        at = i
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value, b[at:i]


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes whose leaves point into zero-ended replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that text has at that place."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.strings[found[0] : self.strings.index(0, found[0])], found[1]


class Normalizer:
    """spec: the model's normaliser message. Its fields: 2 the compiled map, 3 add a dummy prefix, 4 remove extra white space, 5 escape it."""

    def __init__(self, spec: bytes):
        own = {f: v for f, v, _ in proto_fields(spec)}
        self.map = CharMap(own.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(own.get(f, 1)) for f in (3, 4, 5))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text, and for each of its bytes and its end the source offset."""
        mark = MARK.encode() if self.escape else b" "
        if not text:
            return b"", np.zeros(1, np.uint32)
        if not self.map.units and not self.squeeze:
            source = np.frombuffer(text, np.uint8)
            place = np.repeat(np.arange(len(text), dtype=np.uint32), np.where(source == 32, len(mark), 1))
            head = mark if self.prefix else b""
            return head + text.replace(b" ", mark), np.concatenate([np.zeros(len(head), np.uint32), place, np.array([len(text)], np.uint32)])
        units: list[tuple[bytes, int, int]] = []  # replacement, start, end
        i = 0
        while i < len(text):
            if self.map.units and (hit := self.map.longest(text, i)):
                units.append((hit[0], i, i := i + hit[1]))
            else:
                n = 1 + (text[i] >= 0xC0) + (text[i] >= 0xE0) + (text[i] >= 0xF0)
                units.append((text[i : i + n], i, i := i + n))
        if self.squeeze:
            while units and units[0][0] == b" ":
                units.pop(0)
        out, place, spaced = bytearray(), [], self.squeeze
        start = units[0][1] if units else len(text)
        if units and self.prefix:
            out += mark
            place += [start] * len(mark)
        for new, a, _ in units:
            if spaced and self.squeeze:
                new = new.lstrip(b" ")
            if new:
                new_out = new.replace(b" ", mark)
                out += new_out
                place += [a] * len(new_out)
                spaced = new.endswith(b" ")
        end = units[-1][2] if units else len(text)
        if self.squeeze:
            while out.endswith(mark):
                end = place[-len(mark)]
                del out[-len(mark) :], place[-len(mark) :]
        return bytes(out), np.array([*place, end], np.uint32)


class Codec:
    """Encoder and decoder for one model file: a path, or a public tokeniser's bare name."""

    def __init__(self, path: str):
        import sentencepiece

        with open(model_file(path), "rb") as f:
            model = f.read()
        spec = b"".join(v for f, v, _ in proto_fields(model) if f == 3)
        plain = bytes([0x18, 0, 0x20, 0, 0x28, 0])  # no prefix, no squeezing, no escaping, no map
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        bare = b"".join(raw for f, _, raw in proto_fields(model) if f != 3) + bytes([0x1A, len(plain)]) + plain
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=bare)
        self.normalize = Normalizer(spec)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([self.library.is_byte(i) for i in range(n)])
        self.lengths = np.array([1 if byte else len(p.encode()) for p, byte in zip(names, self.is_byte, strict=True)], np.int64)
        self.fallback = bool(self.is_byte.any())  # then no piece is unknown
        self.ends = (np.array([self.library.bos_id()], "<u4").tobytes(), np.array([self.library.eos_id()], "<u4").tobytes())

    def spans(self, ids: np.ndarray, norm: bytes, place: np.ndarray) -> np.ndarray:
        """Source begin and end of every piece, as the library gives them: of a character in byte pieces, only the last one covers it."""
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids], out=at[1:])
        out = np.stack([place[at[:-1]], place[at[1:]]], axis=1)
        if (byte := np.flatnonzero(self.is_byte[ids])).size:
            raw = np.frombuffer(norm + b"\0", np.uint8)
            lead = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, np.arange(len(raw)), 0))
            last = (raw[at[byte] + 1] & 0xC0) != 0x80
            out[byte, 0] = place[lead[at[byte]]]
            out[byte, 1] = np.where(last, place[at[byte] + 1], out[byte, 0])
        return out

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids with begin and end as unsigned 32-bit integers, spans as pairs of them) of each text."""
        normal = [self.normalize(t) for t in texts]
        out = []
        for (norm, place), own in zip(normal, self.segmenter.encode([n.decode() for n, _ in normal], num_threads=1), strict=True):
            ids = np.array(own, "<u4")
            if self.fallback:
                spans = self.spans(ids, norm, place)
            else:  # an unknown piece is as long as what it stands for, so the segmenter's own ranges are projected
                own = self.segmenter.encode_as_proto(norm.decode()).pieces
                spans = place[np.array([(p.begin, p.end) for p in own], np.int64).reshape(-1, 2)]
            whole = np.zeros((len(ids) + 2, 2), "<u4")
            whole[1:-1], whole[-1] = spans, place[-1]
            out.append((self.ends[0] + ids.tobytes() + self.ends[1], whole.tobytes()))
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        """The library's text of each sequence of ids."""
        return [self.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]


def codec(path: str) -> Codec:
    return kept(("pieces", path), lambda: Codec(path))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id_col, the columns in `keep`, n_tokens, ids (little-endian unsigned 32-bit, with begin and end), spans (a pair of
    such integers a piece: its UTF-8 byte range in the source; begin and end cover nothing) and decoded, the library's text of the ids.

    Null and empty texts give the begin and end ids and an empty text. Repeated rows and ids give a row each, an empty table none. Columns
    other than those named aren't read, so their names can't clash; `keep` may not name one of the new columns. A text, however long, is whole
    in memory, and so is what it is encoded to.
    """
    ship(docs.sparkSession)
    own = docs.select(id_col, text_col, *(c for c in keep if c not in (id_col, text_col)))
    schema = T.StructType([own.schema[id_col], *(own.schema[c] for c in keep if c != id_col), *SCHEMA])
    named = [id_col, *(c for c in keep if c != id_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in slices(batches, 1):
            pairs = c.encode(utf8(b.column(1)))
            ids = [x for x, _ in pairs]
            cols = [b.column(b.schema.get_field_index(n)) for n in named]
            cols += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([x for _, x in pairs], pa.binary()), pa.array(c.decode(ids), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*named, "n_tokens", "ids", "spans", "decoded"])

    return own.mapInArrow(run, schema)
