"""Byte-level BPE encoding and decoding through a sentencepiece model made from the ranks.

A rank file (token bytes, rank) is turned into a sentencepiece BPE model without any training: every
token becomes a piece whose bytes are mapped one to one to printable characters, its score is the
negative rank, the normaliser is the identity and no prefix or white-space rule applies. Merging the
pair of the highest score, leftmost first, is then merging by the lowest rank, and piece numbers are
ranks. Texts are cut into pre-tokens by the pattern, each is encoded alone, and ids decode by joining
their pieces and mapping the characters back to bytes.

Equal stretches of text are encoded once per worker and remembered: wherever a space follows
a character that isn't white space, no pre-token crosses, so the stretches between such places have
the same ids in every text. The memory is bounded in bytes (``REMEMBER_BYTES``, then it starts anew).

Defined results: a null text is empty, an empty text has no ids; every UTF-8 text decodes to its own
bytes; rows that repeat an id are encoded row by row; an empty table gives no rows; all columns stay, new
ones replace columns of their names. A rank file without all 256 single bytes raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, unused

#: Bound of the model that goes to every worker, and of what a worker remembers.
MAX_MODEL_BYTES = 32 << 20
REMEMBER_BYTES = 32 << 20
#: Bytes that a remembered stretch takes besides its characters and ids, and the longest that is remembered.
ENTRY_BYTES = 250
LONGEST = 64

ENCODED = "ids_bytes binary, n_tokens bigint"
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

#: A space after a character that isn't white space: no pre-token crosses this place.
_PLACES = re.compile(r"(?<=\S)(?= )")
_RARE = re.compile(r"\s ")


def byte_characters() -> list[str]:
    """A printable character for each byte: the byte's own Latin-1 character where that is printable
    and no space, else the next unused one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


def read_ranks(lines: bytes) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank."""
    ranks = {int(r): base64.b64decode(t) for t, r in (x.split() for x in lines.splitlines() if x)}
    if sorted(ranks) != list(range(len(ranks))) or len({t for t in ranks.values() if len(t) == 1}) < 256:
        raise ValueError("ranks must be 0, 1, 2, ... and hold every single byte")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model of the ranks; the unknown piece comes last and never occurs."""
    to = byte_characters()
    pieces = [_field(1, "".join(to[b] for b in t).encode()) + _field(2, float(-i)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(
        _field(n, (1 << 64) - 1) for n in (41, 42, 43))  # model type BPE; no begin, end or padding piece (-1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes within a worker."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        to = byte_characters()
        self.to = {b: to[b] for b in range(256)}
        self.back = {ord(c): chr(b) for b, c in self.to.items()}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def mapped(self, text: str) -> str:
        """The byte characters of a text."""
        return text.encode().decode("latin-1").translate(self.to)

    def stretch_ids(self, stretches: list[str]) -> None:
        """Encodes the stretches, pre-token by pre-token, and remembers them."""
        parts = [self.split(s) for s in stretches]
        ids = iter(self.model.encode([self.mapped(p) for ps in parts for p in ps], num_threads=1))
        for s, ps in zip(stretches, parts, strict=True):
            flat = [i for _ in ps for i in next(ids)]
            self.known[s] = struct.pack(f"<{len(flat)}I", *flat)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        stretches = stable_stretches(text)
        new = {s for s in stretches if s not in self.known}
        if new:
            self.stretch_ids(list(new))
        out = b"".join(map(self.known.__getitem__, stretches))
        for s in new:
            if len(s) > LONGEST:
                del self.known[s]
            else:
                self.held += ENTRY_BYTES + 4 * len(s) + len(self.known[s])
        if self.held > REMEMBER_BYTES:
            self.known.clear()
            self.held = 0
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for: their pieces joined, each character mapped back."""
        pieces = self.pieces
        return b"".join(map(pieces.__getitem__, memoryview(ids).cast("I")))

    @property
    def pieces(self) -> list[bytes]:
        got = self.__dict__.get("_pieces")
        if got is None:
            n = self.model.get_piece_size() - 1
            got = self.__dict__["_pieces"] = [
                self.model.id_to_piece(i).translate(self.back).encode("latin-1") for i in range(n)]
        return got


def stable_stretches(text: str) -> list[str]:
    """The text cut at every space that follows a character that isn't white space."""
    if not _RARE.search(text):
        first, *rest = text.split(" ")
        if first or not rest:
            return [first, *[" " + x for x in rest]] if first else []
    return [s for s in _PLACES.split(text) if s]


def model_bytes(path: str) -> bytes:
    """The model of the rank file at ``path`` (read by the driver; the bytes travel to the workers)."""
    with open(path, "rb") as f:
        model = model_proto(read_ranks(f.read()))
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError("the vocabulary is too large to hold on every worker")
    return model


def _columns(df: DataFrame, path: str, pattern: str, text: str, schema: str, row) -> DataFrame:
    """``df`` with the columns of ``schema``, which ``row(codec, text)`` gives."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(path))
    names = [x.split()[0] for x in schema.split(", ")]
    name = unused(df, "text")
    df = df.withColumn(name, F.col(text)).drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]
        codec = Codec(model.value, pattern)
        for batch in slices(batches, name):
            rows = [row(codec, t or "") for t in batch.column(name).to_pylist()]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            keep = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *names])

    from pyspark.sql.types import StructType, _parse_datatype_string
    out = StructType([*(f for f in df.schema.fields if f.name != name), *_parse_datatype_string(schema).fields])
    return df.mapInArrow(run, out)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids_bytes`` (ids as little-endian unsigned 32-bit integers) and ``n_tokens``."""
    def row(codec: Codec, t: str) -> tuple:
        ids = codec.encode(t)
        return ids, len(ids) // 4
    return _columns(df, path, pattern, text, ENCODED, row)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded, then decoded from the ids; with
    ``ids`` also ``ids_bytes``, the ids themselves."""
    def row(codec: Codec, t: str) -> tuple:
        got = codec.encode(t)
        out = len(got) // 4, hashlib.sha256(got).hexdigest(), hashlib.sha256(codec.decode(got)).hexdigest()
        return (*out, got) if ids else out
    return _columns(df, path, pattern, text, DIGESTS + (", ids_bytes binary" if ids else ""), row)
