"""Chat formatting with typed content parts.

A message is (conv_id, turn, role, parts); a part is a struct (kind, text, ref, width, height,
seconds, pages). A visitor flattens the parts of a message, in order, into one string: text is
escaped, every image, audio or document part becomes a numbered placeholder, and the attachment
is recorded with its reference, its place and the number of tokens that it expands to.

The template is ``<s>`` + one ``<|im_start|>role<|sep|>content<|im_end|>`` a turn + ``</s>``. Control
strings inside roles and texts are broken by a backslash after their first character, backslashes
are doubled, so that ``unescape`` restores the text and the parser can't be misled.

Defined results: a null role or text is empty; a message without parts has empty content; a null
part is skipped; a part of unknown kind raises. Turns sort by turn (null first), then role, then
content, so ties and repeated rows have one order, and repeated rows are repeated turns. Rows
with a null conv_id form one conversation. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, TURN, SEP, END = "<s>", "</s>", "<|im_start|>", "<|sep|>", "<|im_end|>"

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,ordinal:int,ref:string,offset:int,tokens:bigint>"
SEGMENTS = ("conv_id bigint, turn bigint, role string, segment string, loss_start int, loss_end int, "
            f"attachments array<{ATTACHMENT}>, expanded_tokens bigint")
DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint, n_attachments bigint, expanded_tokens bigint")

_OPENS = re.compile(r"<(?=\||s>|/s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(r"<\|im_start\|>(.*?)<\|sep\|>(.*?)<\|im_end\|>", re.S)


def escape(text: str) -> str:
    return _OPENS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Rates:
    """Tokens that a part expands to: images by 512-pixel tiles, audio by second, documents by page."""

    image_base: int = 85
    image_tile: int = 170
    tile: int = 512
    audio_second: int = 25
    document_page: int = 600


class Visitor:
    """Flattens the parts of one message; ``visit`` dispatches on the part's kind."""

    def __init__(self, rates: Rates):
        self.rates, self.out, self.at, self.tokens, self.attachments = rates, [], 0, 0, []

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part['kind']}", None)
        if method is None:
            raise ValueError(f"unknown content part {part['kind']!r}")
        method(part)

    def emit(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def attach(self, part: dict, tokens: int) -> None:
        ordinal = len(self.attachments)
        self.attachments.append({"kind": part["kind"], "ordinal": ordinal, "ref": part["ref"], "offset": self.at,
                                 "tokens": tokens})
        self.tokens += tokens
        self.emit(f"<|{part['kind']}:{ordinal}|>")

    def visit_text(self, part: dict) -> None:
        text = part["text"] or ""
        self.tokens += len(text.split())
        self.emit(escape(text))

    def visit_image(self, part: dict) -> None:
        r, w, h = self.rates, part["width"] or 0, part["height"] or 0
        self.attach(part, r.image_base + r.image_tile * math.ceil(w / r.tile) * math.ceil(h / r.tile))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part["seconds"] or 0) * self.rates.audio_second))

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part["pages"] or 0) * self.rates.document_page)


def text_message(text: Column) -> Column:
    """The parts of a message that is one text."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null.alias("ref"),
                            null.alias("width"), null.alias("height"), null.alias("seconds"),
                            null.alias("pages"))).cast(f"array<{PART}>")


def format_turns(messages: DataFrame, rates: Rates = Rates(), loss_role: str = "assistant") -> DataFrame:
    """One row a turn: its segment of the formatted conversation, the code points of the segment under
    the loss mask, the attachments (offset: code points into the segment) and the expanded tokens.
    Row by row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("ordinal", pa.int32()), ("ref", pa.string()),
                                    ("offset", pa.int32()), ("tokens", pa.int64())]))
        for batch in batches:
            rows = {k: [] for k in ("role", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens")}
            for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                role = role or ""
                v = Visitor(rates)
                v.emit(f"{TURN}{escape(role)}{SEP}")
                start = v.at
                for part in parts or ():
                    if part is not None:
                        v.visit(part)
                end = v.at
                v.emit(END)
                masked = (start, end) if role == loss_role else (0, 0)
                for k, x in zip(rows, (role, "".join(v.out), *masked, v.attachments, v.tokens), strict=True):
                    rows[k].append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(rows["role"], pa.string()),
                 pa.array(rows["segment"], pa.string()), pa.array(rows["loss_start"], pa.int32()),
                 pa.array(rows["loss_end"], pa.int32()), pa.array(rows["attachments"], kinds),
                 pa.array(rows["expanded_tokens"], pa.int64())],
                names=["conv_id", "turn", *rows])

    slim = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                           "role", "parts")
    return slim.mapInArrow(run, SEGMENTS)


def ordered(segments: DataFrame) -> DataFrame:
    """Segments dealt by conversation and in order within it: what a writer or reader streams over."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")


class _Reader:
    """Reads one formatted conversation segment by segment; keeps only the running digests."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.files, self.tokens = conv_id, 0, 0, len(BOS), 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, segment: str, start: int, end: int, attachments, tokens: int) -> None:
        m = _SEGMENT.fullmatch(segment)
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        text = unescape(segment[start:end])
        self.loss_chars += len(text)
        self.loss.update(text.encode())
        self.files += len(attachments)
        self.tokens += tokens

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars + len(EOS), self.files, self.tokens)


def digests(segments: DataFrame) -> DataFrame:
    """One row a conversation, read back from its formatted segments. The turns of a conversation
    stream through one task in order (a digest over ordered text has no other way), but only the
    running digests are held, so that a conversation of any length needs the same memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments",
                 "expanded_tokens"]
        pack = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        now, done = None, []
        for batch in batches:
            for conv_id, *rest in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv_id)
                now.read(*rest)
            if len(done) >= 10_000:
                yield pack(done)
                done = []
        if now is not None:
            yield pack([*done, now.row()])

    return ordered(segments).mapInArrow(run, DIGESTS)
