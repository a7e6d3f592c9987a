"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``CHUNK`` characters is counted whole. A longer one is never handed to the tokeniser
whole: it is encoded in overlapping chunks, with offsets. The first chunk starts where the text
starts, so its pre-tokens are those of the whole text, but for a margin at its cut end (``MARGIN``
characters and the last pre-token, which the cut may have changed). The next chunk starts anywhere,
but once one of its pre-tokens begins where one of the proven ones begins, all that follow are right:
the pre-tokeniser never looks back across a boundary. So both encodings are spliced at the last such
common boundary in the overlap, the right one now counts as proven, and so on. Where the overlap
has no common boundary (one pre-token longer than it, say) the overlap is doubled until it has, or until
the left chunk holds all that is left.

Texts counted whole are cut where a space follows a character that isn't white space. No pre-token
and no special token crosses such a place, so each stretch has one count wherever it stands, and a worker
remembers the counts (``REMEMBER`` stretches at most).

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside texts count
as the library's default has it; rows that repeat an id are counted row by row; an empty table gives
no rows; columns beside the named ones are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import stable_stretches
from .common import slices

CHUNK = 1 << 15
OVERLAP = 1 << 9
#: No pre-token boundary this near to a chunk's cut end is proven; longer than any special token.
MARGIN = 64
MAX_FILE_BYTES = 64 << 20
REMEMBER = 300_000
LONGEST = 64


class Counter:
    """Counts within a worker."""

    def __init__(self, definition: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        longest = max((len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), default=0)
        self.margin = max(MARGIN, 2 * longest)
        if not self.margin < overlap < chunk:
            raise ValueError("the overlap must be longer than the margin and shorter than the chunk")
        self.chunk, self.overlap, self.known = chunk, overlap, {}

    def count(self, text: str) -> int:
        return self.spliced(text) if len(text) > self.chunk else self.whole(text)

    def whole(self, text: str) -> int:
        stretches = stable_stretches(text)
        known = self.known
        new = list({s for s in stretches if s not in known})
        if new:
            if len(known) + len(new) > REMEMBER:
                known.clear()
                new = list(set(stretches))
            counts = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            known.update(zip(new, map(len, counts), strict=True))
        total = sum(map(known.__getitem__, stretches))
        for s in new:
            if len(s) > LONGEST:
                del known[s]
        return total

    def boundaries(self, text: str, start: int, end: int) -> dict[int, int]:
        """Of the chunk text[start:end]: pre-token starts (places in the text) and how many tokens lie
        before each; the chunk's end, with all its tokens, comes last."""
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        out, before = {}, None
        for i, (word, (at, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word is None or word != before:
                out[start + at] = i
            before = word
        out[end] = len(e)
        return out

    def spliced(self, text: str) -> int:
        """The count of a text by chunks: all tokens before ``proven`` are counted, and a chunk starts there."""
        n, total, start, overlap = len(text), 0, 0, self.overlap
        end = min(n, self.chunk)
        left = self.boundaries(text, 0, end)
        while end < n:
            cut = end - self.margin
            last = max((p for p in left if p < end), default=start)  # the cut may have changed this pre-token
            begin = max(start, end - overlap)
            stop = min(n, begin + max(self.chunk, 2 * overlap))
            right = self.boundaries(text, begin, stop)
            common = [p for p in right if begin < p < min(cut, last) and p in left]
            if common:
                p = max(common)
                total += left[p] - left[start] if start in left else left[p]
                left = {q: k for q, k in right.items() if q >= p}
                start, end, overlap = p, stop, self.overlap
            elif begin > start:
                overlap *= 2
            else:  # the chunk is one pre-token so far: it needs more text on its right
                end = min(n, start + 2 * (end - start))
                left = self.boundaries(text, start, end)
        return total + left[n] - left.get(start, 0)


def definition(path: str) -> bytes:
    """The tokeniser's file (read by the driver; the bytes travel to the workers)."""
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError("the tokeniser is too large to hold on every worker")
    return data


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) by row."""
    data = df.sparkSession.sparkContext.broadcast(definition(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        counter = Counter(data.value, chunk, overlap)
        for batch in slices(batches, "text"):
            counts = [counter.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    slim = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                     F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = slim.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
