"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the windows of ``WINDOW`` consecutive words of each benchmark item (an item of fewer words
is one window). Windows of one length m are searched together. The shift table knows, for every block
of B words that occurs in a window, the least distance from its end to the window's end; a block
that isn't in the table lets the search move on by m - B + 1 words. Where the shift is 0, the bucket of
the block (the windows' last words) names the windows that may end here, their first words are looked at,
and a direct comparison of all words confirms the occurrence.

Words are compared as UTF-8 bytes after lowering A-Z; one of over ``LONG`` bytes by its digest. The benchmark goes to the
workers in blocks of at most ``MAX_BLOCK_BYTES`` words and ids, each block with a scan of its own: any benchmark is
searched whole, and no broadcast is larger. Equal texts are one text with a list of ids (in several parts if there are
very many), and long ones are cut into pieces that overlap by a window less a word, so that no window is lost.

Defined results: a null text has no words; items without words never occur; an item of a null id is searched and left out
of the lists; items that repeat an id are one id; rows that repeat an id are searched row by row; empty
tables give no rows or no hits. Columns beside the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import slices, text_key, utf8

WINDOW, BLOCK = 10, 3
MAX_BLOCK_BYTES = 4 << 20
#: Bytes of a word that is compared itself.
LONG = 64

#: Bytes of words stay (A-Z lowered), all others become a space.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                   for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words; upper-case letters stand only in digests."""
    words = text.translate(WORD_BYTES).split()
    if words and max(map(len, words)) > LONG:
        words = [w if len(w) <= LONG else b"Z" + hashlib.blake2b(w, digest_size=24).hexdigest().upper().encode() for w in words]
    return words


def cut(words: list[bytes], window: int, limit: int) -> Iterator[bytes]:
    """Pieces of about ``limit`` bytes, a window at least, that hold every window of the words."""
    start = 0
    while start < len(words):
        end, size = start, 0
        while end < len(words) and (end - start < window or size + len(words[end]) < limit):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[start:end])
        if end == len(words):
            return
        start = end - window + 1


class WuManber:
    """Windows of one length m over the items' words."""

    def __init__(self, m: int, items: list[list[bytes]], windows: list[tuple[int, int]]):
        self.m, self.b, self.items = m, min(BLOCK, m), items
        self.step = m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[bytes, list[tuple[int, int]]]] = {}
        for item, start in windows:
            words = items[item]
            for q in range(self.step):
                block = tuple(words[start + q: start + q + self.b])
                away = self.step - 1 - q
                if self.shift.get(block, self.step) > away:
                    self.shift[block] = away
            last = tuple(words[start + m - self.b: start + m])
            self.bucket.setdefault(last, {}).setdefault(words[start], []).append((item, start))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start in words, item) of every occurrence."""
        m, b, step, shift = self.m, self.b, self.step, self.shift
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b: end])
            away = shift.get(block, step)
            if away:
                end += away
                continue
            start = end - m
            tests = self.bucket.get(block, {}).get(words[start])
            if tests:
                here = words[start:end]
                for item, at in tests:
                    if self.items[item][at:at + m] == here:
                        yield start, item
            end += 1


class Searcher:
    """All windows of a block of pieces (words with spaces between), one table for each length."""

    def __init__(self, items: list[bytes], window: int = WINDOW):
        words = [t.split() for t in items]
        lengths: dict[int, list[tuple[int, int]]] = {}
        for i, ws in enumerate(words):
            m = min(window, len(ws))
            if m:
                lengths.setdefault(m, []).extend((i, s) for s in range(len(ws) - m + 1))
        self.tables = [WuManber(m, words, w) for m, w in sorted(lengths.items())]

    def search(self, words: list[bytes]) -> tuple[list[int], list[int], set[int]]:
        """Maximal hit runs (starts and ends, in words) and the items that occur."""
        found = sorted((s, s + t.m, i) for t in self.tables for s, i in t.search(words))
        starts, ends, items = [], [], set()
        for s, e, i in found:
            items.add(i)
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        return starts, ends, items


def _usable(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where(
        F.col("text").isNotNull())


def item_pieces(benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_BLOCK_BYTES) -> DataFrame:
    """(ids, piece): the pieces of the distinct texts with the ids that have them. A row holds about half the limit of
    words, or a window, and a quarter of it of ids: with more rows, the ids of a text are dealt to several lists."""
    items = _usable(benchmark)
    lists = max(1, -(-32 * items.count() // limit))
    texts = items.groupBy("text", F.pmod(F.xxhash64("item_id"), F.lit(lists)).alias("_list")).agg(
        F.collect_set("item_id").alias("ids")).select("ids", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for batch in slices(batches, "text"):
            rows = [(ids, piece) for ids, text in zip(batch.column("ids").to_pylist(), utf8(batch, "text"), strict=True)
                    for piece in cut(words_of(text), window, limit // 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                                              pa.array([r[1] for r in rows], pa.binary())], names=["ids", "piece"])

    return texts.mapInArrow(run, "ids array<bigint>, piece binary")


def item_blocks(benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_BLOCK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and pieces by block of at most ``limit`` bytes, or one row; the driver holds a block at a time."""
    ids, pieces, held = [], [], 0
    for row in item_pieces(benchmark, window, limit).toLocalIterator():
        size = len(row["piece"]) + 8 * len(row["ids"])
        if pieces and held + size > limit:
            yield ids, pieces
            ids, pieces, held = [], [], 0
        ids.append(row["ids"])
        pieces.append(bytes(row["piece"]))
        held += size
    if pieces:
        yield ids, pieces


def _scan(docs: DataFrame, ids: list, texts: list[bytes], window: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with n_words, starts, ends and items of each text."""
    block = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        ids, texts = block.value
        searcher = Searcher(texts, window)
        for batch in slices(batches, "text"):
            out = {k: [] for k in ("n_words", "starts", "ends", "items")}
            for text in utf8(batch, "text"):
                words = words_of(text)
                starts, ends, items = searcher.search(words)
                for k, x in zip(out, (len(words), starts, ends, sorted({x for i in items for x in ids[i]})), strict=True):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(out["n_words"], pa.int64()),
                 pa.array(out["starts"], pa.list_(pa.int32())), pa.array(out["ends"], pa.list_(pa.int32())),
                 pa.array(out["items"], pa.list_(pa.int64()))], names=[*keep, *out])

    found = _parse_datatype_string("n_words bigint, starts array<int>, ends array<int>, items array<bigint>")
    return docs.select(*keep, "text").mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *found.fields]))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_BLOCK_BYTES) -> DataFrame:
    """(doc_id, tk, n_words, starts, ends, items) by row: maximal runs of hit words and the items that occur;
    tk is the digest of the text. One scan of the documents, without a shuffle, for each block of items."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("tk"), F.col("text").alias("text"))
    blocks = item_blocks(benchmark, window, limit)
    scans = [_scan(slim, *block, window, ["doc_id", "tk"]) for block in blocks] or [_scan(slim, [], [], window, ["doc_id", "tk"])]
    if len(scans) == 1:
        return scans[0]
    every = scans[0]
    for s in scans[1:]:
        every = every.unionByName(s)
    # each scan gives the same number of rows for a text that repeats; runs of several scans are merged
    merged = every.groupBy("doc_id", "tk").agg(
        (F.count(F.lit(1)) / len(scans)).cast("int").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set(F.arrays_zip("starts", "ends")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    empty = F.array().cast("array<struct<starts:int,ends:int>>")

    def join(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            last["starts"].alias("starts"), F.greatest(last["ends"], r["ends"]).alias("ends"))))
        return F.when((F.size(acc) > 0) & (r["starts"] <= last["ends"]), longer).otherwise(F.concat(acc, F.array(r)))

    merged = merged.withColumn("runs", F.aggregate("runs", empty, join))
    return merged.select("doc_id", "tk", "n_words", F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"),
                         "items", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).drop("_")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, all columns kept; a scan and a filter for each block of items, no shuffle."""
    key = "_row"
    for block in item_blocks(benchmark, window, limit):
        searched = _scan(docs.select(F.struct("*").alias(key), F.col("text")), *block, window, [key])
        docs = searched.where(F.size("starts") == 0).select(f"{key}.*")
    return docs


def hit_words() -> Column:
    """Number of hit words."""
    return F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("bigint")), F.lit(0).cast("bigint"),
                       lambda a, x: a + x)
