"""Spelling variants grouped through a bit-sliced position index.

The vocabulary is dealt into blocks of words of one length. A block's index holds, for every (position, letter), the bitset of
its words with that letter there. A query word runs over the index letter by letter and keeps two bitsets, 64 words to a
machine word: the words that agree so far without an error, and those with exactly one. At letter i the first is
intersected with the slice of position i. The second takes an error's place in one of three ways: a replaced letter reads
the slices of the same positions, a letter too few in the query those shifted by one to the right, a letter too many those shifted
to the left; the zero-error set enters it at every place. Query blocks of a length meet the index blocks of the
lengths beside it, each pair of blocks in one group; a group returns one row a query (how many words are near, and the
most frequent), so no pairs of words are listed.

A word's form is its most frequent near word if that is ``RATIO`` times as frequent; roots follow the forms by pointer
doubling. Counts rise by the ratio on the way, so there are no cycles, and the rounds grow with the logarithm of the
logarithm of the highest count. Words that share a form are few: a word of n letters has at most (2n + 1) near words a letter of the alphabet.

Defined results: a null text has no words, a null id counts as the empty string in the hash; rows that repeat are
counted again; ties in frequency go to the word smallest in code-point order; an empty table gives no rows; other columns
are not read. Words of any length are indexed; long ones come in blocks of fewer words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the contract: letters of a run, least length and count of a word, one run in so many is misspelled.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, ONE_IN = 6, 5, 199
#: How much more frequent a form is.
RATIO = 5
#: Words in a block, and letters, at most (64 words at least); queries that run at once; bytes of an index kept whole.
BLOCK_WORDS, BLOCK_LETTERS = 1 << 14, 1 << 20
BATCH = 256
KEPT_BYTES = 32 << 20
MAX_PARTITIONS = 1 << 14

NEAR = "word string, n_near bigint, form string, form_n bigint"


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, one_in: int = ONE_IN) -> DataFrame:
    """Every run of ``least`` letters or more as ``word``, A-Z lowered; where ``one_in`` divides crc32(id:run), without the letter
    at that hash modulo the run's length. (A shorter run cannot become a word of ``least`` letters.)"""
    found = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = found.select(low.alias("run"), F.crc32(F.concat_ws(":", "id", low).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH,
               count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """(word, n): the words of ``least`` code points or more that occur ``count`` times or more."""
    words = runs(docs, doc_id, text, least, one_in).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


class Index:
    """Bitsets of a block's words, all of one length, by position and letter."""

    def __init__(self, codes: np.ndarray, letters: int):
        self.codes, self.letters = codes, letters
        n, self.length = codes.shape
        self.width = -(-n // 64)
        self.kept: dict[int, np.ndarray] = {}
        self.keep = self.length if 8 * self.length * letters * self.width <= KEPT_BYTES else 3
        valid = np.zeros(64 * self.width, bool)
        valid[:n] = True
        self.valid = np.packbits(valid, bitorder="little").view("<u8")

    def at(self, position: int) -> np.ndarray:
        """The slice of a position: (letters, 64-bit words)."""
        got = self.kept.get(position)
        if got is None:
            bits = np.zeros((self.letters, 64 * self.width), bool)
            n = len(self.codes)
            bits[self.codes[:, position], np.arange(n)] = True
            got = np.packbits(bits, axis=1, bitorder="little").view("<u8")
            if len(self.kept) >= self.keep:
                self.kept.pop(min(self.kept))
            self.kept[position] = got
        return got

    def one_error(self, queries: np.ndarray) -> np.ndarray:
        """For queries (rows of letter numbers, all of one length) the bitsets of the words exactly one error away."""
        m, length = queries.shape
        shift = self.length - length
        zero = np.repeat(self.valid[None], m, axis=0)
        one = np.zeros_like(zero)
        for i in range(length):
            letter = queries[:, i]
            here = self.at(i)[letter] if i < self.length else np.zeros_like(zero)
            if shift == 0:  # replaced here, or before
                one = (one & here) | (zero & ~here)
            elif shift == 1:  # the query lacks the word's letter before this one, or an earlier one
                one = (one | zero) & self.at(i + 1)[letter]
            else:  # this letter is too many, or an earlier one
                one = (one & self.at(i - 1)[letter] if i else one) | zero
            zero &= here
        return one | zero if shift == 1 else one


def letter_numbers(words: list[str], alphabet: np.ndarray) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    return np.searchsorted(alphabet, points)


def near_in_block(group: pa.Table) -> pa.Table:
    """One row for each query that has near words among the index words: their number, and the first by falling count, then
    word."""
    import pyarrow as pa
    import pyarrow.compute as pc
    asks = group.column("asks")
    index = group.filter(pc.invert(asks)).sort_by([("n", "descending"), ("word", "ascending")])
    words, counts = index.column("word").to_pylist(), index.column("n").to_pylist()
    queries = group.filter(asks).column("word").to_pylist()
    out: tuple[list, list, list, list] = ([], [], [], [])
    if words and queries:
        alphabet = np.unique(np.frombuffer("".join([*words, *queries]).encode("utf-32-le"), "<u4"))
        bits = Index(letter_numbers(words, alphabet), len(alphabet))
        for first in range(0, len(queries), BATCH):
            batch = queries[first:first + BATCH]
            near = bits.one_error(letter_numbers(batch, alphabet))
            found = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
            unit = (near != 0).argmax(axis=1)
            lowest = near[np.arange(len(batch)), unit]
            bit = np.bitwise_count((lowest & -lowest) - np.uint64(1)).astype(np.int64)
            for i in np.flatnonzero(found):
                best = 64 * int(unit[i]) + int(bit[i])
                for column, value in zip(out, (batch[i], int(found[i]), words[best], counts[best]), strict=True):
                    column.append(value)
    return pa.table({"word": pa.array(out[0], pa.string()), "n_near": pa.array(out[1], pa.int64()),
                     "form": pa.array(out[2], pa.string()), "form_n": pa.array(out[3], pa.int64())})


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, n_near, form, form_n) for the words (word, n; distinct) that have near words: how many, and the most frequent with
    its count."""
    sized = words.select("word", "n", F.length("word").alias("len"))
    rows = F.greatest(F.lit(64), F.least(F.lit(block_words), F.floor(F.lit(block_letters) / F.greatest("len", F.lit(1)))))
    many = sized.groupBy("len").count().select("len", F.ceil(F.col("count") / rows).cast("int").alias("blocks"))
    # lengths with more than one block: each has 64 words or more, so k of them take 32 * k^2 letters, counted five times
    many = stored(many.where(F.col("blocks") > 1))

    def joined(df: DataFrame, by, name: str) -> DataFrame:
        part = many.select(F.col("len").alias("_len"), F.col("blocks").alias(name))
        return df.join(F.broadcast(part), by == F.col("_len"), "left").drop("_len").withColumn(name, F.coalesce(name, F.lit(1)))

    own = joined(sized, F.col("len"), "own").withColumn("block", F.pmod(F.xxhash64("word"), "own"))
    sides = []
    for asks in (False, True):
        for shift in (-1, 0, 1):  # the index words' length less the queries'
            other = joined(own, F.col("len") + (F.lit(shift) if asks else F.lit(-shift)), "others")
            meets = other.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(
                "others").cast("bigint") - 1)))
            length = F.col("len") if asks else F.col("len") - shift  # the queries' length
            ours, theirs = (("other", "block") if asks else ("block", "other"))
            sides.append(meets.select(F.struct(length.alias("len"), F.lit(shift).alias("shift"), F.col(ours).alias("index"), F.col(
                theirs).alias("query")).alias("cell"), F.lit(asks).alias("asks"), "word", "n"))
    every = sides[0]
    for side in sides[1:]:
        every = every.unionByName(side)
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    found = every.repartition(min(parts, MAX_PARTITIONS), "cell").groupBy("cell").applyInArrow(near_in_block, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("back"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.back")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word on the way along the forms. Every round doubles the steps and is stored."""
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull(
            ).alias("moved"))
        now = stored(step)
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT,
             one_in: int = ONE_IN, ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = stored(vocabulary(docs, doc_id, text, least, count, one_in))
    near = near_words(words, block_words)
    formed = F.col("form_n") >= ratio * F.col("n")
    found = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("form")).alias("form"),
        F.when(formed, F.col("form_n")).alias("form_n")))
    last = roots(found.where(F.col("form").isNotNull()))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
