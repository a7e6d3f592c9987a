"""Corpus quality metrics: class entropy, sliding windows, n-gram perplexity, quality gate.

*Re-aimed*: part-of-speech tags become token classes (any categorical column works) and
the neural language model becomes a corpus bigram model with add-k smoothing, trained
and applied with aggregations and joins. Window assignment is arithmetic on token
positions, so no token is ever joined against a window table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text as FT
from ..session import stored

# Fixed values that must match the reference behaviour.
WINDOW_TOKENS = 512
WINDOW_STRIDE = 256
MAX_PERPLEXITY = 100.0       # planned gate: keep documents below this perplexity
MIN_ENTROPY = 1.3            # planned gate: keep documents above this class entropy
EXCLUDED_TITLES = ["黑潮与白露的歌剧", "终幕礼", "独眼小宝总动员"]


def class_entropy(df: DataFrame, doc: str, cls: str, out: str = "entropy") -> DataFrame:
    """Q1/Q2: Shannon entropy (natural log) of ``cls`` per ``doc``.

    ``H = ln T − Σ n·ln n / T`` with class counts ``n`` and total ``T``: two plain
    aggregations (partial on the map side), no window.
    """
    counts = df.groupBy(doc, cls).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return counts.groupBy(doc).agg(
        (F.log(F.sum("_n")) - F.sum(F.col("_n") * F.log("_n")) / F.sum("_n")).alias(out))


#: Bytes of text that a worker cuts into tokens at a time; a longer text is cut alone.
TOKEN_BYTES = 1 << 22
#: Of a byte of UTF-8: 1 in an ASCII word, 2 inside a character, else 0.
_BYTE_KIND = np.array([2 if b & 0xC0 == 0x80 else int(b < 128 and (chr(b).isalnum() or b == 95)) for b in range(256)], np.uint8)


def _cut_tokens(texts: pa.StringArray) -> pa.ListArray:
    """T4 tokens of each text: a token begins at every character but the later ones of an ASCII word. The tokens are the text's
    own bytes with other offsets; a null has none."""
    import pyarrow as pa
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    kind = _BYTE_KIND[data]
    begins = kind != 2
    begins[1:] &= (kind[1:] & kind[:-1]) != 1
    begins[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(begins)
    values = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends), pa.int32()), values)


def _token_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Keys and tokens (T4, as ``functions.text.tokens`` gives them) of batches ``(key, text)``, ``TOKEN_BYTES`` of text or one text at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, TOKEN_BYTES + (ends[lo - 1] if lo else 0), "right")))
            part = batch.slice(lo, hi - lo)
            yield part.column(0), _cut_tokens(part.column(1).cast(pa.string()))
            lo = hi


def _keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.col(text).cast("string").alias(text))


def token_lists(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, _t)``: the T4 tokens of each text, cut by bytes in Arrow batches: no expression match for each token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for keys, tokens in _token_parts(batches):
            yield pa.RecordBatch.from_arrays([keys, tokens], names=[key, "_t"])

    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("_t", ArrayType(StringType()))])
    return _keyed_texts(docs, key, text).mapInArrow(run, schema)


def token_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, cls)`` per token (T4 tokens, coarse classes)."""
    t = token_lists(docs, key, text).select(key, F.explode("_t").alias("tok"))
    return t.select(key, FT.token_class(F.col("tok")).alias("cls"))


def sliding_windows(docs: DataFrame, n_tokens: str = "n_tokens", key: str = "doc_id",
                    max_length: int = WINDOW_TOKENS, stride: int = WINDOW_STRIDE) -> DataFrame:
    """Q3: windows ``[start, end)`` of at most ``max_length`` tokens every ``stride`` tokens.

    A last short window is shifted back to full length; windows stop at the first that
    reaches the end.
    """
    n = F.col(n_tokens)
    d = docs.where(n > 0).select(key, n_tokens, F.explode(F.sequence(F.lit(0), n - 1, F.lit(stride))).alias("_b"))
    b = F.col("_b")
    e = F.least(b + max_length, n)
    d = d.where((b == 0) | (b - stride + max_length < n))
    return d.select(key, (b / stride).cast("int").alias("win_no"),
                    F.when(e - b < max_length, F.greatest(F.lit(0), e - max_length)).otherwise(b).alias("start"),
                    e.alias("end"))


#: A key with more than this share of a table's rows is heavy; there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 1e-4
#: The same for bigrams, so that a natural text's common ones are scored where they are read; at most 200,000.
HEAVY_BIGRAMS = 5e-6


def _numbered_bigrams(tokens: pa.ListArray) -> tuple:
    """Of the tokens of some texts: where each text ends, the number of each token's bigram with the one before it, and by number the
    bigram's first token (null: the token begins a text) and its second."""
    import pyarrow as pa
    ends = tokens.offsets.to_numpy()
    numbered = tokens.values.dictionary_encode()
    words, n_words = numbered.dictionary, max(1, len(numbered.dictionary))
    tok = numbered.indices.to_numpy().astype(np.int64)
    pair = tok.copy()
    pair[1:] += (tok[:-1] + 1) * n_words
    begins = ends[:-1][np.diff(ends) > 0]
    pair[begins] = tok[begins]
    numbered = pa.array(pair).dictionary_encode()
    first, second = np.divmod(numbered.dictionary.to_numpy(), n_words)
    return ends, numbered.indices.to_numpy(), words.take(pa.array(first - 1, mask=first == 0)), words.take(pa.array(second))


def count_bigrams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(prev, tok, c2)``: how often each token (T4) follows another; with ``prev`` null: how many texts begin with it. Counted within
    ``TOKEN_BYTES`` of text, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for _, tokens in _token_parts(batches):
            _, pairs, prev, tok = _numbered_bigrams(tokens)
            yield pa.RecordBatch.from_arrays([prev, tok, pa.array(np.bincount(pairs, minlength=len(tok)), pa.int64())], names=["prev", "tok", "n"])

    rows = _keyed_texts(docs, key, text).mapInArrow(run, "prev string, tok string, n long")
    return rows.groupBy("prev", "tok").agg(F.sum("n").alias("c2"))


def score_windows(docs: DataFrame, heavy: pa.Table, key: str = "doc_id", text: str = "text", max_length: int = WINDOW_TOKENS,
                  stride: int = WINDOW_STRIDE) -> DataFrame:
    """``(key, win_no, prev, tok, n, nll)``: of every window the number of its tokens whose bigrams are in ``heavy`` (``prev, tok, nll``,
    bounded) and the sum of their nll, with ``prev`` null; and a row, with ``nll`` null, for each of its other tokens.

    Token ``t`` (t ≥ 1) belongs to the window that is the first to score it: 0 when ``t < max_length`` and otherwise
    ``(t − max_length) div stride + 1``.
    """
    import pyarrow.compute as pc
    # two neighbouring tokens put together are cut into the same two again, so the joined text names the bigram
    joined = pc.binary_join_element_wise(heavy["prev"], heavy["tok"], "").combine_chunks()
    known_nll = np.append(heavy["nll"].to_numpy(), np.nan)
    names = [key, "win_no", "prev", "tok", "n", "nll"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc
        for keys, tokens in _token_parts(batches):
            ends, pairs, prev, tok = _numbered_bigrams(tokens)
            at = pc.index_in(pc.binary_join_element_wise(prev, tok, ""), value_set=joined).fill_null(len(joined)).to_numpy()
            doc = np.repeat(np.arange(len(keys)), np.diff(ends))
            pos = np.arange(len(pairs)) - ends[doc]
            win = np.where(pos < max_length, 0, (pos - max_length) // stride + 1).astype(np.int32)
            unit = np.cumsum((pos == 0) | (np.diff(win, prepend=0) != 0)) - 1  # number of the window, over all texts
            head = np.flatnonzero(np.diff(unit, prepend=-1))
            known = (at < len(joined))[pairs]
            n = np.bincount(unit[known], minlength=len(head))
            total = np.bincount(unit[known], weights=known_nll[at[pairs[known]]], minlength=len(head))
            some = n > 0
            head, none = head[some], pa.nulls(int(some.sum()), pa.string())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc[head])), pa.array(win[head]), none, none, pa.array(n[some], pa.int64()),
                                              pa.array(total[some], pa.float64())], names=names)
            rest = np.flatnonzero(~known & (pos > 0))
            yield pa.RecordBatch.from_arrays([
                keys.take(pa.array(doc[rest])), pa.array(win[rest]), prev.take(pa.array(pairs[rest])), tok.take(pa.array(pairs[rest])),
                pa.array(np.ones(len(rest), np.int64)), pa.nulls(len(rest), pa.float64())], names=names)

    schema = StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL(
        "win_no int, prev string, tok string, n long, nll double").fields])
    return _keyed_texts(docs, key, text).mapInArrow(run, schema)


def train_bigram_lm(counts: DataFrame) -> DataFrame:
    """Q4: the corpus bigram model of :func:`count_bigrams`: ``(prev, tok, c2, c1)``."""
    pairs = counts.where(F.col("prev").isNotNull())
    firsts = pairs.groupBy("prev").agg(F.sum("c2").alias("c1"), F.count(F.lit(1)).alias("_rows"))
    return split_join(pairs, firsts, ["prev"], "_rows").drop("_rows")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join of ``left`` to ``right``, which has one row a key and the number of the key's rows of ``left`` in ``rows``.
    Heavy keys are few by their definition: their rows of ``right`` are broadcast and their rows of ``left`` stay where they
    are; all others meet in a shuffle, in which no key is heavy."""
    total = right.agg(F.sum(rows).alias("n")).select(F.col("n") * HEAVY_SHARE).scalar()
    is_heavy = F.col(rows) > total
    heavy = F.broadcast(right.where(is_heavy))
    rest = left.join(F.broadcast(right.where(is_heavy).select(*keys)), keys, "left_anti")
    return left.join(heavy, keys).unionByName(rest.join(right.where(~is_heavy).hint("shuffle_hash"), keys))


def window_perplexity(docs: DataFrame, key: str = "doc_id", text: str = "text", k: float = 1.0,
                      max_length: int = WINDOW_TOKENS, stride: int = WINDOW_STRIDE) -> DataFrame:
    """Q4: perplexity of every window = exp(mean −ln p) over the tokens new to that window, with add-``k`` smoothing over the
    vocabulary. The counts are stored, and so is the model, which both are as large as the vocabulary of bigrams. Heavy bigrams
    (``HEAVY_BIGRAMS``) are few by their definition: their scores go to every task and are summed by window where the texts are
    read. The tokens of all others meet the model in a shuffle, in which no bigram is heavy."""
    counts = stored(count_bigrams(docs, key, text))
    model = stored(train_bigram_lm(counts))
    size = counts.agg(F.count_distinct("tok").cast("double").alias("v"), F.sum(F.when(F.col("prev").isNotNull(), F.col("c2"))).alias("n")).first()
    nll = -F.log((F.col("c2") + F.lit(k)) / (F.col("c1") + k * size["v"]))
    scores = model.select("prev", "tok", "c2", nll.alias("_nll"))
    is_heavy = F.col("c2") > (size["n"] or 0) * HEAVY_BIGRAMS
    heavy = scores.where(is_heavy).select("prev", "tok", F.col("_nll").alias("nll")).toArrow()
    parts = score_windows(docs, heavy, key, text, max_length, stride)
    # rows without a bigram find nothing; their window spreads them
    spread = F.when(F.col("prev").isNull(), F.concat_ws(":", F.col(key).cast("string"), "win_no")).otherwise(F.col("tok"))
    rest = scores.where(~is_heavy).select("prev", "tok", "_nll").hint("shuffle_hash")
    s = parts.withColumn("tok", spread).join(rest, ["prev", "tok"], "left")
    return s.groupBy(key, "win_no").agg(F.exp(F.sum(F.coalesce("nll", "_nll")) / F.sum("n")).alias("ppl"))


def doc_perplexity(windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Q5: mean of the window perplexities per document."""
    return windows.groupBy(key).agg(F.avg("ppl").alias("ppl"))


def quality_gate(scores: DataFrame, excluded: DataFrame | None = None, key: str = "doc_id",
                 max_ppl: float = MAX_PERPLEXITY, min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """Q6: drop the hard exclude list (anti join), then keep ``ppl < max`` and ``entropy > min``."""
    d = scores if excluded is None else scores.join(excluded.select(key).distinct(), key, "left_anti")
    return d.where((F.col("ppl") < max_ppl) & (F.col("entropy") > min_entropy))
