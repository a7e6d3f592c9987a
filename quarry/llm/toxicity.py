"""Toxicity scores from a lexicon, matched with spelling errors, and the context of each hit.

The lexicon is a trie of terms. Every distinct word of a worker's texts walks it as a Levenshtein
automaton, whose states (places in the trie with the edits made so far) are made once and kept. Long terms
allow two edits, middle ones one, short ones none; a term may also be a stem, which any word that begins
with it meets. A hit counts by its context window: quotation marks around it or reporting words near it speak
for quotation, direct address for abuse, and hits that lean to quotation are counted apart.

Terms: a fixed seed list and words or stems that a bounded sample of labelled rows shows to be
tied to toxic texts. Seeds and learned words with few clean uses are matched with as many edits as the sample allows:
other words that near a term must have few clean uses too. A logistic model over the logarithms of the hit counts (strong terms, weak terms, quoted,
misspelled) is fitted on the same sample. Bounds: ``FIT_ROWS`` labelled rows (those whose ids hash lowest) and
``MAX_TERMS`` terms; the whole of ``labels`` is never joined to the texts. Everything else reads all
rows. Rows with crc32(doc_id as text) mod 5 = 0 are held out: their labels are never read.

Defined results: a null text is empty; an empty text gets the model's score for no hit; a null id is
held out; repeated label rows count once, as toxic if one of them is; null labels are left out; with no usable
label the seed list and fixed weights score alone; rows that repeat an id are scored row by row; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, unused

#: Labelled rows that the lexicon and the weights are fitted on, and terms learned, at most.
FIT_ROWS = 8000
MAX_TERMS = 400
#: A learned term needs this many toxic texts, this share of toxic ones, this log-likelihood ratio.
MIN_TOXIC, MIN_SHARE, MIN_G2 = 5, 0.6, 20.0
STEMS = (5, 6, 7)
#: Share of clean uses that a strong term, and its misspellings in the sample, may have.
CLEAN_SHARE = 0.02
CONTEXT = 6
#: What a worker remembers, at most: bytes of words met (with what an entry takes besides), places in automaton states.
REMEMBER_BYTES, ENTRY_BYTES = 24 << 20, 120
PLACES = 100_000

#: Insults that score without any label.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown",
         "imbecile", "bastard", "asshole", "retard", "vermin")
#: Words that report speech, and words that address someone.
REPORTING = frozenset("said says say saying called calls wrote writes quote quoted quotes word term slur phrase".split())
ADDRESS = frozenset("you your youre you're yourself u ur are".split())
OPENING, CLOSING = "\"'“”«‘„‹(", "\"'“”»’›)"

#: Weights without labels: intercept, strong, weak, quoted, misspelled.
PRIOR_WEIGHTS = (-2.5, 3.0, 1.5, 0.0, 0.0)
FEATURES = ("strong", "weak", "quoted", "misspelled")
#: Punctuation at a word's edges.
EDGES = ".,;:!?\"'“”‘’«»„‹›()[]{}<>*#$%&|-_/"
_PART = re.compile(r"[^\W_]+")


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    number: int = 0
    word: int = -1
    stem: int = -1
    bound: int = 0


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Term(NamedTuple):
    text: str
    stem: bool
    strong: bool
    fuzzy: bool
    most: int = 2

    @property
    def edits(self) -> int:
        return min(self.most, allowed_edits(self.text)) if self.fuzzy and not self.stem else 0


class Lexicon:
    """Trie of the terms, walked by a word's characters as a Levenshtein automaton.

    A place is (trie node, edits so far); a character moves along its edge, or for one edit along any edge
    (another letter) or not at all (a letter too many); an edge may be skipped for one edit (a letter left out). A
    state is the set of places reachable; it and its moves are made when first met and kept, up to ``PLACES`` in all."""

    def __init__(self, terms: list[Term]):
        self.terms, self.nodes = terms, [Node()]
        for i, t in enumerate(terms):
            node, bound = self.nodes[0], t.edits
            node.bound = max(node.bound, bound)
            for ch in t.text:
                if ch not in node.next:
                    node.next[ch] = Node(number=len(self.nodes))
                    self.nodes.append(node.next[ch])
                node = node.next[ch]
                node.bound = max(node.bound, bound)
            if t.stem:
                node.stem = i
            else:
                node.word = i
        self.reset()

    def reset(self) -> None:
        self.moves: dict[frozenset, dict] = {}
        self.held = 0
        self.start = self.state({(0, 0)})

    def state(self, places: set[tuple[int, int]]) -> dict:
        """The moves of a state, with what it accepts under key None: (edits, term), and under 0 a stem met in it."""
        todo, every = list(places), set(places)
        while todo:  # letters left out
            at, edits = todo.pop()
            for child in self.nodes[at].next.values():
                if edits < child.bound and (child.number, edits + 1) not in every:
                    every.add((child.number, edits + 1))
                    todo.append((child.number, edits + 1))
        key = frozenset(every)
        got = self.moves.get(key)
        if got is None:
            words = [(e, w) for at, e in every if (w := self.nodes[at].word) >= 0 and e <= self.limit(w)]
            stems = [(0, w) for at, e in every if (w := self.nodes[at].stem) >= 0 and not e]
            self.held += 4 + len(key)
            got = self.moves[key] = {None: min(words, default=None), 0: min(stems, default=None), 1: key}
        return got

    def limit(self, word: int) -> int:
        return self.terms[word].edits

    def step(self, state: dict, ch: str) -> dict:
        places = set()
        for at, edits in state[1]:
            node = self.nodes[at]
            if ch in node.next:
                child = node.next[ch]
                if edits <= child.bound:
                    places.add((child.number, edits))
            if edits < node.bound:
                places.add((at, edits + 1))
            for child in node.next.values():
                if edits < child.bound:
                    places.add((child.number, edits + 1))
        state[ch] = new = self.state(places)
        return new

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its bound, or a stem; the first listed of equals."""
        if self.held > PLACES:
            self.reset()
        state, stem = self.start, None
        for ch in word:
            new = state.get(ch)
            state = self.step(state, ch) if new is None else new
            if state[0] is not None and stem is None:
                stem = state[0]
            if not state[1]:
                return stem
        found = state[None]
        return min(found, stem) if found and stem else found or stem

    def near(self, word: str) -> dict[int, int]:
        """Every term within its bound, with its edits; none if the word is a term or begins with a stem."""
        got = self.match(word)
        if got is None or not got[0]:
            return {}
        state, out = self.start, {}
        for ch in word:
            state = state.get(ch) or self.step(state, ch)
        for at, edits in state[1]:
            if (w := self.nodes[at].word) >= 0 and edits <= self.limit(w):
                out[w] = min(edits, out.get(w, edits))
        return out


class Scanner:
    """Counts hits within a worker; remembers the words that it has met."""

    def __init__(self, terms: list[Term]):
        self.lexicon, self.clean, self.hits, self.held = Lexicon(terms), set(), {}, 0

    def word(self, token: str) -> tuple[int, int] | None:
        got = self.lexicon.match(token.strip(EDGES))
        if got is None and not token.isalnum():
            found = [m for part in _PART.findall(token) if (m := self.lexicon.match(part))]
            got = min(found, default=None)
        return got

    def scan(self, text: str) -> tuple[int, int, int, int]:
        """Hits: strong, weak, quoted, and how many of the first two are misspelled."""
        words = text.lower().split()
        distinct = set(words)
        for token in distinct - self.clean - self.hits.keys():
            self.held += ENTRY_BYTES + 2 * len(token)
            got = self.word(token)
            if got:
                self.hits[token] = got
            else:
                self.clean.add(token)
        counts = [0, 0, 0, 0]
        if distinct & self.hits.keys():
            for i, token in enumerate(words):
                got = self.hits.get(token)
                if got:
                    edits, term = got
                    if self.quoted(words, i):
                        counts[2] += 1
                    else:
                        counts[0 if self.lexicon.terms[term].strong else 1] += 1
                        counts[3] += edits > 0
        if self.held > REMEMBER_BYTES:
            self.clean, self.hits, self.held = set(), {}, 0
        return tuple(counts)

    def quoted(self, words: list[str], i: int) -> bool:
        """The context window's score: quotation marks that open before and close after the hit and reporting
        words against words of address. Positive: quotation."""
        window = words[max(0, i - CONTEXT): i + CONTEXT + 1]
        at = min(i, CONTEXT)
        opens = any(w[0] in OPENING for w in window[: at + 1])
        closes = any(w.rstrip(".,;:!?")[-1:] in CLOSING and w.rstrip(".,;:!?") for w in window[at:])
        bare = {w.strip(".,;:!?\"“”«»()") for w in window}
        return 2 * (opens and closes) + bool(bare & REPORTING) - bool(bare & ADDRESS) > 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample_labels(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids that aren't held out: those whose ids hash lowest."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def learned_terms(sample: DataFrame) -> list[Term]:
    """Terms from (text, _toxic): words and word beginnings that toxic texts share."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = [F.transform(F.filter("w", lambda x, k=k: F.length(x) > k), lambda x, k=k: F.concat(F.substring(x, 1, k), F.lit("*")))
             for k in STEMS]
    rows = sample.select("_toxic", words.alias("w")).select("_toxic", F.explode(F.array_distinct(F.concat("w", *stems))).alias("t"))
    n, toxic = (int(x or 0) for x in sample.agg(F.count(F.lit(1)), F.sum("_toxic")).first())
    if not 0 < toxic < n:
        return []
    share = toxic / n
    counts = rows.groupBy("t").agg(F.sum("_toxic").alias("a"), F.count(F.lit(1)).alias("m")).where(
        (F.col("a") >= MIN_TOXIC) & (F.col("a") >= MIN_SHARE * F.col("m")))
    a, m = F.col("a"), F.col("m")
    g2 = 2 * (a * F.log(a / (m * share)) + F.when(m > a, (m - a) * F.log((m - a) / (m * (1 - share)))).otherwise(F.lit(0.0)))
    top = counts.withColumn("g2", g2).where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "t").limit(MAX_TERMS).collect()
    whole = [(r.t, r.a, r.m) for r in top if not r.t.endswith("*")]
    out, kept = [], []
    for r in top:
        if r.t.endswith("*"):
            stem = r.t[:-1]
            own = any(w.startswith(stem) and x >= 0.9 * r.a for w, x, _ in whole)
            if not own and not any(k.startswith(stem) or stem.startswith(k) for k in kept):
                kept.append(stem)
                out.append(Term(stem, True, r.m - r.a <= CLEAN_SHARE * r.m, False))
    # words that begin with a stem stay too: misspelled ones may not begin with it
    return out + [Term(w, False, m - a <= CLEAN_SHARE * m, m - a <= CLEAN_SHARE * m) for w, a, m in whole]


def bounded_terms(sample: DataFrame, terms: list[Term]) -> list[Term]:
    """The terms, each with the most edits at which its misspellings in (text, _toxic) are no common clean words: the
    other words that near it have at most ``CLEAN_SHARE`` clean uses among theirs and the term's."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    counts = sample.select("_toxic", F.explode(words).alias("t")).groupBy("t").agg(
        F.sum("_toxic").cast("bigint").alias("a"), F.count(F.lit(1)).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        lexicon, number = Lexicon(terms), {t.text: i for i, t in enumerate(terms) if not t.stem}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                near = {number[r["t"]]: 0} if r["t"] in number else lexicon.near(r["t"])
                rows += [{"term": i, "edits": e, "a": r["a"], "m": r["m"]} for i, e in near.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in ("term", "edits", "a", "m")]))

    near = counts.mapInArrow(run, "term bigint, edits bigint, a bigint, m bigint").groupBy("term", "edits").agg(
        F.sum("a").alias("a"), F.sum("m").alias("m")).collect()
    got = {(r.term, r.edits): (r.a, r.m) for r in near}
    out = []
    for i, t in enumerate(terms):
        uses, clean, most = got.get((i, 0), (0, 0))[1], 0, 0
        for edits in range(1, t.edits + 1):
            a, m = got.get((i, edits), (0, 0))
            uses, clean = uses + m, clean + m - a
            if clean > CLEAN_SHARE * uses:
                break
            most = edits
        out.append(t._replace(most=most) if most < t.edits else t)
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method; x: log hit counts. The ridge pulls to the prior weights."""
    prior = np.array(PRIOR_WEIGHTS)
    if not len(y) or y.min() == y.max():
        return prior.tolist()
    z = np.column_stack([np.ones(len(x)), x])
    w, penalty = prior.copy(), np.diag([0.01, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def hit_counts(df: DataFrame, terms: list[Term], text: str = "text", name: str = "_hits") -> DataFrame:
    """``df`` with a column ``name`` (array of the counts in ``FEATURES``); row by row."""
    source = unused(df, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        scanner = Scanner(terms)
        for batch in slices(batches, source):
            hits = [scanner.scan(t or "") for t in batch.column(source).to_pylist()]
            keep = [c for c in batch.schema.names if c != source]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(hits, pa.list_(pa.int64()))],
                                             names=[*keep, name])

    from pyspark.sql.types import ArrayType, LongType, StructField, StructType
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(LongType()))])
    return df.withColumn(source, F.col(text)).mapInArrow(run, schema)


@dataclass
class Model:
    terms: list[Term]
    weights: list[float]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from at most ``rows`` labelled texts. The sampled ids are small and bounded, so they
    are broadcast to the texts' scan; the sampled texts never come to the driver, only counts do."""
    ids = sample_labels(labels, rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("text")).join(
        F.broadcast(ids), "_id").select("_id", "_toxic", F.coalesce("text", F.lit("")).alias("text"))
    from .common import stored
    texts = stored(texts.repartition(16, "_id"))
    learned = learned_terms(texts)
    terms = [t for t in learned if t.text not in SEEDS] + [Term(s, False, True, True) for s in SEEDS]
    terms = bounded_terms(texts, terms)
    counted = hit_counts(texts, terms).groupBy("_hits", "_toxic").agg(F.count(F.lit(1)).alias("n"))
    got = counted.orderBy("_hits", "_toxic").limit(2 * rows).collect()
    x = np.log1p(np.array([r["_hits"] for r in got for _ in range(r["n"])], float).reshape(-1, len(FEATURES)))
    y = np.array([r["_toxic"] for r in got for _ in range(r["n"])], float)
    return Model(terms, fit_weights(x, y))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted``, in place of columns of these names; row by row, no shuffle."""
    hits = unused(df, "hits")
    z = F.lit(model.weights[0])
    for i, w in enumerate(model.weights[1:]):
        z = z + w * F.log1p(F.get(hits, F.lit(i)).cast("double"))
    out = hit_counts(df, model.terms, text, hits).drop("score", "predicted")
    out = out.withColumn("score", 1 / (1 + F.exp(-z))).drop(hits)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
