"""Hard-negative mining by Fagin's threshold algorithm.

Vectors are integers (floor(256 * x)), a row's score is its inner product with the anchor. The rows are dealt
into blocks; in each block every dimension has a list of the rows sorted by their component. For an anchor, sorted access
goes down all lists at once, from the largest component where the anchor's is positive and from the smallest elsewhere;
every row met is scored exactly by random access. The threshold, the anchor's product with the components last
met, bounds the score of every row not met yet. Access stops once it is strictly below the kth score of every window
that is sought, or below the window where fewer than k rows are found.

Two passes: the first finds each anchor's positives, the best rows of its label, in one window without ends; the second finds the
negatives, rows of other labels, in a window of scores for each positive. Anchor blocks meet row blocks in a grid
(``vectors``); each meeting returns at most k rows a window, merged by rank.

Defined results: rows with a null label, null vector or a null or non-finite component take no part; vectors of
another length than the anchor's are neither its positives nor its negatives. Ties go to the smaller id, a null id comes last
and is no anchor. Rows equal in id, label and vector count once; other rows that repeat an id are rows of their own, and none is
a positive of an anchor of its own id. A positive with a negative score has no negatives, one with score 0 those of
score 0; an anchor without positives gives no rows, nor does an empty table; other columns are not read. Scores
beyond 64 bits raise OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import BLOCK_BYTES, QUERY_BYTES, by_length, grid, integer_vectors, matrix, scoring_type, sorted_by_id

#: Depth of the first steps of sorted access; later steps double.
DEPTH = 16
#: Window of a negative's score, in hundredths of the positive's.
LEAST, MOST = 30, 90

POSITIVES = "anchor_id bigint, key string, positive_id bigint, positive_score bigint"
NEGATIVES = "anchor_id bigint, key string, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


class Lists:
    """The sorted candidate lists of a block's rows, one a dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, 0)

    def best(self, anchor: np.ndarray, eligible: np.ndarray, windows: list[tuple], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, most score; None: no end) the k best eligible rows, as (row, score); of equal scores
        the row that comes first."""
        n = len(self.x)
        falling = anchor > 0
        met, rows, scores = np.zeros(n, bool), np.empty(0, np.int64), np.empty(0, self.x.dtype)
        depth, step = 0, DEPTH
        while depth < n:
            to = min(n, depth + step)
            now = np.zeros(n, bool)
            now[self.order[n - to:n - depth, falling]] = True
            now[self.order[depth:to, ~falling]] = True
            now &= ~met
            met |= now
            new = np.flatnonzero(now & eligible)
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.x[new] @ anchor])
            last = np.where(falling, self.values[n - to], self.values[to - 1])
            if all(self.certain(scores, last @ anchor, w, k) for w in windows):
                break
            depth, step = to, 2 * step
        if not self.x.shape[1]:  # no dimension, no lists: every score is 0
            rows = np.flatnonzero(eligible)
            scores = np.zeros(len(rows), self.x.dtype)
        out = []
        for w in windows:
            at = np.flatnonzero(inside(scores, w))
            at = at[np.lexsort((rows[at], -scores[at]))[:k]]
            out.append([(int(r), int(s)) for r, s in zip(rows[at], scores[at], strict=True)])
        return out

    @staticmethod
    def certain(scores: np.ndarray, threshold: float, window: tuple, k: int) -> bool:
        """Whether no row beyond the threshold can be among the window's k best."""
        least, most = window
        if least is not None and (least > most or threshold < least):
            return True
        found = scores[inside(scores, window)]
        return len(found) >= k and threshold < np.partition(found, len(found) - k)[len(found) - k]


def inside(scores: np.ndarray, window: tuple) -> np.ndarray:
    least, most = window
    return np.ones(len(scores), bool) if least is None else (scores >= least) & (scores <= most)


def score_window(positive: int) -> tuple[int, int]:
    """The integer scores s with LEAST * positive <= 100 * s <= MOST * positive."""
    return -(-LEAST * positive // 100), MOST * positive // 100


def mined(rows: pa.Table, anchors: pa.Table, windows: list[list[tuple]], same: bool, k: int) -> list[list[list[tuple]]]:
    """For each anchor (id, label, vec) and each of its windows the k best rows (id, label, vec) of its own label, or of others,
    as (id, score)."""
    rows = sorted_by_id(rows)
    ids = rows.column("id").to_pylist()
    names = np.array([-1 if x is None else x for x in ids], np.int64)
    null = np.array([x is None for x in ids], bool)
    labels = np.array(rows.column("label").to_pylist())
    asked_ids, asked_labels = anchors.column("id").to_pylist(), anchors.column("label").to_pylist()
    have = by_length(rows)
    out: list = [[[] for _ in w] for w in windows]
    for length, at in by_length(anchors).items():
        if length not in have:
            continue
        here = have[length]
        x, a = matrix(rows, here, length), matrix(anchors, at, length)
        kind = scoring_type(x, a)
        lists = Lists(x.astype(kind))
        for anchor, i in zip(a.astype(kind), at, strict=True):
            if same:
                eligible = (labels[here] == asked_labels[i]) & (null[here] | (names[here] != asked_ids[i]))
            else:
                eligible = labels[here] != asked_labels[i]
            out[i] = [[(ids[here[r]], s) for r, s in found] for found in lists.best(anchor, eligible, windows[i], k)]
    return out


def find_positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    import pyarrow as pa
    found = mined(rows, anchors, [[(None, None)]] * anchors.num_rows, True, k)
    keys = zip(anchors.column("id").to_pylist(), anchors.column("key").to_pylist(), found, strict=True)
    out = [(i, key, p, s) for i, key, [best] in keys for p, s in best]
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({"anchor_id": pa.array(cols[0], pa.int64()), "key": pa.array(cols[1], pa.string()),
                     "positive_id": pa.array(cols[2], pa.int64()), "positive_score": pa.array(cols[3], pa.int64())})


def find_negatives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    import pyarrow as pa
    positives = anchors.column("positives").to_pylist()
    windows = [[score_window(p["score"]) for p in ps] for ps in positives]
    found = mined(rows, anchors, windows, False, k)
    out = []
    for i, key, ps, best in zip(anchors.column("id").to_pylist(), anchors.column("key").to_pylist(), positives, found, strict=True):
        out += [(i, key, p["place"], p["id"], p["score"], r, s) for p, one in zip(ps, best, strict=True) for r, s in one]
    cols = list(zip(*out, strict=True)) or [()] * 7
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in NEGATIVES.split(", ")]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})


def hard_negatives(df: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, vec_id: str = "vec_id",
                   vector: str = "embedding", label: str = "label", block_bytes: int = BLOCK_BYTES,
                   query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For every row for which ``is_anchor`` (a condition on the column ``id``) holds and each of its positives: the best
    negatives, as anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score."""
    whole = df.where(F.col(label).isNotNull())
    rows = stored(integer_vectors(whole, vector, id=F.col(vec_id).cast("bigint"), label=F.col(label).cast("bigint")))
    key = F.concat_ws(":", F.col("label").cast("string"), F.md5("vec"))
    anchors = rows.where(F.col("id").isNotNull() & is_anchor).select("id", "label", "vec", key.alias("key"))
    found = grid(rows, anchors, lambda r, a: find_positives(r, a, n_positives), POSITIVES, block_bytes, query_bytes)
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    sets = best.groupBy("anchor_id", "key").agg(F.array_sort(F.collect_list(F.struct(
        "place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    sets = sets.withColumnsRenamed({"anchor_id": "id"})
    asked = stored(anchors.join(sets, ["id", "key"]))
    found = grid(rows, asked, lambda r, a: find_negatives(r, a, n_negatives), NEGATIVES, block_bytes, query_bytes)
    order = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
