"""The searches over words and vectors against brute force: spelling variants, exact top-k, hard negatives."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hard_negatives, spelling, topk_search, vectors
from quarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def collected(df):
    return [tuple(r) for r in df.collect()]


# --- spelling variants ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(6, 8))) for _ in range(60)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rnd.randint(0, 120)):
            w = rnd.choice(stems)
            p, kind = rnd.randrange(len(w)), rnd.random()
            if kind < 0.15:
                w = w[:p] + rnd.choice("abcÿ") + w[p + (kind < 0.08):]
            elif kind < 0.2:
                w = w[:p] + w[p + 1:]
            words.append(w.upper() if rnd.random() < 0.2 else w)
        rows.append((i, rnd.choice([" ", "-", "1"]).join(words)))
    chain = "kettles " * 5 + "kettled " * 25 + "kettlex " * 125 + "kettlexy " * 625  # forms two and three steps away
    long = "x" * 5000
    rows += [(200, chain), (201, None), (202, ""), (203, "12 --"), (None, "abcdef " * 40), (204, f"{long} {long}y " * 6),
             (205, "É" * 7 + " é" + "É" * 6)]
    return rows + [rows[0], rows[0], (204, f"{long} {long}y " * 6)]


def test_spelling_variants(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id bigint, text string, word string, n bigint")
    want = brute.spelling_variants(brute.spelling_words(texts))
    assert any(root not in (w, form) for w, (form, root, *_) in want.items()) and any(len(w) > 4000 for w in want)
    for block in (spelling.BLOCK_WORDS, 20):  # one block a length, and several
        got = collected(spelling.variants(docs, block_words=block).select("word", "form", "root", "n", "n_near", "form_n"))
        assert len(got) == len(want) and {w: tuple(r) for w, *r in got} == want


def test_blocks_of_words_are_split_and_meet(spark):
    """More words of a length than a block holds: every pair of blocks meets once."""
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(6, 7))): rnd.randint(5, 400) for _ in range(700)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {w: tuple(r) for w, *r in collected(spelling.near_words(df, block_words=64))}
    for w in words:
        near = [v for v in words if brute.one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        assert got.get(w) == (None if best is None else (len(near), best, words[best]))


def test_bit_sliced_index_takes_every_kind_of_error():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abc") for _ in range(5)) for _ in range(130)]
    alphabet = np.array([ord(c) for c in "abcd"], "<u4")
    index = spelling.Index(spelling.letter_numbers(words, alphabet), 4)
    for n in (4, 5, 6):
        asked = ["".join(rnd.choice("abcd") for _ in range(n)) for _ in range(40)]
        bits = index.one_error(spelling.letter_numbers(asked, alphabet))
        for q, row in zip(asked, bits):
            found = np.unpackbits(row.view(np.uint8), bitorder="little").nonzero()[0].tolist()
            assert found == [i for i, w in enumerate(words) if brute.one_edit(w, q)]


def test_roots_follow_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(23)] + [(f"v{i}", "w3") for i in range(30)]
    got = dict(collected(spelling.roots(spark.createDataFrame(links, "word string, form string"))))
    assert got == {w: "w23" for w, _ in links}


def test_spelling_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(docs).count() == 0


# --- vectors -------------------------------------------------------------------------------------------------------

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, score double, block int"


def vector_rows(seed, n, dims=6, spread=40):
    """Small integers in 1/256, so that scores tie; nulls, odd values, repeated rows and ids, hot copies."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rnd.randint(-spread, spread) / 256 for _ in range(dims)]
        if i % 3 == 0:
            v = [1 / 256] * (dims - 1) + [i % 2 / 256]  # a third are copies
        rows.append((i, v, rnd.randint(0, 3)))
    inf, nan = float("inf"), float("nan")
    rows += [(n, None, 1), (n + 50, [1.0] * (dims - 1) + [nan], 1), (n + 100, [inf] * dims, 2), (100 * n, [0.1, None, *[0.2] * (dims - 2)], 1),
             (200 * n, [0.5] * dims, None), (None, [0.3] * dims, 1), (None, [0.3] * dims, 2), (300 * n, [0.25] * (dims + 1), 1),
             (300 * n + 1, [0.5] * (dims + 1), 1), (300 * n + 3, [0.5] * (dims + 1), 2), (400 * n, [], 1), (400 * n + 1, [], 1), (400 * n + 2, [], 2),
             (500 * n, [0.0] * dims, 1), (500 * n, [0.2] * dims, 1), (-100, [-0.1] * dims, 0)]
    return rows + [rows[0], rows[0], rows[5], (100, rows[4][1], 1)]


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 0.5, 7) for i, v, lab in rows], SCHEMA)


@pytest.mark.parametrize("block, queries, cells", [(1 << 21, 1 << 23, 64), (2000, 400, 4), (1500, 1500, 1)])
def test_top_k(spark, block, queries, cells):
    rows = vector_rows(1, 240)
    df = vector_table(spark, rows)
    got = topk_search.top_k(df, F.col("id") % 50 == 0, 5, cells=cells, block_bytes=block, query_bytes=queries)
    whole = {(i, brute.integer_vector(v)) for i, v, _ in rows if brute.integer_vector(v) is not None}
    want = []
    for i, v in whole:
        if i is not None and i % 50 == 0:
            want += [(i, r, c, s) for r, (c, s) in enumerate(brute.best_rows(whole, v, i, 5), 1)]
    assert sorted(collected(got), key=str) == sorted(want, key=str) and len(want) > 40


def test_bounds_hold_and_stop_the_reading():
    rng = np.random.default_rng(2)
    x = rng.integers(-150, 150, (500, 16))
    edges = topk_search.cell_edges(x, 8)
    cells, dims = topk_search.approximations(x, edges).astype(int), np.arange(16)
    low, high = edges[cells, dims], edges[cells + 1, dims] - 1
    assert (low <= x).all() and (x <= high).all()
    q = rng.integers(-150, 150, 16)
    bounds = (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(float)
    assert (bounds >= x @ q).all()

    class Read(np.ndarray):
        count = 0

        def __getitem__(self, at):
            Read.count += len(at)
            return np.asarray(self)[at]
    rows, scores = topk_search.in_bound_order(bounds, x.view(Read), q, 5)
    order = np.lexsort((np.arange(500), -(x @ q)))[:5]
    assert rows.tolist() == order.tolist() and 20 <= Read.count < 400


def test_scores_are_exact_beyond_doubles(spark):
    big = float(1 << 22)
    rows = [(0, [big + 1, 1.0, big], 1), (1, [big, 1 / 256, big], 1), (2, [big, 2 / 256, big], 1)]
    got = collected(topk_search.top_k(vector_table(spark, rows), F.col("id") == 0, 2))
    v = [brute.integer_vector(r[1]) for r in rows]
    assert got == [(0, 1, 2, sum(a * b for a, b in zip(v[0], v[2]))), (0, 2, 1, sum(a * b for a, b in zip(v[0], v[1])))]
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(vector_table(spark, [(0, [1e30], 1), (1, [1.0], 1)]), F.col("id") == 0, 2).collect()


@pytest.mark.parametrize("block, queries", [(1 << 21, 1 << 23), (1500, 200)])
def test_hard_negatives(spark, block, queries):
    rows = vector_rows(4, 300, spread=60)
    got = hard_negatives.hard_negatives(vector_table(spark, rows), F.col("id") % 20 == 0, 5, 10, block_bytes=block, query_bytes=queries)
    want = brute.negatives(rows, lambda i: i % 20 == 0, 5, 10)
    assert sorted(collected(got), key=str) == sorted(want, key=str) and len(want) > 100


def test_threshold_algorithm_stops_early():
    """Where scores are spread, sorted access ends before the lists do, and the result is still the best."""
    rng = np.random.default_rng(7)
    x = np.sort(rng.integers(0, 1000, (4000, 2)), axis=0)  # components that agree
    lists, anchor = hard_negatives.Lists(x), np.array([3, 2])
    asked = []
    lists.certain = lambda *a: asked.append(a[1]) or hard_negatives.Lists.certain(*a)
    [found] = lists.best(anchor, np.ones(4000, bool), [(None, None)], 5)
    scores = x @ anchor
    assert found == [(int(r), int(scores[r])) for r in np.lexsort((np.arange(4000), -scores))[:5]]
    assert len(asked) < 4 and asked == sorted(asked, reverse=True)


def test_vectors_of_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk_search.top_k(empty, F.col("id") % 50 == 0).count() == 0
    assert hard_negatives.hard_negatives(empty, F.col("id") % 100 == 0).count() == 0
    assert vectors.integer_vectors(empty, id=F.col("vec_id")).columns == ["id", "vec"]


def test_registered_queries(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    whole = {(i, brute.integer_vector(v)) for i, v, _ in table}
    want = [(i, r, c, s) for i, v in whole if i % 50 == 0 for r, (c, s) in enumerate(brute.best_rows(whole, v, i, 5), 1)]
    got = QUERIES["op12_topk_search"](spark, SF)
    assert [f"{n} {t}" for n, t in got.dtypes] == ["query_id bigint", "rank int", "vec_id bigint", "score bigint"]
    assert sorted(collected(got)) == sorted(want)
    flipped = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in table]
    got = QUERIES["op13_hard_negatives"](spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(collected(got)) == sorted(brute.negatives(flipped, lambda i: i % 100 == 0, 5, 10))
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_spelling_variants"](spark, SF)
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "bigint", "bigint", "bigint"]
    assert {w: tuple(r) for w, *r in collected(got)} == brute.spelling_variants(brute.spelling_words(docs))
