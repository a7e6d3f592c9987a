"""Chunker invariants, n-gram dedup against the written rules, token round trip."""

import random
import re

from pyspark.sql import functions as F

from quarry.functions import text as FT
from quarry.operators import chunk as K
from quarry.operators import text as T


def _norm(s):
    return "".join(s.split())


def test_pack_respects_budget_and_keeps_text(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    docs = []
    for d in range(30):
        blocks = []
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            if kind < 0.2:
                blocks.append("#" * rng.randint(1, 3) + " " + rng.choice(words))
            elif kind < 0.35:
                blocks.append("\n".join(f"* {rng.choice(words)} {rng.choice(words)}" for _ in range(rng.randint(1, 6))))
            else:
                blocks.append(" ".join(rng.choice(words) + rng.choice([".", "", "。"]) for _ in range(rng.randint(3, 60))))
        docs.append((d, "\n\n".join(blocks)))
    df = spark.createDataFrame(docs, "doc_id INT, text STRING")
    out = K.chunk_documents(df, chunk_size=120).collect()
    by_doc = {}
    for r in out:
        assert r.n_tokens <= 120 or r.oversize
        by_doc.setdefault(r.doc_id, []).append((r.chunk_no, r.text))
    for d, text in docs:
        # the input (without heading marks) is a subsequence of the chunks: nothing is lost or
        # reordered; headings may repeat at chunk starts
        got = _norm("".join(t for _, t in sorted(by_doc[d]))).replace("#", "")
        want = _norm(text).replace("#", "")
        it = iter(got)
        assert all(ch in it for ch in want)


def test_heading_path(spark):
    md = "# A\n\npara\n\n## B\n\n### C\n\n## D\n\ntext\n\n# E\n\nx"
    df = spark.createDataFrame([(1, md)], "doc_id INT, text STRING")
    b = K.heading_path(K.markdown_blocks(df)).orderBy("block_no").collect()
    assert [r.headings for r in b] == [[0], [0], [0, 2], [0, 2, 3], [0, 4], [0, 4], [6], [6]]


def test_table_helpers(spark):
    df = spark.createDataFrame([("| h1 | h2 |", "| a | bb |", 28)], "h STRING, r STRING, n INT")
    r = df.select(K.row_cost(K.table_cells(F.col("r"))).alias("c"),
                  K.table_to_kv(K.table_cells(F.col("h")), K.table_cells(F.col("r"))).alias("kv"),
                  K.synth_header(F.col("n")).alias("hdr"), K.squeeze_table(F.lit("|  a  | --- |")).alias("sq")).collect()[0]
    assert r.c == 2 + (1 + 2) + (2 + 2) - 1
    assert r.kv == "h1: a\th2: bb"
    assert r.hdr[:3] == ["C_A", "C_B", "C_C"] and r.hdr[26:28] == ["C_AA", "C_AB"]
    assert r.sq == "| a | - |"


def test_split_table_repeats_header():
    t = "| h | v |\n| - | - |\n" + "\n".join(f"| r{i} | {i} |" for i in range(10))
    parts = K.split_table(t, 40, 1000)
    assert len(parts) == 2 and all(p[1].startswith("| h | v |\n| - | - |") for p in parts)


def test_dedup_pass_rules():
    toks = list("ab") + [" ", "x", "y", " ", "x", "y", " ", "x", "y"]
    assert "".join(T.dedup_pass(toks, 3)) == "ab xy"
    # grams with digits are copied
    toks = ["1", " ", "1", " ", "1", " "]
    assert T.dedup_pass(toks, 2) == toks
    # repeated single spaces collapse
    assert T.dedup_pass(["a", " ", " ", " ", "b"], 1) == ["a", " ", "b"]


def test_tokens_lossless(spark):
    df = spark.createDataFrame([("中文 words, 1.5\n\nx",)], "t STRING")
    r = df.select(FT.tokens(F.col("t")).alias("k")).collect()[0].k
    assert "".join(r) == "中文 words, 1.5\n\nx" and r[:2] == ["中", "文"]


def removed_repeats(tokens, n):
    """The rule of T1, stated by which tokens are dropped: at each place the next n tokens either repeat the n
    kept last (all dropped), or are a space after a space (one dropped), or one token is kept."""
    kept, rest = tokens[:n], tokens[n:]
    while rest:
        gram = "".join(rest[:n])
        plain = not re.search(r"[0-9\[\](){}|\n]", gram)
        repeat = plain and gram == "".join(kept[-n:])
        blank = plain and not repeat and kept[-1:] == [" "] == rest[:1]
        if not repeat and not blank:
            kept = kept + rest[:1]
        rest = rest[n if repeat else 1:]
    return kept


def test_fast_dedup_equals_plain_statement():
    rng = random.Random(1)
    alpha = ["a", "b", "c", " ", "1", "[", "\n", "中", "ab"]
    for _ in range(2000):
        toks = [rng.choice(alpha) for _ in range(rng.randint(0, 40))]
        ref = toks
        for n in range(10, 2, -1):
            assert T.dedup_pass(ref, n) == removed_repeats(ref, n)
            ref = removed_repeats(ref, n)
        assert T.dedup_tokens(toks) == ref


def test_numbered_dedup_equals_plain_statement(spark, monkeypatch):
    import pyarrow as pa
    rng = random.Random(5)
    texts = []
    for _ in range(3000):
        alpha = rng.sample(["a", "b", "ab", " ", " ", "  ", "1", "\u00b2", "[", "\n", "\u4e2d", ".", "\u00e9"], rng.randint(2, 6))
        texts.append("".join(rng.choice(alpha) * rng.choice([1, 1, 2, 5]) for _ in range(rng.randint(0, 40))))
    toks = [re.findall(r"[\u4e00-\u9fff]|[A-Za-z0-9_]+|.", x, re.S) for x in texts]
    odd = [["a", "b", "a", "b"] * 3, ["a b", "c", "a", " b", "c"], None, []]
    calls = []
    plain = T.dedup_tokens
    monkeypatch.setattr(T, "dedup_tokens", lambda *a: calls.append(a) or plain(*a))
    for chunk in (1 << 18, 50):
        monkeypatch.setattr(T, "CHUNK_TOKENS", chunk)
        for min_n, max_n in ((3, 10), (1, 4), (3, 3)):
            want = [None if x is None else "".join(plain(x, min_n, max_n)) for x in toks + odd]
            calls.clear()
            assert T._dedup_udf(min_n, max_n).func(pa.array(toks + odd)).to_pylist() == want
            assert len(calls) == 2  # only the texts whose tokens don't read alike when joined


def test_tokens_round_trip_random_unicode(spark):
    rng = random.Random(8)
    alphabet = list("ab Z_09\n\t.,!?[](){}|'\"") + ["中", "文", "é", "ß", "😀", "　", "\r"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {r.i: r.k for r in df.select("i", FT.tokens(F.col("t")).alias("k")).collect()}
    for i, t in enumerate(texts):
        assert "".join(got[i]) == t
        assert all(tok for tok in got[i])


BLOCK_CASES = [
    ("# T\nbody\n- item", ["heading:# T", "paragraph:body", "list:- item"]),
    ("```\na\n\n# b\n```\nx", ["code:```\na\n\n# b\n```", "paragraph:x"]),
    ("* a\n\n* b", ["list:* a\n\n* b"]),
    ("- a\n  * deep\n\n  more\nlazy\n\nnew\n1. x\n2) y", ["list:- a\n  * deep\n\n  more\nlazy", "paragraph:new", "list:1. x", "list:2) y"]),
    ("p\n| a | b |\n|---|:-:|\n| 1 | 2 |\nend", ["paragraph:p", "table:| a | b |\n|-|:-:|\n| 1 | 2 |", "paragraph:end"]),
    ("a | b\nno delimiter", ["paragraph:a | b\nno delimiter"]),
    ("T\n===\ntext\n---", ["setext:T\n===", "setext:text\n---"]),
    ("a\n***\nb\n\n---\n- - -", ["paragraph:a", "paragraph:b"]),
    ("<div>\nx\n\ny\n<!-- a\n\nb --> t\nz", ["html:<div>\nx", "paragraph:y", "html:<!-- a\n\nb --> t", "paragraph:z"]),
    ("<script>\n\nx</script>\np <b>x</b>\n<b>\nq\n\n<b>\nr", ["html:<script>\n\nx</script>", "paragraph:p <b>x</b>\n<b>\nq", "html:<b>\nr"]),
    ("> q\nlazy\n\n    code\n\n    more\nend", ["quote:> q\nlazy", "code:    code\n\n    more", "paragraph:end"]),
    ("~~~~\n~~~\n```\n~~~~~\nz\n````x`\n```y", ["code:~~~~\n~~~\n```\n~~~~~", "paragraph:z\n````x`", "code:```y"]),
    ("text\n2. not a list\n-", ["setext:text\n2. not a list\n-"]), ("", []), (" \n\t\n", []), (None, [])]


def test_block_grammar(spark, monkeypatch):
    from quarry.operators import blocks
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BLOCK_CASES)], "doc_id int, text string")
    for piece in (256, 2):  # scanned as one piece, and as many
        monkeypatch.setattr(blocks, "PIECE", piece)
        rows = K.markdown_blocks(df, first_line_title=False).orderBy("doc_id", "block_no").collect()
        for i, (_, want) in enumerate(BLOCK_CASES):
            assert [f"{r.kind}:{r.block}" for r in rows if r.doc_id == i] == want
    titles = K.markdown_blocks(df).where("block_no = 0").orderBy("doc_id").collect()
    assert (titles[0].level, titles[5].kind, titles[5].level, titles[5].block) == (1, "heading", 1, "# a | b\nno delimiter")


def test_block_maps_compose(spark):
    """A piece's map from every state is the walk from that state, whatever the cuts."""
    import random

    from quarry.operators import blocks
    rng = random.Random(2)
    pool = [p for t, _ in BLOCK_CASES if t for p in t.split("\n")] + ["", "", "plain"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = []
    for piece in (1, 7, 256):
        blocks.PIECE = piece
        try:
            found.append(df.select("text", blocks.typed_blocks(F.col("text")).alias("b")).collect())
        finally:
            blocks.PIECE = 256
    assert found[0] == found[1] == found[2]
    for r in found[0]:  # no line that isn't blank is lost, none is doubled
        assert [x for x in r.text.split("\n") if x.strip()] == [x for b in r.b for x in b.block.split("\n") if x.strip()]


def test_repeated_ngrams_in_one_shuffle_of_fixed_size_rows(spark):
    from collections import Counter, defaultdict

    from quarry.operators.text import repeated_ngrams
    rows = [(1, "a b c d a b c d a b"), (1, "a b c d e"), (2, "a b c d"), (None, "a b c d"), (None, "x a b c d"), (3, None), (4, "short"),
            (5, "a b c d e"), (5, "a b c d e")]
    n_occ, docs = Counter(), defaultdict(set)
    for k, t in rows:
        words = (t or "").split()
        for i in range(len(words) - 2):
            n_occ[g := " ".join(words[i:i + 3])] += 1
            docs[g].add(k)
    found = repeated_ngrams(spark.createDataFrame(rows, "doc_id long, text string"), n=3, min_count=3)
    assert sorted(tuple(r) for r in found.collect()) == sorted((g, c, len(docs[g])) for g, c in n_occ.items() if c >= 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan  # counts and places are summed in hash tables, not by sorting all n-grams


def test_batches_are_read_text_by_text(spark):
    """Of a batch of many texts only one is held as Python objects, and what comes out."""
    import tracemalloc

    import pyarrow as pa
    toks = pa.array([[f"t{i}_{j}" for j in range(300)] for i in range(1000)] + [None, []])
    blocks = pa.array([[{"block_no": j, "kind": "paragraph", "block": f"text {i} {j} " * 5, "level": None} for j in range(100)] for i in range(500)] + [None])
    budget = pa.array([2000] * 501)
    T._dedup_udf(3, 10).func(toks[:2]), K._pack_udf(2000).func(blocks[:2], budget[:2])  # imports
    tracemalloc.start()
    deduped = T._dedup_udf(3, 10).func(toks)
    packed = K._pack_udf(2000).func(blocks, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    toks.to_pylist()
    whole = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert deduped.to_pylist()[-2:] == [None, ""] and deduped[5].as_py() == "".join(toks[5].as_py())
    assert packed.to_pylist()[-1] == [] and packed.type == pa.list_(pa.string())
    assert _norm("".join(packed[0].as_py())) == _norm("".join(b["block"] for b in blocks[0].as_py()))
    assert peak < whole / 2


ODD_TEXTS = [(1, "a b a b  a_9 Ünï x\n\t.中文,ab中 \U0001F600\U0001F600z"), (1, "a b"), (2, None), (3, ""), (4, "q"), (None, "a b a"), (5, "a " * 700),
             (6, " ".join(f"w{i % 7}" for i in range(40)) + "\0\0 \u0301é")]


def test_token_lists_cut_like_the_expression(spark, monkeypatch):
    from quarry.functions import text as FT
    from quarry.operators import quality as Q
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").coalesce(1)
    want = docs.select("doc_id", F.coalesce(FT.tokens(F.col("text")), F.array()).alias("_t")).collect()
    for limit in (1 << 22, 30, 1):
        monkeypatch.setattr(Q, "TOKEN_BYTES", limit)
        assert Q.token_lists(docs).collect() == want
    assert Q.token_lists(docs.limit(0)).collect() == []


def test_window_perplexity_by_hand(spark, monkeypatch):
    """Heavy bigrams are summed where they are read, the others meet the model; both give what a count by hand gives."""
    import math
    import re
    from collections import Counter
    from quarry.operators import quality as Q
    toks = [(k, re.findall(r"[一-鿿]|[A-Za-z0-9_]+|.", t, re.S)) for k, t in ODD_TEXTS if t]
    c2, c1 = (Counter(p[:n] for _, t in toks for p in zip(t, t[1:])) for n in (2, 1))
    v = len({x for _, t in toks for x in t})
    want = {}
    for key, t in toks:
        for i, p in enumerate(zip(t, t[1:]), 1):
            want.setdefault((key, 0 if i < 20 else (i - 20) // 10 + 1), []).append(-math.log((c2[p] + 1) / (c1[p[:1]] + v)))
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    for share in (0.0, 0.005, 0.3, 1.0):
        monkeypatch.setattr(Q, "HEAVY_BIGRAMS", share)
        got = Q.window_perplexity(docs, max_length=20, stride=10).collect()
        assert {(r.doc_id, r.win_no) for r in got} == set(want) and len(got) == len(want)
        for r in got:
            assert math.isclose(r.ppl, math.exp(sum(x := want[r.doc_id, r.win_no]) / len(x)), rel_tol=1e-9)


def test_common_bigrams_leave_the_texts_as_sums(spark):
    """The rows that meet in the shuffle: one a window, and one for each token of a bigram that isn't common."""
    from quarry.operators import quality as Q
    import pyarrow as pa
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    heavy = pa.table({"prev": ["a", " "], "tok": [" ", "a"], "nll": [1.0, 2.0]})
    rows = Q.score_windows(docs.where("doc_id = 5"), heavy).collect()
    assert {(r.win_no, r.prev, r.tok, r.n, r.nll) for r in rows} == {(0, None, None, 511, 256 + 2.0 * 255), (4, None, None, 120, 180.0), *(
        (w, None, None, 256, 384.0) for w in (1, 2, 3))}
