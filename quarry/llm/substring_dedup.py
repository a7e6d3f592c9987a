"""Exact substring removal by a sparse suffix array, sorted deep-shallow.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller id, or earlier in the same
document) goes. Not all suffixes are sorted, only those at anchors: the anchor of a ``LENGTH``-byte window is
the ``GRAM``-byte gram in it with the least hash (the rightmost of equals), so equal windows have their anchor
at the same place, and neighbouring windows share one. A run is the windows of one anchor: at most
LENGTH - GRAM + 1 of them, known by the text from the first window's start to the last one's end.

1. Anchors' hashes are looked for everywhere: each slice of documents sends every hash once to the
   hash's bucket; hashes that occur in two slices, or twice in one, are reported to their documents.
2. Documents with reported anchors send these anchors' runs, with their text, to the hash's bucket.
   Equal runs of a slice are sent once (the earliest), the others are removed on the spot.
3. In a bucket the runs' suffixes from the anchor on are sorted deep-shallow: multikey quicksort over 8-byte
   symbols to the depth of the gram, all equal ranges of a depth together, then a blind trie for each group that
   agrees so far. Neighbours' common prefixes and the left contexts then give, window by window, the
   classes of equal windows, and all of a class but the earliest are removed.
4. Removed stretches go back to their documents, are merged, and the rest of the text is digested.

Texts are shuffled once, by id (steps 2 and 4 share that exchange); hashes and runs are small against them.
A text repeated anywhere is sent once a slice. Hashes found in over ``HOT`` slices send their windows'
digests instead of runs, each to the digest's own bucket, so no bucket depends on one hash.
The number of buckets follows the input's size (``BUCKET_BYTES`` of text each).

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes lose nothing; a null id counts
as the least; rows that repeat an id and a text are one document, each gets its result; rows of one id with
different texts are judged as one id, whose equal places don't remove each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_key, utf8

LENGTH, GRAM = 100, 32
BUCKET_BYTES = 8 << 20
HOT = 2000
#: Texts are looked at in pieces of so many windows.
PIECE = 1 << 20
NO_ID = -(1 << 63)
#: Hot hashes (8 bytes each) that may be broadcast.
MAX_BROADCAST = 100_000

_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram at every place of the bytes; a power of 2 long, by doubling."""
    h, width, factor = data.astype(np.uint64) + _U(1), 1, _FACTOR
    while width < gram:
        h = h[:-width] * _U(factor) + h[width:]
        factor = factor * factor & (1 << 64) - 1
        width *= 2
    return mixed(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    more = width - have
    return np.minimum(x[:-more], x[more:]) if more else x


class Runs:
    """The runs of some documents: document's number, first window's start, number of windows, anchor's
    distance from that start, hash; numbers are places in ``texts``."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        pieces = []
        held, size = [], 0
        for i, t in enumerate(texts):
            if len(t) < length:
                continue
            for at in range(0, len(t) - length + 1, PIECE):
                part = t[at:at + PIECE + length - 1]
                held.append((i, at, part))
                size += len(part)
                if size >= PIECE:
                    pieces.append(self._piece(held, length, gram))
                    held, size = [], 0
        if held:
            pieces.append(self._piece(held, length, gram))
        cols = [np.concatenate(c) for c in zip(*pieces, strict=True)] if pieces else [np.zeros(0, np.int64)] * 4 + [
            np.zeros(0, np.uint64)]
        self.doc, self.start, self.windows, self.anchor, self.hash = cols

    @staticmethod
    def _piece(parts: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        h = gram_hashes(data, gram)
        places = np.arange(len(h), dtype=np.uint64)
        low = sliding_least((h & ~_U((1 << 23) - 1)) | (_U((1 << 23) - 1) - places), length - gram + 1)
        at = ((1 << 23) - 1) - (low & _U((1 << 23) - 1)).astype(np.int64)  # the anchor of each window
        ok = np.ones(len(at) + length, bool)  # windows that lie within one text
        for e in (begins + sizes).tolist():
            ok[max(0, e - length + 1):e] = False
        ok = ok[:len(at)]
        first = ok & np.r_[True, (at[1:] != at[:-1]) | ~ok[:-1]]
        s = np.flatnonzero(first)
        ends = np.flatnonzero(ok & np.r_[(at[1:] != at[:-1]) | ~ok[1:], True])
        part = np.searchsorted(begins, s, "right") - 1
        doc = np.array([i for i, _, _ in parts])[part]
        offset = np.array([a for _, a, _ in parts])[part]
        return doc, s - begins[part] + offset, ends - s + 1, at[s] - s, h[at[s]]


# ---- deep-shallow sorting ----

def shallow_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over the columns of ``words`` (8-byte symbols): the order, and the number of the group
    of equal rows for each place of it. A symbol is sorted by only where those before it are equal."""
    n, depth = words.shape
    order = np.arange(n)
    group = np.zeros(n, np.int64)
    open_ = np.arange(n)  # places whose group has more than one member
    for d in range(depth):
        if not len(open_):
            break
        rows = order[open_]
        by = np.lexsort((words[rows, d], group[open_]))
        rows = rows[by]
        order[open_] = rows
        symbol, g = words[rows, d], group[open_]
        new = np.r_[False, (symbol[1:] != symbol[:-1]) | (g[1:] != g[:-1])]
        head = np.zeros(n, bool)
        head[open_] = new
        head[1:] |= group[1:] != group[:-1]
        group = np.cumsum(head)
        sizes = np.bincount(group, minlength=1)
        open_ = np.flatnonzero(sizes[group] > 1)
    return order, group


class BlindTrie:
    """Patricia trie over strings of one group, which agree on ``depth`` bytes. Inner nodes know only the
    length of the common prefix and the branching bytes; an insertion descends blindly to some leaf, compares
    with it once, and branches where they part. Strings are unique here: equal ones share a leaf."""

    __slots__ = ("strings", "root", "depth")

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth, self.root = strings, depth, [0]  # a leaf is the list of its strings

        for i in range(1, len(strings)):
            self.insert(i)

    def insert(self, i: int) -> None:
        s = self.strings[i]
        node = self.root
        while type(node) is tuple:
            at, kids = node
            c = s[at] if at < len(s) else -1
            node = kids.get(c)
            if node is None:
                node = next(iter(kids.values()))
        t = self.strings[node[0]]
        if s == t:
            node.append(i)
            return
        lcp, most = self.depth, min(len(s), len(t))
        while lcp < most and s[lcp] == t[lcp]:
            lcp += 1
        parent, node = None, self.root
        while type(node) is tuple and node[0] < lcp:
            parent = node
            node = node[1][s[node[0]] if node[0] < len(s) else -1]
        c = s[lcp] if lcp < len(s) else -1
        if type(node) is tuple and node[0] == lcp:
            node[1][c] = [i]
            return
        other = t[lcp] if lcp < len(t) else -1
        branch = (lcp, {other: node, c: [i]})
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = branch

    def order(self) -> tuple[list[int], list[int]]:
        """Strings in order, and each one's common prefix with the one before it (the whole for equal ones)."""
        out, lcps = [], []
        stack = [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if type(node) is tuple:
                at, kids = node
                keys = sorted(kids, reverse=True)
                stack.extend((kids[c], at if c != keys[-1] else lcp) for c in keys)
            else:
                out.extend(node)
                lcps.append(lcp)
                lcps.extend([len(self.strings[node[0]])] * (len(node) - 1))
        return out, lcps


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of documents (equal numbers), overlapping or touching ones joined."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    reach = end.copy()
    new = np.r_[True, doc[1:] != doc[:-1]]
    # the farthest end so far within the document, by adding a step for each document
    step = np.cumsum(new).astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + step) - step
    head = new | np.r_[True, start[1:] > reach[:-1]]
    at = np.flatnonzero(head)
    return doc[at], start[at], reach[np.r_[at[1:], len(doc)] - 1]


def later_windows(key: np.ndarray, strings: list[bytes], doc: np.ndarray, start: np.ndarray, windows: np.ndarray,
                  anchor: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(run, window's start) of every window of the runs that an earlier one equals."""
    n = len(key)
    out_run, out_start = [], []
    data = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    begin = np.r_[0, np.cumsum([len(s) for s in strings])][:-1] + anchor
    words = np.stack([data[begin[:, None] + np.arange(8 * d, 8 * d + 8)].copy().view(">u8")[:, 0].astype(np.uint64)
                      for d in range(gram // 8)], axis=1)
    order, group = shallow_order(words)
    sizes = np.bincount(group, minlength=1)
    heads = np.r_[0, np.cumsum(sizes)[:-1]]
    final, lcps, groups = [], [], []
    for g in np.flatnonzero(sizes > 1):
        rows = order[heads[g]:heads[g] + sizes[g]].tolist()
        suffixes = [strings[r][a:] for r, a in zip(rows, anchor[rows].tolist(), strict=True)]
        by, lcp = BlindTrie(suffixes, gram).order()
        lcp[0] = 0
        final.extend(rows[i] for i in by)
        lcps.extend(lcp)
        groups.append(len(by))
    if not final:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, lcp = np.array(final), np.array(lcps)
    lo, hi = anchor[rows] - windows[rows] + 1, anchor[rows]  # windows start lo to hi bytes before the anchor
    left = np.full(len(rows), 0x1234567, np.uint64)
    at = begin[rows]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((start + anchor, doc))] = np.arange(n)
    rank = rank[rows]
    for o in range(length - gram + 1):
        if o:  # the byte o places before the anchor joins the digest of the left context
            has = hi >= o
            left[has] = mixed(left[has] ^ (data[at[has] - o].astype(np.uint64) + _U(1)))
        right = np.cumsum(lcp < length - o)
        here = np.flatnonzero((lo <= o) & (o <= hi))
        if len(here) < 2:
            continue
        by = np.lexsort((rank[here], left[here], right[here]))
        here = here[by]
        new = np.r_[True, (right[here[1:]] != right[here[:-1]]) | (left[here[1:]] != left[here[:-1]])]
        first = here[np.flatnonzero(new)][np.cumsum(new) - 1]
        r, f = rows[here], rows[first]
        place, earliest = start[r] + anchor[r], start[f] + anchor[f]
        late = (doc[r] != doc[f]) | (place != earliest)
        out_run.append(r[late])
        out_start.append((place - o)[late])
    return np.concatenate(out_run or [np.zeros(0, np.int64)]), np.concatenate(out_start or [np.zeros(0, np.int64)])


# ---- the Spark job ----

def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("id").to_numpy(), batch.column("tk").to_numpy()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    by = np.argsort(bucket, kind="stable")
    b = bucket[by]
    if not len(b):
        return
    heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    for s, e in zip(heads, np.r_[heads[1:], len(b)], strict=True):
        yield int(b[s]), by[s:e]


def anchors(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """(bucket, hashes, ids, marks, known, known_ids): by slice and bucket, each hash once with one of its documents,
    marked if it repeats within the slice; and all (hash, id) of those, which are known to repeat already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for batch in slices(batches, "text"):
            ids, _ = _ids(batch)
            runs = Runs(utf8(batch, "text"), length, gram)
            if not len(runs.hash):
                continue
            by = np.lexsort((ids[runs.doc], runs.hash))
            h, d = runs.hash[by], ids[runs.doc][by]
            head = np.r_[True, h[1:] != h[:-1]]
            count = np.diff(np.r_[np.flatnonzero(head), len(h)])
            repeats = np.repeat(count > 1, count)
            single = head & ~repeats
            marks = head & repeats
            one, first = h[single | marks], d[single | marks]
            flag = marks[single | marks]
            rows = []
            for b, at in _by_bucket((one % _U(buckets)).astype(np.int64)):
                rows.append((b, one[at].tobytes(), first[at].tobytes(), flag[at].tobytes(), None, None))
            kh, kd = h[repeats], d[repeats]
            keep = np.r_[True, (kh[1:] != kh[:-1]) | (kd[1:] != kd[:-1])] if len(kh) else np.zeros(0, bool)
            kh, kd = kh[keep], kd[keep]
            for i in range(0, len(kh), 4096):  # these need no meeting place: any bucket will do
                rows.append((int(kh[i] % _U(buckets)), None, None, None, kh[i:i + 4096].tobytes(), kd[i:i + 4096].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [
                pa.int32(), *[pa.binary()] * 5], strict=True)], names=["bucket", "hashes", "ids", "marks", "known", "known_ids"])

    return docs.mapInArrow(run, "bucket int, hashes binary, ids binary, marks binary, known binary, known_ids binary")


def repeated(found: DataFrame, hot: int) -> DataFrame:
    """(id, hash): the anchors that occur more than once, by document; and, without id, hashes of over ``hot`` slices."""

    def run(t: pa.Table) -> pa.Table:
        import pyarrow as pa
        col = lambda c, kind: np.frombuffer(b"".join(x for x in t.column(c).to_pylist() if x), kind)
        h, d, marked = col("hashes", np.uint64), col("ids", np.int64), col("marks", bool)
        by = np.argsort(h, kind="stable")
        h, d, marked = h[by], d[by], marked[by]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.r_[head, len(h)])
        often = np.repeat(count, count)
        tell = (often > 1) & ~marked  # the documents of marked ones are known
        kh, kd = col("known", np.uint64), col("known_ids", np.int64)
        crowd = h[head][count > hot] if len(head) else h
        ids, hashes = np.concatenate([d[tell], kd, np.zeros(len(crowd), np.int64)]), np.concatenate([h[tell], kh, crowd])
        no_id = np.arange(len(ids)) >= len(ids) - len(crowd)
        return pa.table({"id": pa.array(ids, mask=no_id), "hash": pa.array(hashes.view(np.int64))})

    return found.groupBy("bucket").applyInArrow(run, "id bigint, hash bigint")


def flags_of(repeats: DataFrame) -> DataFrame:
    """(_id, flags): by document its repeated anchors, as struct(hash, hot). The hot hashes are broadcast when
    they are few (counted), joined by shuffle when not."""
    crowd = repeats.where(F.col("id").isNull()).select("hash", F.lit(True).alias("hot"))
    if crowd.count() <= MAX_BROADCAST:
        crowd = F.broadcast(crowd)
    own = repeats.where(F.col("id").isNotNull()).join(crowd, "hash", "left")
    return own.groupBy(F.col("id").alias("_id")).agg(
        F.collect_list(F.struct("hash", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("flags"))


def runs_of(docs: DataFrame, flagged: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """(bucket, kind, meta, body): by slice and bucket, the runs of flagged anchors (kind run), digests of windows
    of hot ones (kind window), and stretches found already (kind done)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for batch in slices(batches, "text"):
            ids, tks = _ids(batch)
            texts = utf8(batch, "text")
            runs = Runs(texts, length, gram)
            flags = [np.array([(x["hash"], x["hot"]) for x in f], np.int64).reshape(-1, 2) for f in batch.column("flags").to_pylist()]
            who = np.repeat(np.arange(len(flags)), [len(f) for f in flags])
            flat = np.concatenate(flags) if flags else np.zeros((0, 2), np.int64)
            # (document, hash) pairs of the flags and of the runs, met by sorting
            pair = np.empty(len(flat), [("d", np.int64), ("h", np.int64)])
            pair["d"], pair["h"] = who, flat[:, 0]
            by = np.argsort(pair, order=("d", "h"))
            pair, hot = pair[by], flat[by, 1]
            mine = np.empty(len(runs.doc), pair.dtype)
            mine["d"], mine["h"] = runs.doc, runs.hash.view(np.int64)
            at = np.searchsorted(pair, mine)
            at = np.minimum(at, max(len(pair) - 1, 0))
            met = (pair[at] == mine) if len(pair) else np.zeros(len(mine), bool)
            pick = np.flatnonzero(met)
            if not len(pick):
                continue
            hot = hot[at[pick]].astype(bool)
            d, s, w, a, h = (x[pick] for x in (runs.doc, runs.start, runs.windows, runs.anchor, runs.hash))
            strings = [texts[i][b:b + n + length - 1] for i, b, n in zip(d.tolist(), s.tolist(), w.tolist(), strict=True)]
            # equal runs of the slice: the earliest goes on, the others are done
            digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in strings), np.int64).reshape(-1, 2)
            by = np.lexsort((s, ids[d], digest[:, 0], digest[:, 1]))
            same = np.r_[False, (digest[by][1:] == digest[by][:-1]).all(axis=1)]
            first = by[np.flatnonzero(~same)][np.cumsum(~same) - 1]
            again = np.zeros(len(d), bool)
            again[by] = same & ((ids[d[by]] != ids[d[first]]) | (s[by] != s[first]))
            skip = np.zeros(len(d), bool)
            skip[by] = same & (again[by] | (tks[d[by]] == tks[d[first]]))
            rows = []

            def put(bucket, kind, meta, body=None):
                rows.append((bucket, kind, np.ascontiguousarray(meta, np.int64).tobytes(), body))

            if again.any():
                m, ms, me = merged(d[again], s[again], s[again] + w[again] + length - 1)
                put(int(ids[0] % buckets), 2, np.stack([ids[m], tks[m], ms, me]))
            go = np.flatnonzero(~skip & ~hot)
            for b, at in _by_bucket((h[go] % _U(buckets)).astype(np.int64)):
                i = go[at]
                put(b, 0, np.stack([h[i].view(np.int64), ids[d[i]], tks[d[i]], s[i], w[i], a[i]]),
                    zlib.compress(b"".join([strings[j] for j in i.tolist()]), 1))
            go = np.flatnonzero(~skip & hot)
            if len(go):
                win = [(hashlib.blake2b(strings[j][k:k + length], digest_size=16).digest(), ids[d[j]], tks[d[j]], s[j] + k)
                       for j in go.tolist() for k in range(w[j])]
                hashes = np.frombuffer(b"".join(x[0] for x in win), np.int64).reshape(-1, 2)
                meta = np.array([x[1:] for x in win], np.int64)
                for b, at in _by_bucket(hashes[:, 0] % buckets):
                    put(b, 1, np.stack([hashes[at, 0], hashes[at, 1], *meta[at].T]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [
                pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "kind", "meta", "body"])

    held = docs.join(flagged, docs["id"] == flagged["_id"]).drop("_id")
    return held.mapInArrow(run, "bucket int, kind int, meta binary, body binary")


def removed(found: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, tk, start, end): stretches to remove."""

    def run(t: pa.Table) -> pa.Table:
        import pyarrow as pa
        kinds = np.array(t.column("kind").to_pylist())
        metas = t.column("meta").to_pylist()
        bodies = t.column("body").to_pylist()

        def meta(kind, width):
            parts = [np.frombuffer(metas[i], np.int64).reshape(width, -1) for i in np.flatnonzero(kinds == kind)]
            return np.concatenate(parts, axis=1) if parts else np.zeros((width, 0), np.int64)

        out = [meta(2, 4)]
        h, ids, tks, s, w, a = meta(0, 6)
        if len(h):
            body = b"".join(zlib.decompress(bodies[i]) for i in np.flatnonzero(kinds == 0))
            ends = np.cumsum(w + length - 1).tolist()
            strings = [body[x:y] for x, y in zip([0, *ends], ends, strict=False)]
            del body
            r, at = later_windows(h, strings, ids, s, w, a, length, gram)
            doc = np.unique(np.stack([ids, tks], axis=1), axis=0, return_inverse=True)
            names, number = doc[0], doc[1].reshape(-1)
            m, ms, me = merged(number[r], at, at + length)
            out.append(np.stack([names[m, 0], names[m, 1], ms, me]))
        h1, h2, ids, tks, s = meta(1, 5)
        if len(h1):
            by = np.lexsort((s, ids, h2, h1))
            h1, h2, ids, tks, s = (x[by] for x in (h1, h2, ids, tks, s))
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = (ids != ids[first]) | (s != s[first])
            out.append(np.stack([ids[late], tks[late], s[late], s[late] + length]))
        every = np.concatenate(out, axis=1)
        return pa.table({k: pa.array(np.ascontiguousarray(x)) for k, x in zip(("id", "tk", "start", "end"), every, strict=True)})

    return found.groupBy("bucket").applyInArrow(run, "id bigint, tk bigint, start bigint, end bigint")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa
    for batch in slices(batches, "text"):
        out = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept_sha256")}
        for text, tk, found in zip(utf8(batch, "text"), batch.column("tk").to_pylist(), batch.column("found").to_pylist(), strict=True):
            own = np.array([(x["start"], x["end"]) for x in found or () if x["tk"] == tk], np.int64).reshape(-1, 2)
            _, s, e = merged(np.zeros(len(own), np.int64), own[:, 0], own[:, 1])
            spans = list(zip(s.tolist(), e.tolist(), strict=True))
            digest, at = hashlib.sha256(), 0
            for x, y in spans:
                digest.update(text[at:x])
                at = y
            digest.update(text[at:])
            for k, v in zip(out, (len(text), sum(y - x for x, y in spans), [{"start": x, "end": y} for x, y in spans],
                                  digest.hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
             pa.array([len(x) for x in out["spans"]], pa.int64()), pa.array(out["kept_sha256"], pa.string()),
             pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) by row; spans are byte ranges, end exclusive."""
    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"),
                       text_key(text).alias("tk"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    buckets = max(16, -(-total // bucket_bytes))
    flagged = flags_of(stored(repeated(anchors(slim, buckets, length, gram), hot)))
    gone = removed(runs_of(slim, flagged.hint("shuffle_hash"), buckets, length, gram), length, gram)
    gone = gone.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("tk", "start", "end")).alias("found"))
    out = slim.join(gone.hint("shuffle_hash"), slim["id"] == gone["_id"], "left").drop("_id")
    return out.mapInArrow(_digested, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                                     "spans array<struct<start:bigint,end:bigint>>")
