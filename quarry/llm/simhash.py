"""SimHash near-duplicates by the general pigeonhole principle.

A text's fingerprint has 64 bits: bit i is set if over half of its shingles' XXH64 hashes have it set.
Fingerprints link at ``max_bits`` or fewer differing bits, and components of links are the groups.

Equal fingerprints collapse first, so a group of exact copies is one fingerprint, however large.
The bits are then grouped into m partitions, correlated ones together, and partition i gets a threshold t_i,
-1 (never probed) or more, with sum(t_i + 1) = max_bits + 1: two fingerprints within max_bits bits agree within t_i
bits on some partition. Partition and threshold costs are estimated candidate counts (pairs that agree
exactly, counted on all fingerprints, times the growth of a ball under the bits' frequencies) plus the
probes; dynamic programming finds the cheapest thresholds, m is the one with the least modelled cost.
Each fingerprint is put into the slots of its partitions' keys and probes the larger keys within the thresholds;
members of a slot are verified on all bits.

Slots put out a star for each connected group of members, never all pairs. A slot with over ``HOT``
fingerprints is dealt in blocks: every pair of blocks is a task of its own, so no pair is lost and
no task holds more than two blocks.

Defined results: a null text is empty; a text without words has fingerprint zero and links like any
other; fewer words than the shingle make one shingle. component_id is the least doc_id reachable, null ids last
(null if the group has no other). Rows that repeat an id and a text are one document to ``representatives``;
rows with one id and different texts are different ones. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_key, utf8
from .components import stars

SHINGLE, MAX_BITS, SEED = 4, 4, 42
BITS = 64
#: A probe costs as much as this many verified pairs (it is shuffled, a pair is one instruction).
PROBE_COST = 10.0
#: Fingerprints with one key from which on a slot is dealt in blocks.
HOT = 20_000
#: Slots from this size on are searched breadth-first, smaller ones by comparing neighbours at every distance.
WIDE = 128

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text."""
    from xxhash import xxh64_digest
    words = text.translate(_LOWER).split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return int.from_bytes(xxh64_digest(b" ".join(words), SEED), "big")
    joined = b" ".join(words)
    first = [0, *(np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)).tolist()]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):  # bounded memory for a text of any length
        ends = first[i + shingle: min(i + (1 << 16), n) + shingle]
        parts = map(joined.__getitem__, map(slice, first[i:], [e - 1 for e in ends]))
        h = b"".join(map(xxh64_digest, parts, repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, BITS)
        whole = len(bits) // 255 * 255
        if whole:
            counts += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tk, fp) by row; fp as a signed long, tk the digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(fps, pa.int64())],
                                             names=["doc_id", "tk", "fp"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("tk"), F.col("text").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, tk bigint, fp bigint")


# ---- partitions and thresholds (numbers about bits: 64 x 64 at most) ----

def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set: summed by task, then by bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64).astype("<u8")
            x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BITS), pa.int32()), pa.array([n] * BITS, pa.int64()),
                 *(pa.array(total[:, j].astype(np.int64)) for j in range(BITS))],
                names=["i", "n", *(f"c{j}" for j in range(BITS))])

    cols = [f"c{j}" for j in range(BITS)]
    rows = classes.select("fp").mapInArrow(run, "i int, n bigint, " + ", ".join(f"{c} bigint" for c in cols)).groupBy("i").agg(
        F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in cols)).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r["i"]] = [r[c] for c in cols]
    return (rows[0]["n"] if rows else 0), out


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size, grown greedily around the strongest remaining correlation."""
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = math.ceil(len(left) / (m - k))
        rest = sorted(left)
        i, j = divmod(int(np.argmax(corr[np.ix_(rest, rest)])), len(rest))
        part = list(dict.fromkeys([rest[i], rest[j]]))[:size]
        while len(part) < size:
            open_ = [b for b in rest if b not in part]
            part.append(open_[int(np.argmax(corr[np.ix_(open_, part)].sum(axis=1)))])
        parts.append(sorted(part))
        left -= set(part)
    return parts


def ball(p: np.ndarray, part: list[int], upto: int) -> np.ndarray:
    """Chances that two fingerprints differ in at most 0, 1, ... ``upto`` bits of the partition, bits
    taken as independent with the measured frequencies."""
    d = np.zeros(upto + 1)
    d[0] = 1.0
    for b in part:
        q = 2 * p[b] * (1 - p[b])
        d[1:] = d[1:] * (1 - q) + d[:-1] * q
        d[0] *= 1 - q
    return np.maximum(np.cumsum(d), 1e-30)


def probes(width: int, t: int) -> float:
    """Slots that a fingerprint is put into or probes: its own, and half of the others within t bits."""
    return 0.0 if t < 0 else 1 + sum(math.comb(width, i) for i in range(1, t + 1)) / 2


def thresholds(n: int, parts: list[list[int]], p: np.ndarray, equal_pairs: list[float], max_bits: int) -> tuple[
        list[int], float]:
    """Thresholds with sum(t_i + 1) = max_bits + 1 of the least cost, by dynamic programming over partitions and
    the sum so far; equal_pairs: estimated pairs that agree on the whole partition."""
    units = max_bits + 1
    best = {0: (0.0, [])}
    for part, pairs in zip(parts, equal_pairs, strict=True):
        chance = ball(p, part, max_bits)
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, units - used):
                if t > len(part):
                    break
                more = 0.0 if t < 0 else pairs * chance[t] / chance[0] + PROBE_COST * n * probes(len(part), t)
                got = (cost + more, [*ts, t])
                if used + t + 1 not in new or got < new[used + t + 1]:
                    new[used + t + 1] = got
        best = new
    cost, ts = best[units]
    return ts, cost


def key_of(fp: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for j, b in enumerate(part):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def slot_counts(classes: DataFrame, parts: list[list[int]]) -> DataFrame:
    """(slot, n): fingerprints by partition and key; slot = partition << 48 | key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            slot = np.concatenate([key_of(fp, part) | i << 48 for i, part in enumerate(parts)])
            yield pa.RecordBatch.from_arrays([pa.array(slot)], names=["slot"])
    return classes.select("fp").mapInArrow(run, "slot bigint").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


# ---- probing and verifying ----

def placed(classes: DataFrame, parts: list[list[int]], ts: list[int]) -> DataFrame:
    """(slot, fp): each fingerprint in its own slots, and in those of larger keys within the thresholds. Of
    two fingerprints within a threshold, the one with the smaller key meets the other in the other's slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").to_numpy()[at:at + 4096]
                for i, (part, t) in enumerate(zip(parts, ts, strict=True)):
                    if t < 0:
                        continue
                    own = key_of(fp.view(np.uint64), part)
                    slots, fps = [own], [fp]
                    for d in range(1, t + 1):
                        for bits in combinations(range(len(part)), d):
                            other = own ^ sum(1 << b for b in bits)
                            up = other > own
                            slots.append(other[up])
                            fps.append(fp[up])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots) | i << 48), pa.array(
                        np.concatenate(fps))], names=["slot", "fp"])

    return classes.select("fp").mapInArrow(run, "slot bigint, fp bigint")


def roots(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint the index of its component's first one, breadth-first: those not yet reached are compared
    with those reached, in blocks."""
    root = np.full(len(fp), -1, np.int64)
    rest = np.arange(len(fp))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        root[seed] = seed
        front = np.array([seed])
        while len(front) and len(rest):
            now, front = front[:64], front[64:]
            near = (np.bitwise_count(fp[rest][None, :] ^ fp[now][:, None]) <= max_bits).any(axis=0)
            met = rest[near]
            root[met] = seed
            rest = rest[~near]
            front = np.concatenate([front, met])
    return root


def slot_links(slot: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, fp of its root) within each slot; ``slot`` is sorted."""
    root = np.arange(len(slot))
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    sizes = np.diff(np.r_[starts, len(slot)])
    for s, n in zip(starts[sizes >= WIDE], sizes[sizes >= WIDE], strict=True):
        root[s:s + n] = s + roots(fp[s:s + n], max_bits)
    small = np.repeat(sizes < WIDE, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(slot))  # members from here to the slot's end
    a, b = [], []
    for d in range(1, int(sizes[sizes < WIDE].max(initial=0))):
        i = np.flatnonzero(small & (left > d))
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
        a.append(i)
        b.append(i + d)
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        while len(a):  # least index reachable, halving the paths
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if np.array_equal(before, root):
                break
    linked = root != np.arange(len(root))
    return fp[linked], fp[root[linked]]


def links(slots: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): a star for each connected group within each slot (slot, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def out(slot, fp):
            a, b = slot_links(slot, fp.view(np.uint64), max_bits)
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], names=["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last slot may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            held.append((key, batch.column("fp").to_numpy()))
            if held[0][0][0] == key[-1]:
                continue
            slot, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.searchsorted(slot, slot[-1])
            yield out(slot[:cut], fp[:cut])
            held = [(slot[cut:], fp[cut:])]
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return slots.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u bigint, v bigint")


def dealt(slots: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, fp): the slots, hot ones in pairs of blocks. A fingerprint of block b takes part in (b, j) for
    every block j of its slot."""
    blocks = counts.where(F.col("n") > hot).select("slot", F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
    slots = slots.join(blocks, "slot", "left")
    b = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = F.when(F.col("blocks").isNull(), F.array(F.col("slot"))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("slot", F.least(b, j), F.greatest(b, j))))
    return slots.select(F.explode(pair).alias("key"), "fp")


def met(classes: DataFrame, parts: list[list[int]], ts: list[int], hot: int = HOT) -> DataFrame:
    """(key, fp): the placed fingerprints, hot slots dealt in blocks. Hot is a slot by all that are placed there: the
    neighbours of a slot receive all of its fingerprints, however few are their own."""
    slots = placed(classes, parts, ts)
    return dealt(slots, slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")), hot)


def plan(classes: DataFrame, max_bits: int = MAX_BITS) -> tuple[list[list[int]], list[int], DataFrame]:
    """Partitions, thresholds, and the stored counts of the slots."""
    n, both = bit_counts(classes)
    n = max(n, 1)
    p = np.diag(both) / n
    options = []
    for m in range(2, max_bits + 2):
        parts = group_bits(n, both, m)
        modelled = [n * n / 2 * ball(p, part, 0)[0] for part in parts]
        options.append((thresholds(n, parts, p, modelled, max_bits)[1], m, parts))
    parts = min(options)[2]
    counts = stored(slot_counts(classes, parts))
    c = F.col("n").cast("double")
    got = {r[0]: r[1] for r in counts.groupBy(F.shiftright("slot", 48)).agg(F.sum(c * (c - 1) / 2)).collect()}
    ts, _ = thresholds(n, parts, p, [max(got.get(i, 0.0), 1.0) for i in range(len(parts))], max_bits)
    return parts, ts, counts


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, tk, fp, component_id, representative) by row. representative: the row is of the group's
    first document (least id, null ids last, then least tk)."""
    rows = stored(fingerprints(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk"))
    classes = stored(rows.groupBy("fp").agg(first.alias("first")))
    parts, ts, _ = plan(classes, max_bits)
    found = links(met(classes, parts, ts, hot), max_bits)
    tree = stars(found)
    member = classes.join(tree, classes["fp"] == tree["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    group = member.groupBy("root").agg(F.min("first").alias("first"))
    group = stored(member.drop("first").join(group, "root").select(F.col("fp").alias("_fp"), "first"))
    out = rows.join(group, rows["fp"] == group["_fp"])
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tk") == F.col("first.tk"))
    return out.select("doc_id", "tk", "fp", F.col("first.doc_id").alias("component_id"), chosen.alias("representative"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay: one of each group, all columns kept. The texts are shuffled once, by id;
    rows that repeat an id and a text become one."""
    gone = near_duplicates(docs, shingle, max_bits).where(~F.col("representative")).select(
        F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")).distinct()
    least = F.lit(-(1 << 63))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("bigint"), least).alias("_key"),
                       text_key().alias("_text"))
    gone = gone.withColumn("_id", F.coalesce("_id", least))
    out = rows.join(gone, (rows["_key"] == gone["_id"]) & (rows["_text"] == gone["_tk"]), "left_anti")
    return out.dropDuplicates(["_key", "_text"]).select("_row.*")
