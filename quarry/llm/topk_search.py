"""Exact top-k search by inner product through vector-approximation files.

Vectors are integers (floor(256 * x)). The rows are dealt into blocks, and each block is a vector-approximation file
with a grid of its own: every dimension is cut into ``CELLS`` cells that hold equally many of the block's rows, and a row's
approximation is one byte a dimension, the number of its cell. A search scans the approximations only: the ends
of a row's cells bound its score from above (its distance from below). Exact vectors are then read in the order of these
bounds, in growing steps, until the kth score found is above every bound that is left; at equality reading goes
on, for a smaller id may win. The files are written once as a table, and query blocks meet them in a grid (``vectors``);
each meeting returns k rows a query, merged by rank.

Defined results: vectors null or holding null or non-finite components take no part; so do vectors of another
length than the query's for that query; empty vectors score 0 against each other. Ties go to the smaller id, a null id comes
last and asks nothing. Rows equal in id and vector count once; other rows that repeat an id are rows of their own, but no row
is found by a query of its own id. An empty table gives no rows; other columns are not read. Scores beyond 64 bits raise
OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import (BLOCK_BYTES, QUERY_BYTES, by_length, dealt, grid, integer_vectors, matrix, scoring_type,
                      sorted_by_id)

#: Cells a dimension: six bits.
CELLS = 64
#: Queries whose bounds are held at once, and exact vectors read first, as a multiple of k.
TILE = 128
FIRST = 4

FILE = "block int, id bigint, cells binary, vec binary"
FOUND = "query_id bigint, query_key string, vec_id bigint, score bigint"


def cell_edges(x: np.ndarray, cells: int) -> np.ndarray:
    """Lower ends of the cells of every dimension and, last, the end after the largest value: (cells + 1, dimensions)."""
    ranked = np.sort(x, axis=0)
    return np.vstack([ranked[np.arange(cells) * len(x) // cells], ranked[-1:] + 1])


def approximations(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell numbers of the vectors ``x``, one byte a dimension."""
    out = np.empty(x.shape, np.uint8)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(edges[:-1, j], x[:, j], side="right") - 1
    return out


def vector_files(vectors: DataFrame, cells: int = CELLS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The approximation files of ``vectors`` (id, vec), stored: a row's cells beside its exact vector; a row without
    cells holds, as its vector, the edges of the grid for vectors of its length in the block."""
    vectors = stored(vectors)
    total = vectors.agg(F.sum(F.length("vec") + 16)).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        import pyarrow as pa
        out = []
        for length, at in by_length(group).items():
            x = matrix(group, at, length)
            edges = cell_edges(x, cells)
            codes = [c.tobytes() for c in approximations(x, edges)]
            out.append((group.column("id").take(pa.array(at)).to_pylist(), codes, [r.tobytes() for r in x]))
            out.append(([None], [None], [edges.tobytes()]))
        cols = [[v for part in out for v in part[i]] for i in range(3)]
        return pa.table({"block": pa.array([key[0].as_py()] * len(cols[0]), pa.int32()), "id": pa.array(cols[0], pa.int64()),
                         "cells": pa.array(cols[1], pa.binary()), "vec": pa.array(cols[2], pa.binary())})

    return stored(dealt(vectors, n).repartition(n, "block").groupBy("block").applyInArrow(build, FILE))


def in_bound_order(bounds: np.ndarray, exact: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows and their scores: exact vectors are read by falling bound until the kth score is above all bounds
    left. Equal scores go to the row that comes first."""
    todo = np.flatnonzero(bounds > -np.inf)
    rows, scores, step = np.empty(0, np.int64), np.empty(0, exact.dtype), FIRST * k
    while len(todo):
        if len(todo) > step:
            part = np.argpartition(-bounds[todo], step - 1)
            now, todo = todo[part[:step]], todo[part[step:]]
        else:
            now, todo = todo, todo[:0]
        rows, scores = np.concatenate([rows, now]), np.concatenate([scores, exact[now] @ query])
        best = np.lexsort((rows, -scores))[:k]
        rows, scores = rows[best], scores[best]
        if len(rows) == k:
            todo = todo[bounds[todo] >= scores[-1]]
        step *= 2
    return rows, scores


def search_file(file: pa.Table, queries: pa.Table, k: int, cells: int) -> pa.Table:
    """The k best rows of one file for each query (id, key, vec)."""
    import pyarrow as pa
    is_grid = np.array([c is None for c in file.column("cells").to_pylist()], bool)
    edges = {len(v) // 8 // (cells + 1): v for v, g in zip(file.column("vec").to_pylist(), is_grid, strict=True) if g}
    rows = sorted_by_id(file.filter(pa.array(~is_grid)))
    row_ids = rows.column("id").to_pylist()
    places: dict = {}
    for i, x in enumerate(row_ids):
        places.setdefault(x, []).append(i)
    asked, have = by_length(queries), by_length(rows)
    out: list[tuple] = []
    for length, at in asked.items():
        if length not in have:
            continue
        inside = have[length]
        local = {int(g): i for i, g in enumerate(inside)}
        x, q = matrix(rows, inside, length), matrix(queries, at, length)
        ends = np.frombuffer(edges[length], "<i8").reshape(cells + 1, length)
        kind = scoring_type(x, q)
        codes = np.frombuffer(b"".join(rows.column("cells").take(pa.array(inside)).to_pylist()), np.uint8).reshape(x.shape)
        dims = np.arange(length)
        low, high = ends[codes, dims].astype(kind), (ends[codes.astype(np.int64) + 1, dims] - 1).astype(kind)
        x, q = x.astype(kind), q.astype(kind)
        ids = queries.column("id").take(pa.array(at)).to_pylist()
        keys = queries.column("key").take(pa.array(at)).to_pylist()
        for first in range(0, len(at), TILE):
            tile = q[first:first + TILE]
            bounds = (np.maximum(tile, 0) @ high.T + np.minimum(tile, 0) @ low.T).astype(np.float64)
            if kind is np.int64:  # beyond 2^53 a bound may be rounded down
                bounds = np.nextafter(bounds, np.inf)
            for i, query in enumerate(tile):
                name = ids[first + i]
                own = [local[p] for p in places.get(name, ()) if p in local]
                bounds[i, own] = -np.inf
                best, scores = in_bound_order(bounds[i], x, query, k)
                out += [(name, keys[first + i], row_ids[inside[r]], int(s)) for r, s in zip(best, scores, strict=True)]
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "query_key": pa.array(cols[1], pa.string()),
                     "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})


def top_k(df: DataFrame, asks: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", cells: int = CELLS,
          block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each row for which ``asks`` (a condition on the column ``id``) holds: its k best other rows, as query_id, rank
    from 1, vec_id, score."""
    files = vector_files(integer_vectors(df, vector, id=F.col(vec_id).cast("bigint")), cells, block_bytes)
    queries = files.where(F.col("cells").isNotNull() & F.col("id").isNotNull() & asks).select(
        "id", F.md5("vec").alias("key"), "vec")
    found = grid(files, queries, lambda rows, asked: search_file(rows, asked, k, cells), FOUND, query_bytes=query_bytes)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
