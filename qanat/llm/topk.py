"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt by hash into blocks of bounded size. A tile is one block of queries against one block
of candidates: a matrix product, a partial selection per query, and the block's best ``k`` go on. Per-query lists are
merged as a tree: first those of ``FAN`` candidate blocks, then the rest. Components are whole numbers, so products are
exact in double precision up to 2**53; a tile that could exceed that is summed in Python integers.

Every pair of blocks has to meet somewhere. Blocks are as large as a task's memory allows, as a tile's arithmetic grows
with their product and what it reads only with their sum: 64 dimensions are 2 * 64 * QUERIES * CANDIDATES operations
for 256 * (QUERIES + CANDIDATES) bytes, seconds of work for a fraction of a second of reading. Components travel in
single precision where that holds them.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part (a component that is
finite but not when scaled is the largest double of its sign), nor do null ids; vectors of different lengths are not
compared; rows that share an id are one item: its score with another is the best among their rows' pairs, and they are
never each other's candidate; a query without candidates has no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, in expectation, and fewer if they have more than DIM components; a tile's product is taken STRIPE queries and SPAN candidates at a time.
QUERIES, CANDIDATES, STRIPE, SPAN, DIM = 32_768, 131_072, 256, 16_384, 64
#: Candidate blocks whose lists one merge of the first level takes.
FAN = 16
LARGEST = np.finfo(np.float64).max


def held(x: np.ndarray) -> bytes:
    """Whole numbers in single precision if it holds them all, else in double."""
    return (x.astype(np.float32) if np.abs(x).max() < 2**24 else x).tobytes()


def packed(rows: DataFrame, scale: int) -> DataFrame:
    """(id, vec) -> (id, dim, comp): whole-number components floor(scale * x) as packed doubles; what takes no part is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("vec")
            flat = vectors.flatten().cast(pa.float64())
            flat = flat.to_numpy(zero_copy_only=False)  # null is NaN
            with np.errstate(over="ignore"):
                whole = np.floor(flat * scale)
            whole = np.where(np.isfinite(flat), np.clip(whole, -LARGEST, LARGEST), whole)
            ends = np.concatenate(([0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy()))).astype(np.int64)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(whole))))
            fine = (np.diff(ends) > 0) & (bad[ends[1:]] == bad[ends[:-1]]) & b.column("id").is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(fine)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(np.diff(ends)[at], pa.int32()), pa.array([held(whole[ends[i] : ends[i + 1]]) for i in at], pa.binary())], ["id", "dim", "comp"])

    return rows.mapInArrow(run, "id long, dim int, comp binary")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float32 if len(v.as_buffer()) == 4 * dim else np.float64).astype(np.float64) for v in column]) if len(column) else np.zeros((0, dim))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b.T
    return np.array([[sum(int(x) * int(y) for x, y in zip(v, w, strict=True)) for w in b] for v in a], object)


def tile(k: int):
    """The best k candidates of each query of a tile, ties to smaller ids."""

    def run(rows: pa.Table) -> pa.Table:
        is_query = rows.column("query").to_numpy(zero_copy_only=False)
        ids = rows.column("id").to_numpy()
        block = rows.column("block").to_numpy()
        comp = matrix(rows.column("comp"), rows.column("dim")[0].as_py())
        order = np.argsort(ids, kind="stable")
        c, q = order[~is_query[order]], order[is_query[order]]
        found: list[tuple[int, int, int]] = []

        def take(qids: np.ndarray, cids: np.ndarray, scores: np.ndarray) -> None:
            """Of a part of the tile; rows of one id count once, with their best score."""
            for axis, own in ((0, qids), (1, cids)):
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                if len(first) < len(own):
                    scores = np.maximum.reduceat(scores, first, axis=axis)
            qids, cids = np.unique(qids), np.unique(cids)
            for row, qid in zip(scores, qids, strict=True):
                at = np.arange(len(cids))
                if row.dtype != object and (m := k + 1) < len(cids) and len(cids) > 4 * k:  # all that reach the k-th best, with room for the query's own id
                    at = np.flatnonzero(row >= np.partition(row, len(cids) - m)[len(cids) - m])
                at = at[cids[at] != qid]
                top = at[np.argsort(-row[at], kind="stable")][:k]
                found.extend((int(qid), int(cids[i]), max(-(2**63), min(2**63 - 1, int(row[i])))) for i in top)

        for i, j in spans(ids[q], STRIPE):
            for m, n in spans(ids[c], SPAN):
                take(ids[q[i:j]], ids[c[m:n]], products(comp[q[i:j]], comp[c[m:n]]))
        best: dict[int, list[tuple[int, int]]] = {}
        for qid, cid, s in found:
            best.setdefault(qid, []).append((-s, cid))
        out = [(qid, cid, -s) for qid, own in best.items() for s, cid in sorted(own)[:k]]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "block": pa.array(np.full(len(out), block[0]), pa.int32()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.int64())})

    return run


def spans(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Parts of about ``size`` of sorted ids; rows of one id stay together."""
    edges = [0]
    while edges[-1] < len(ids):
        edges.append(int(np.searchsorted(ids, ids[min(edges[-1] + size, len(ids)) - 1], "right")))
    return list(zip(edges, edges[1:], strict=False))


def best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, k: int, is_query: Column, scale: int = 256) -> DataFrame:
    """(id, vec) -> (query_id, rank, vec_id, score): each query's k highest inner products with all other rows."""
    vectors = packed(rows.select("id", "vec"), scale)
    size = F.coalesce(F.size("vec"), F.lit(0))
    count = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.sum(size).alias("size"), F.sum(F.when(is_query, size)).alias("q_size")).head()
    blocks = lambda n, size, most: max(1, math.ceil(max(n, (size or 0) / DIM) / most))
    c, q = blocks(count["n"], count["size"], CANDIDATES), blocks(count["q"], count["q_size"], QUERIES)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    asked = vectors.filter(is_query).select("id", "dim", "comp", deal(q, 1).alias("y"), numbers(c).alias("block"), F.lit(True).alias("query"))
    held = vectors.select("id", "dim", "comp", numbers(q).alias("y"), deal(c, 2).alias("block"), F.lit(False).alias("query"))
    lists = asked.unionByName(held).groupBy("block", "y", "dim").applyInArrow(tile(k), "query_id long, block int, vec_id long, score long")
    lists = lists.groupBy("query_id", F.floor(F.col("block") / FAN).alias("part"), "vec_id").agg(F.max("score").alias("score"))
    if c > FAN:
        lists = best(lists, k, "part").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(lists, k).select("query_id", "rank", "vec_id", "score")
