"""Exact top-k search by inner product, with Fagin's threshold algorithm.

Vectors are dealt into blocks by their ids; each block is sorted in each dimension once and written as a row. Queries come in
batches of bounded size, and a task takes a batch through its blocks. A query reads its dimensions' lists from the end where its own
component gains most, many steps at a time. A vector met is scored in the dimensions that weigh most in the query first, and in full
only if that score and the lengths of what is left (Cauchy-Schwarz) can reach the query's k-th score so far, over all of the task's
blocks. A block is left when the sum of what the lists still offer, or the lengths of the query and of the block's longest vector,
cannot reach that score, or when all of its vectors have been met. The k best of each task are then merged.

Components are floor(scale * x) with x as double; scores are 64-bit integers. Ties go to the smaller id. Where products could
leave 64 bits, they are worked out with integers of any size.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; a component
that doesn't fit 64 bits after scaling, or one of the k best scores that doesn't, is an error; vectors of different lengths don't
meet; vectors may have any length; rows that repeat an id count once (the smallest vector, component by component, where they
differ) and never meet themselves; a query with fewer than k candidates returns them all; an empty table gives an empty result;
other columns aren't looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared as sh

SCALE = 1024
BLOCK_VECTORS = 4096
#: Queries that are sent to all tasks at a time, about; 8 bytes for each of their components.
BATCH_QUERIES = 2048
#: Of a query's length, the share that the dimensions looked at first hold.
FIRST_SHARE = 0.995
#: Scaled components beyond it don't fit 64 bits for certain.
MOST = float(1 << 63)
#: Steps down the lists before the first look at the threshold; each further look doubles them.
FIRST_STEPS = 4


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v array<bigint>, of the vectors that take part."""
    x = lambda c: c.cast("double")
    fine: Column = F.forall(vector_col, lambda c: F.coalesce(~F.isnan(x(c)) & (F.abs(x(c)) < F.lit(float("inf"))), F.lit(False)))
    scaled = lambda c: F.lit(float(scale)) * x(c)
    whole = lambda c: F.when((scaled(c) < MOST) & (scaled(c) >= -MOST), F.floor(scaled(c)).cast("long")).otherwise(F.raise_error(F.lit("a scaled component doesn't fit 64 bits")).cast("long"))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col)).where(F.col("vec_id").isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine)
    return kept.select("vec_id", F.transform(vector_col, whole).alias("v"))


class Lists:
    """The vectors of a block (each id once), sorted in each dimension."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, order: np.ndarray | None = None) -> None:
        self.ids, self.v = ids, v
        self.order = np.argsort(v, axis=0, kind="stable").T.astype(np.int32) if order is None else order
        self.length = np.sqrt((v.astype(float) ** 2).sum(1)) * (1 + 1e-9)
        self.largest = float(np.abs(v.astype(float)).max()) if v.size else 0.0
        self.met = self.scored = 0

    def best(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best scores, and the scores; those below `least` may be missing."""
        n = len(self.ids)
        if self.largest * float(np.abs(query.astype(float)).sum()) >= 2.0**62:  # beyond 64 bits, or near
            return self.best_of_any_size(query, own, k)
        weight = query.astype(float) ** 2
        by_weight = np.argsort(-weight, kind="stable")
        upto = np.cumsum(weight[by_weight])
        some = by_weight[: int(np.searchsorted(upto, FIRST_SHARE * upto[-1])) + 1]
        rest = np.sqrt(max(weight.sum() - weight[some].sum(), 0.0)) * (1 + 1e-9)
        used = by_weight[weight[by_weight] > 0]
        down = query[used] > 0  # read from the largest value on
        met, rows, scores = self.ids == own, np.empty(0, np.int64), np.empty(0, np.int64)
        if n and np.sqrt(weight.sum()) * (1 + 1e-9) * float(self.length.max()) < least:
            return rows, scores
        done, step = 0, FIRST_STEPS
        while not met.all():
            upto = min(n, done + step)
            places = np.where(down[:, None], n - 1 - np.arange(done, upto), np.arange(done, upto))
            hit = np.zeros(n, bool)
            hit[self.order[used[:, None], places] if len(used) else np.arange(n)] = True
            new = np.flatnonzero(hit & ~met)
            met[new] = True
            self.met += len(new)
            part = self.v[np.ix_(new, some)] @ query[some]
            able = part + rest * self.length[new] + 1 + 1e-9 * np.abs(part) >= least
            new = new[able]
            self.scored += len(new)
            rows, scores = np.append(rows, new), np.append(scores, self.v[new] @ query)
            if len(rows) > k:
                keep = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[keep], scores[keep]
            if len(rows) == k:
                least = max(least, float(scores.min()) * (1 - 1e-12 * np.sign(scores.min())))
            done, step = upto, done + step
            if upto >= n or not len(used):
                break
            # A vector not met yet has no more than the next value in each list.
            at = self.order[used, np.where(down, n - 1 - upto, upto)]
            if int((self.v[at, used] * query[used]).sum()) < least:
                break
        return rows, scores

    def best_of_any_size(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same, with Python's integers and without lists."""
        rows = np.flatnonzero(self.ids != own)
        scores = self.v[rows].astype(object) @ query.astype(object)
        kept = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        if any(not -(1 << 63) <= scores[i] < 1 << 63 for i in kept):
            raise OverflowError("a score doesn't fit 64 bits")
        return rows[kept], np.array([scores[i] for i in kept], np.int64)


def blocks(vectors: DataFrame, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """block, dims, ids, v, places: a written row for each block of vectors (vec_id, v); ids and components as 64-bit, places in the sorted lists as 32-bit integers."""
    once = vectors.groupBy("vec_id", F.size("v").alias("dims")).agg(F.min("v").alias("v"))
    many = max(1, -(-vectors.count() // block_vectors))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ids, v = rows["vec_id"].to_numpy(), np.asarray(rows["v"].combine_chunks().flatten()).reshape(len(rows), -1)
        by_id = np.argsort(ids)
        lists = Lists(ids[by_id], v[by_id])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dims": pa.array([key[1].as_py()], pa.int32()), "ids": [lists.ids.astype("<i8").tobytes()], "v": [lists.v.astype("<i8").tobytes()], "places": [lists.order.astype("<i4").tobytes()]})

    found = once.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")).groupBy("block", "dims").applyInArrow(pack, "block int, dims int, ids binary, v binary, places binary")
    return sh.written(found, "vector-blocks")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block_vectors: int = BLOCK_VECTORS, batch_queries: int = BATCH_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, v) its k best rows of vectors (vec_id, v)."""
    packed = blocks(vectors, block_vectors)
    asked = sh.written(queries.groupBy("vec_id", F.size("v").alias("dims")).agg(F.min("v").alias("v")), "queries")
    batches = max(1, -(-asked.count() // batch_queries))
    parts = []
    for batch in range(batches):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == batch)
        parts.append(sh.written(_searched(packed, [(r["vec_id"], r["dims"], r["v"]) for r in mine.collect()], k), "nearest"))
    found = functools.reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(packed: DataFrame, asked: list[tuple], k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each task's blocks for each of the queries (id, dims, vector)."""
    by_dims: dict[int, list] = {}
    for query_id, dims, v in asked:
        by_dims.setdefault(dims, []).append((query_id, v))
    tables = {d: (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64)) for d, own in by_dims.items()}

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in got:
            for dims, *raw in zip(*(batch.column(c).to_pylist() for c in ("dims", "ids", "v", "places")), strict=True):
                if dims not in tables:
                    continue
                ids = np.frombuffer(raw[0], "<i8")
                lists = Lists(ids, np.frombuffer(raw[1], "<i8").reshape(len(ids), dims), np.frombuffer(raw[2], "<i4").reshape(dims, len(ids)))
                for query_id, query in zip(tables[dims][0].tolist(), tables[dims][1], strict=True):
                    old = best.get((query_id, dims), (np.empty(0, np.int64), np.empty(0, np.int64)))
                    least = float(old[1].min()) if len(old[1]) == k else -np.inf
                    rows, scores = lists.best(query, query_id, k, least - abs(least) * 1e-12 if np.isfinite(least) else least)
                    vec, score = np.append(old[0], lists.ids[rows]), np.append(old[1], scores)
                    keep = np.lexsort((vec, -score))[:k]
                    best[query_id, dims] = vec[keep], score[keep]
        found = [(q, v, s) for (q, _), (vec, score) in best.items() for v, s in zip(vec.tolist(), score.tolist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return packed.mapInArrow(sh.frugal(run), "query_id bigint, vec_id bigint, score bigint")
