"""Operator 9: exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Queries are broadcast in groups of a fixed size; candidates stay in their tasks, cut into blocks of similar rows with a
sorted list per dimension each. What a row not read yet can reach follows from the next values of the lists, so the
depth at which a query can stop is known before any row is looked up: a block whose first values can't reach the
query's k-th score so far is passed over, of others the rows above that depth are looked up and scored exactly. The
k-th score starts from a sample of rows and goes on from block to block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectio.llm.common import partitions, record, written

#: Rows of a block, blocks that a task holds and orders by similarity, depth of the first look into the lists.
BLOCK, HELD_BLOCKS, DEPTH = 4096, 8, 8
#: Queries scored at once, bytes of queries in a broadcast, rows that the first k-th scores come from, rows that others are likened to.
QUERIES, QUERY_BYTES, SAMPLE, PIVOTS = 512, 64 << 20, 1024, 256
#: Bytes of candidates in a task.
TASK_BYTES = 64 << 20


def _in_range(score: np.ndarray) -> np.ndarray:
    """Scores past the range of a long at its ends; doubles here are always inside."""
    return np.minimum(np.maximum(score, -(2**63)), 2**63 - 1) if score.dtype == object else score


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(float)).max(initial=0))


class Lists:
    """Per-dimension lists of one block of candidates, ascending by value; x holds exact integers, as floats or as objects."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.value = np.take_along_axis(x, self.order, axis=0)
        self.depths = [0]
        while (d := 4 * self.depths[-1] or DEPTH) * x.shape[1] < len(ids):
            self.depths.append(d)

    def bound(self, q: np.ndarray, depth: int) -> np.ndarray:
        """What a row below `depth` entries of each query's lists can reach."""
        zero = np.zeros(1, q.dtype)
        return _in_range(np.maximum(q, zero) @ self.value[len(self.ids) - 1 - depth] + np.minimum(q, zero) @ self.value[depth])

    def search(self, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, score, id) of every row that can be among a query's k best, and how many rows were looked up.

        kth: a score that the k-th best of each query has at least. A row of equal score can still win by its id.
        """
        stop = np.full(len(q), len(self.depths))
        for i in range(len(self.depths) - 1, -1, -1):
            stop[(self.bound(q, self.depths[i]) < kth).astype(bool)] = i
        found, looked = [], 0
        for j in np.flatnonzero((stop > 0) & (stop < len(self.depths))):
            d, use = self.depths[stop[j]], np.flatnonzero(q[j])
            up = (q[j, use] > 0).astype(bool)
            rows = np.unique(np.r_[self.order[len(self.ids) - d :, use[up]].ravel(), self.order[:d, use[~up]].ravel()])
            score = _in_range(self.x[rows] @ q[j])
            hit = (score >= kth[j]).astype(bool) & (self.ids[rows] != own[j])
            looked += len(rows)
            found.append((np.full(hit.sum(), j), score[hit], self.ids[rows[hit]]))
        whole = np.flatnonzero(stop == len(self.depths))
        for i in range(0, len(whole), QUERIES):  # the lists would be read to their ends
            j = whole[i : i + QUERIES]
            score = _in_range(self.x @ q[j].T)
            looked += score.size
            fit = self.ids[:, None] != own[j]
            at_least = (score >= kth[j]).astype(bool) & fit
            for c in np.flatnonzero(kth[j] == -np.inf):
                some = np.flatnonzero(fit[:, c])
                if len(some) > k:
                    s = score[some, c]
                    at_least[:, c] &= (score[:, c] >= np.sort(s)[len(s) - k]).astype(bool)
            r, c = np.nonzero(at_least)
            found.append((j[c], score[r, c], self.ids[r]))
        if not found:
            return np.zeros(0, int), np.zeros(0, q.dtype), np.zeros(0, np.int64), looked
        return *(np.concatenate(x) for x in zip(*found, strict=True)), looked


class Best:
    """The k best rows of each query so far."""

    def __init__(self, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int):
        self.q, self.own, self.kth, self.k = q, own, kth, k
        self.query, self.score, self.id = np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)
        self.looked, self.most = 0, _largest(q)

    def see(self, ids: np.ndarray, x: np.ndarray, block: int) -> None:
        """Rows of any number: those alike, by the likest of some queries, form blocks; the most promising block comes first."""
        near = (x.astype(float) @ self.q[:PIVOTS].T.astype(float)).argmax(1)
        by = np.argsort(near, kind="stable")
        ends = np.flatnonzero(np.r_[near[by][1:] != near[by][:-1], True]) + 1
        blocks = []
        for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True):
            for k in range(i, j, block):
                at = by[k : min(j, k + block)]
                # below 2**53 doubles are exact integers; larger values are Python's
                exact = x.shape[1] * _largest(x[at]) * self.most < 2**52
                blocks.append((exact, Lists(ids[at], x[at].astype(float if exact else object))))
        blocks.sort(key=lambda b: -float(np.abs(b[1].value[[0, -1]]).sum()))
        for exact, lists in blocks:
            query, score, row, looked = lists.search(self.q.astype(float if exact else object), self.own, self.kth, self.k)
            self.looked += looked
            if not len(query):
                continue
            if not exact and self.score.dtype != object:
                self.score, self.kth = self.score.astype(np.int64).astype(object), np.asarray([x if x == -np.inf else int(x) for x in self.kth], object)
            query, row = np.r_[self.query, query], np.r_[self.id, row]
            score = np.r_[self.score, score.astype(np.int64).astype(object) if exact and self.score.dtype == object else score]
            by = np.lexsort((row, -score, query))
            query, score, row = query[by], score[by], row[by]
            first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
            keep = rank < self.k
            full = rank == self.k - 1
            self.query, self.score, self.id = query[keep], score[keep], row[keep]
            self.kth[query[full]] = np.maximum(self.kth[query[full]], score[full])


def first_scores(q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best has at least: its k-th best among a sample of the queries, which are rows too."""
    out, some = np.full(len(q), -np.inf), q[:SAMPLE].astype(float)
    if len(some) <= k or q.shape[1] * _largest(q) ** 2 >= 2**52:
        return out
    for i in range(0, len(q), QUERIES):
        score = q[i : i + QUERIES].astype(float) @ some.T
        score[own[i : i + QUERIES, None] == own[None, :SAMPLE]] = -np.inf
        out[i : i + QUERIES] = np.partition(score, len(some) - k, axis=1)[:, len(some) - k]
    return out


def _lists(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, rows) of the lists of each length."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    begin = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, flat[begin[at, None] + np.arange(n)]


def top_k(vectors: DataFrame, queries, k: int = 10, scale: int = 1024, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to the smaller vec_id.

    queries: a predicate Column over vec_id; candidates are all rows but the query's own id. A component x counts as
    floor(scale * x). Null vectors, vectors with null or non-finite components and null ids take no part; queries meet
    only candidates with as many components; empty vectors are left out. Rows of a repeated vec_id are candidates each;
    as a query such an id counts once, with the least of its vectors. A score past the range of a long is the range's end.
    An empty table gives no rows. Other columns are ignored.

    Queries go to the candidates in groups of at most query_bytes, one group after the other, so that driver and tasks
    hold one group whatever their number; each passes the candidates once. A task sends on k rows a query, which are
    merged by rank.
    """
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    ints = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    asked = written(ints.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    size = 8 * F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))
    groups = max(1, -(-asked.agg(size.alias("b")).first().b // query_bytes))
    candidates = ints.repartition(max(partitions(spark), -(-ints.agg(size.alias("b")).first().b // TASK_BYTES)))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def of_group(g: int) -> DataFrame:
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).orderBy("vec_id").toArrow()
        ids, asks = some.column("vec_id").to_numpy(), {}
        for at, x in _lists(some.column("v").combine_chunks()) if len(ids) else ():
            asks[x.shape[1]] = (x, ids[at], first_scores(x, ids[at], k))
        shared = spark.sparkContext.broadcast(asks)

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {n: Best(x, own, kth.copy(), k) for n, (x, own, kth) in shared.value.items()}
            held: dict[int, list] = {}
            for b in rows:
                every = b.column(0).to_numpy()
                for at, x in _lists(b.column(1)) if b.num_rows else ():
                    n = x.shape[1]
                    if n not in best:
                        continue
                    held.setdefault(n, []).append((every[at], x))
                    if sum(len(i) for i, _ in held[n]) >= HELD_BLOCKS * block:
                        best[n].see(*(np.concatenate(c) for c in zip(*held.pop(n), strict=True)), block)
            for n, rest in held.items():
                best[n].see(*(np.concatenate(c) for c in zip(*rest, strict=True)), block)
            for one in best.values():
                yield record(schema, one.own[one.query], one.id, [int(s) for s in one.score])

        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        found = candidates.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(w))
        found = found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if groups > 1:  # k rows a query are kept of a group, and nothing of its vectors
            found = written(found)
            shared.destroy()
        return found

    return functools.reduce(DataFrame.unionByName, [of_group(g) for g in range(groups)])
