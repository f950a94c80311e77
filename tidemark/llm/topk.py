"""Operator 9: exact top-k inner products by no-random-access aggregation.

Rows are taken in blocks. For a block every dimension has its list of rows, sorted by
value; a query reads each list sequentially from its own end (from the top where its
component is positive, from the bottom where it is negative), all lists to the same
depth. What has been read of a row gives, with the lists' current and last entries for
the rest, an upper and a lower bound of its score; no list is read anywhere else. Reading
goes on until few rows' upper bounds still reach the k-th lower bound (``LEFT`` for each
wanted one, or a ``SHARE``-th of the block), however deep that is; the scores of these are
then resolved exactly. Bounds of many queries are matrix products over what is read. The
k-th best score so far carries over to the task's next block. Blocks' answers are merged
by a ranking per query.

Queries are a stated set; they are sent in blocks of at most ``QUERIES`` vectors, one
block after the other, each freed before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a row block, and of a block of queries (bounded by what executors hold at a time).
ROWS, QUERIES = 8192, 20_000
#: Depths of the lists, as shares, at which bounds are compared; candidates for each wanted row, or share of the
#: block, at which reading stops; queries that are compared together.
DEPTHS = (0.4, 0.9, 1.0)
LEFT, SHARE, TOGETHER = 8, 64, 256
FOUND = "query_id long, vec_id long, score long"


def quantised(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and floor(256 * x) of the vectors without null or non-finite components."""
    ids, out = [], []
    col = batch.column(1)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten()
    bad = np.asarray(flat.is_null())
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    bad = bad | ~np.isfinite(values)
    at = np.append(0, np.cumsum(np.asarray(col.value_lengths().fill_null(0))))
    wrong = np.append(0, np.cumsum(bad))
    null = np.asarray(col.is_null())
    for i, v in enumerate(batch.column(0).to_pylist()):
        if not null[i] and v is not None and wrong[at[i + 1]] == wrong[at[i]]:
            ids.append(v)
            out.append(np.floor(values[at[i] : at[i + 1]] * 256.0))
    return np.array(ids, np.int64), out


def matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Lists:
    """A block of rows as one sorted list per dimension, readable from either end."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        up = np.argsort(x, axis=0, kind="stable")
        #: The lists' values, and every row's place in each list.
        self.sorted, self.place = np.take_along_axis(x, up, 0), np.argsort(up, axis=0, kind="stable")
        self.biggest = float(np.abs(x).max(initial=0.0))
        self.depths: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def read(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries of all rows that are read at depth ``end`` from the top and from the
        bottom of each list (0 where not), and a 1 for each that is not."""
        if end not in self.depths:
            n = len(self.ids)
            read = np.hstack([self.place >= n - end, self.place < end])
            self.depths[end] = np.where(read, np.hstack([self.x, self.x]), 0.0).T, (~read).astype(np.float64).T
        return self.depths[end]

    def top(self, queries: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows that may be among the k best of this block with at least
        ``floor``, and their exact scores."""
        out: list[tuple[np.ndarray, np.ndarray]] = [(self.ids, self.ids)] * len(queries)
        large = np.abs(q).max(axis=1, initial=0.0) * self.biggest * max(1, q.shape[1]) >= 2**52
        for i in np.flatnonzero(large).tolist():  # doubles do not hold such scores: read all
            rows = np.flatnonzero(self.ids != queries[i])
            out[i] = rows, (self.x[rows].astype(np.int64) * q[i].astype(np.int64)).sum(1)
        some = np.flatnonzero(~large)
        for at in range(0, len(some), TOGETHER):
            part = some[at : at + TOGETHER]
            for i, row in zip(part.tolist(), self.candidates(queries[part], q[part], k, floor[part]), strict=True):
                rows = np.flatnonzero(row)
                out[i] = rows, (self.x[rows] @ q[i]).astype(np.int64)
        return out

    def candidates(self, queries: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
        """queries x rows: which rows' upper bounds reach the k-th lower bound. A list is read
        from the top for queries above zero in its dimension, from the bottom for others."""
        n = len(self.ids)
        pos, neg = np.maximum(q, 0), np.minimum(q, 0)
        both = np.hstack([pos, neg])
        least = np.hstack([pos * self.sorted[0], neg * self.sorted[-1]])  # of what is not read yet
        own = queries[:, None] == self.ids[None, :]
        may = ~own
        todo = np.arange(len(q))
        for share in DEPTHS:
            end = ceil(share * n)
            entries, unread = self.read(end)
            most = np.hstack([pos * self.sorted[n - end], neg * self.sorted[end - 1]])
            known = both[todo] @ entries
            low = known + least[todo] @ unread
            low[own[todo]] = -np.inf
            kth = np.maximum(floor[todo], np.partition(low, n - k, axis=1)[:, n - k]) if n >= k else floor[todo]
            may[todo] &= known + most[todo] @ unread >= kth[:, None]
            todo = todo[may[todo].sum(1) > max(LEFT * k, n // SHARE)]
            if not len(todo):
                break
        return may


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries(vec_id, embedding)``
    the ``k`` rows of ``vectors`` with the highest integer inner products, ties to the
    smaller vec_id, rank from 1.

    Components count as floor(256 * x). Rows with the query's vec_id are no candidates.
    A vector that is null, has a null id, or holds a null or non-finite component takes
    no part; a shorter vector counts as filled up with zeros. A vec_id that repeats
    among the queries is asked once, with its smallest vector; rows that repeat a vec_id
    are each reported. Fewer than k candidates: all."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_blocks = ceil(asked.count() / (QUERIES / 2)) or 1

    def compared(b: int) -> tuple[DataFrame, Broadcast]:
        mine = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b)
        ids, qs = quantised(mine.toArrow())  # at most about QUERIES vectors: see n_blocks
        block = spark.sparkContext.broadcast((ids, matrix(qs, max((len(q) for q in qs), default=0))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = block.value
            held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)

            def search(ids: np.ndarray, vecs: list[np.ndarray]) -> None:
                dims = max(q.shape[1], max((len(v) for v in vecs), default=0))
                lists = Lists(ids, matrix(vecs, dims))
                wide = np.zeros((len(qids), dims))
                wide[:, : q.shape[1]] = q
                floor = np.array([float(h[1][-1]) if len(h[1]) == k else -np.inf for h in held])
                for i, (r, s) in enumerate(lists.top(qids, wide, k, floor)):
                    held[i] = best(np.append(held[i][0], ids[r]), np.append(held[i][1], s), k)

            wait_ids, wait = [], []
            for batch in batches:
                new, vecs = quantised(batch)
                wait_ids += new.tolist()
                wait += vecs
                while len(wait) >= ROWS:
                    search(np.array(wait_ids[:ROWS], np.int64), wait[:ROWS])
                    wait_ids, wait = wait_ids[ROWS:], wait[ROWS:]
            if wait:
                search(np.array(wait_ids, np.int64), wait)
            size = [len(h[0]) for h in held]
            if sum(size):
                yield pa.record_batch([pa.array(np.repeat(qids, size)), pa.array(np.concatenate([h[0] for h in held])), pa.array(np.concatenate([h[1] for h in held]))], names=["query_id", "vec_id", "score"])

        return rows.mapInArrow(scan, FOUND), block

    if n_blocks == 1:
        found = [compared(0)[0]]
    else:
        scratch, found = Scratch(spark, "top-k"), []
        for b in range(n_blocks):
            df, block = compared(b)
            found.append(scratch.table(df, f"block-{b}"))
            block.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
