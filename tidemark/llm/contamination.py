"""Operator 1: benchmark decontamination by size-partitioned containment MinHash.

Containment of a small item in a large document is not a Jaccard problem: the MinHash
of the document says next to nothing about thirty of its twenty thousand shingles. The
sketch is therefore taken of the small side only (containment MinHash): the ``SAMPLE``
smallest hash values of an item are a uniform sample without replacement of its
shingles, and the share of them that the document's set holds estimates the containment
however long the document is. The index holds the samples alone. Items are partitioned by
size (powers of two); a partition has the number of sample hits from which a document is
a candidate and the least size of a document that can hold one of its items, so a document
is compared only with the partitions that it can contain. Candidates are verified on the
item's full set, by hashes independent of those in the index.

The items are a stated query set. They are read in blocks of about ``BLOCK`` shingles
(a bound on what is sent to executors), one block after the other: each is compared with
all documents in one scan without any shuffle and freed before the next is read. An item is
never cut, so one with more shingles than ``BLOCK`` makes a block of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U, as_long, list_array, mix, row_bounds, slices, text_shingles, utf8_text

#: Shingles of items held by an executor at a time: 16 MB of full sets, and their samples.
BLOCK = 2_000_000
#: MinHash samples of an item: all shingles of items with up to this many.
SAMPLE = 32
#: Probability that an item at the threshold is missed.
MISS = 1e-9
PAIRS = "doc_id long, item_id long, n_common long, n_item long"


def least_hits(k: int, size: int, containment: float) -> int:
    """The most sample hits that an item of ``size`` shingles at the threshold reaches
    with probability 1 - MISS (hypergeometric: k of size drawn, ceil(c * size) shared)."""
    shared = ceil(containment * size - 1e-9)
    if k >= size:
        return shared
    below = 0.0
    for hits in range(max(0, k - (size - shared)), k + 1):
        below += comb(shared, hits) * comb(size - shared, k - hits) / comb(size, k)
        if below > MISS:
            return hits
    return k


class Block:
    """A block of items: an index of their samples in size partitions, and their full sets."""

    def __init__(self, ids: list[int | None], samples: list[np.ndarray], sets: list[np.ndarray], containment: float):
        self.ids = pa.array(ids, pa.int64())
        self.size = np.array([len(s) for s in sets], np.int64)
        self.need = np.array([ceil(containment * len(s) - 1e-9) for s in sets], np.int64)
        self.sets = [np.sort(s) for s in sets]  # by the second hash
        kept = [s[np.argsort(mix(s))[:SAMPLE]] for s in samples]  # the smallest values of another hash
        item = np.repeat(np.arange(len(kept)), [len(s) for s in kept])
        values = np.concatenate(kept) if kept else np.zeros(0, U)
        order = np.argsort(values, kind="stable")
        self.item = item[order]
        self.keys, first = np.unique(values[order], return_index=True)
        self.first = np.append(first, len(values))
        #: By item: its partition; by partition: hits that make a candidate, least size of a document.
        part = np.array([int(n).bit_length() for n in self.size], np.int64)
        self.hits, self.least = np.zeros(65, np.int64), np.zeros(65, np.int64)
        for p in np.unique(part):
            sizes = np.unique(self.size[part == p])
            self.hits[p] = min(least_hits(min(SAMPLE, int(n)), int(n), containment) for n in sizes)
            self.least[p] = ceil(containment * int(sizes[0]) - 1e-9)
        self.part = part

    def search(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, item, shared shingles) of what is contained in a slice of texts; only texts
        with a candidate are hashed a second time."""
        n_rows = len(offs) - 1
        sh, of = text_shingles(data, offs)
        if not len(self.keys) or not len(sh):
            return
        at = np.searchsorted(self.keys, sh)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == sh)
        if not len(hit):
            return
        bounds = row_bounds(of, n_rows)
        size = bounds[1:] - bounds[:-1]
        k = at[hit]
        many = self.first[k + 1] - self.first[k]
        row = np.repeat(of[hit], many)
        item = self.item[np.repeat(self.first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        fits = size[row] >= self.least[self.part[item]]
        cand, hits = np.unique(row[fits] * len(self.size) + item[fits], return_counts=True)
        row, item = cand // len(self.size), cand % len(self.size)
        likely = (hits >= self.hits[self.part[item]]) & (size[row] >= self.need[item])
        row, item = row[likely], item[likely]
        common = np.zeros(len(row), np.int64)
        new = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
        for a, b in zip(new, np.append(new[1:], len(row)) if len(row) else [], strict=True):
            x, y = offs[row[a]], offs[row[a] + 1]
            own = text_shingles(data[x:y], np.array([0, y - x]), (1,))[0]
            for i in range(a, b):
                want = self.sets[item[i]]
                place = np.minimum(np.searchsorted(own, want), len(own) - 1)
                common[i] = np.count_nonzero(own[place] == want)
        ok = common >= self.need[item]
        yield row[ok], item[ok], common[ok]


def item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in slices(batch):
            sh, full, of = text_shingles(data, offs, (0, 1))
            at = row_bounds(of, rows.num_rows)
            yield pa.record_batch([rows.column(0), list_array(as_long(sh), at), list_array(as_long(full), at)], names=["item_id", "sample", "items"])


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_common, n_item, containment): the documents that contain at
    least ``percent`` of an item's distinct five-word shingles.

    Whole texts count on both sides (lower-cased A-Z, split at ASCII white space). A
    text with fewer than five words is one shingle, its whole sequence, so a short item
    is found only as the whole of a document. Null and empty texts contain nothing and
    are contained nowhere. Rows that repeat in ``docs`` are reported once per row; items
    with the same text each. Null ids are reported as null. Other columns are not read."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8_text())
    sets = items.mapInArrow(item_sets, "item_id long, sample array<long>, items array<long>").where(F.size("items") > 0)
    total = sets.agg(F.sum(F.size("items"))).first()[0] or 0
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8_text())
    n_blocks = ceil(total / (BLOCK / 2)) or 1

    def compared(b: int) -> tuple[DataFrame, Broadcast]:
        mine = sets if n_blocks == 1 else sets.where(F.pmod(F.xxhash64("items"), F.lit(n_blocks)) == b)
        rows = mine.collect()  # at most about BLOCK shingles: see n_blocks
        longs = lambda c: [np.array(r[c], np.int64).view(U) for r in rows]
        block = spark.sparkContext.broadcast(Block([r[0] for r in rows], longs(1), longs(2), percent / 100))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offs in slices(batch):
                    for row, item, common in block.value.search(data, offs):
                        yield pa.record_batch([part.column(0).take(pa.array(row)), block.value.ids.take(pa.array(item)), pa.array(common), pa.array(block.value.size[item])], names=["doc_id", "item_id", "n_common", "n_item"])

        return text.mapInArrow(scan, PAIRS), block

    if n_blocks == 1:
        found = [compared(0)[0]]
    else:
        scratch, found = Scratch(spark, "leaks"), []
        for b in range(n_blocks):
            df, block = compared(b)
            found.append(scratch.table(df, f"block-{b}"))
            block.destroy()
    return reduce(DataFrame.unionAll, found).withColumn("containment", F.col("n_common") / F.col("n_item"))
