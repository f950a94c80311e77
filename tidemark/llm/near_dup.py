"""Operator 7: near-duplicate groups by MinHash bands and odd sketches.

One scan computes, for every document, the size of its set of word shingles, a 128-bit
identity of that set (two independent hashes of its words), ``BANDS`` band values of ``ROWS`` MinHash values each, and an odd
sketch of all the MinHash values. Documents with the same set are one *node* from then
on. Bands bring nodes together; for two nodes in a band the XOR of their odd sketches is
counted, which bounds their similarity closely, and only pairs that may reach the
threshold are confirmed on the full sets.

A band bucket of n nodes is not expanded into n*n/2 pairs: each round compares every
node with one pivot of its bucket and merges what is confirmed into components; nodes of
one component need no comparison any more. What is left between different components of
a bucket is compared in full, so no link that the bands bring up is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import BASE, U, Scratch, as_long, list_array, mix, row_bounds, slices, text_shingles, utf8_text
from .graph import components, dealt_join

#: A pair at similarity 0.75 escapes all bands with probability (1 - 0.75**6)**50 < 6e-5, one at 0.8 with 3e-7.
ROWS, BANDS = 6, 50
#: Bits of the odd sketch.
SKETCH = 1024
#: Standard errors by which an estimate may fall short of the threshold before the pair is left unconfirmed.
SLACK = 4.0
#: Nodes are compared with pivots, in a sixth of the buckets each turn, until what is left between different components
#: is at most so many pairs for each node in a bucket, or pivots hardly link any more; that is then compared in full.
PARTS, PAIRS_A_ROW, MOST_TURNS = 6, 16, 8
#: Rows of a bucket that a task compares with the whole bucket.
CHUNK = 2_000
#: Ids of nodes to confirm that are sent to all executors (8 MB) so that texts need not move; more are joined.
BROADCAST_IDS = 500_000

_SEEDS = mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=U) * U(BASE))
_MULTIPLY, _ADD = _SEEDS[: ROWS * BANDS] | U(1), _SEEDS[ROWS * BANDS :]
SIGNATURES = "doc_id long, n_shingles long, k1 long, k2 long, buckets array<long>, sketch array<long>"


def signatures(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in slices(batch):
        n = rows.num_rows
        sh, other, of = text_shingles(data, offs, (0, 1))
        at = row_bounds(of, n)
        full = np.flatnonzero(at[1:] > at[:-1])
        start = at[:-1][full]
        k1, k2 = np.zeros(n, U), np.zeros(n, U)
        buckets = np.zeros((len(full), BANDS), U)
        odd = np.zeros((len(full), SKETCH // 64), U)
        if len(full):
            k1[full] = mix(np.add.reduceat(mix(sh ^ U(0x5BD1E995)), start))
            k2[full] = mix(np.add.reduceat(mix(other), start))
            line = np.arange(len(full))
            for b in range(BANDS):
                acc = np.full(len(full), b + 1, U)
                for r in range(b * ROWS, (b + 1) * ROWS):
                    x = sh * _MULTIPLY[r]
                    x += _ADD[r]
                    x ^= x >> U(32)
                    low = np.minimum.reduceat(x, start)
                    bit = mix(low + U(r + 1))
                    odd[line, (bit >> U(6)) % U(SKETCH // 64)] ^= U(1) << (bit & U(63))
                    acc = mix(acc * U(BASE) + low)
                buckets[:, b] = acc
        at_b, at_s = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        at_b[full + 1], at_s[full + 1] = BANDS, SKETCH // 64
        yield pa.record_batch(
            [rows.column(0), pa.array(at[1:] - at[:-1]), pa.array(as_long(k1)), pa.array(as_long(k2)), list_array(as_long(buckets.ravel()), np.cumsum(at_b)), list_array(as_long(odd.ravel()), np.cumsum(at_s))],
            names=["doc_id", "n_shingles", "k1", "k2", "buckets", "sketch"],
        )


def shingle_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Full sets for confirmation, by hashes independent of those that bands and sketches are made of."""
    for rows, data, offs in slices(batch):
        sh, of = text_shingles(data, offs, (1,))
        yield pa.record_batch([rows.column(0), list_array(as_long(sh), row_bounds(of, rows.num_rows))], names=["node", "items"])


def each(f):  # noqa: ANN001, ANN201
    return lambda batches: (out for b in batches for out in f(b))


def reaches(a: str, b: str, percent: int) -> Column:
    """Whether the odd sketches of two nodes and their sizes leave a similarity of
    ``percent`` possible (within ``SLACK`` standard errors)."""
    k, m, t = ROWS * BANDS, SKETCH, percent / 100
    words = [F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH // 64)]
    share = reduce(Column.__add__, words) / m
    differ = 2 * k * (1 - t)  # expected number of differing (sample, value) pairs at the threshold
    parity = (m * (1 - np.exp(-4 * differ / m)) / 4) ** 0.5 / np.exp(-2 * differ / m)
    spread = float(np.hypot(2 * (k * t * (1 - t)) ** 0.5, parity))
    most = 0.5 * (1 - float(np.exp(-2 * (differ + SLACK * spread) / m)))
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (100 * small >= percent * large) & (share <= most)


class Checker:
    """Confirms pairs of nodes and keeps the components."""

    def __init__(self, text: DataFrame, facts: DataFrame, scratch: Scratch, percent: int):
        self.text, self.facts, self.scratch, self.percent = text, facts, scratch, percent
        self.sets: DataFrame | None = None
        self.turn = self.pairs = 0

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The (node, pivot) pairs that sizes and sketches leave possible. Nodes are looked up
        first: rows are wide when they meet at their pivots, so AQE splits a pivot of very many."""
        pairs = pairs.where("node <> pivot").select("node", "pivot").distinct()
        a, b = self.facts.alias("a"), self.facts.alias("b")
        wide = pairs.join(a, "node").select(F.col("node").alias("u"), "pivot", "a.n_shingles", "a.sketch").alias("a")
        return wide.join(b, F.col("pivot") == F.col("b.node")).where(reaches("a", "b", self.percent)).select(F.col("u").alias("node"), "pivot")

    def apart(self, here: DataFrame) -> DataFrame:
        """(u, v): all links between different components of a bucket.

        Sets go only to rows that have any possible partner; the exact test is part of the
        join, so pairs that are no links are compared but never rows. A bucket's rows are
        split into chunks, each compared with the whole bucket in a task of its own."""
        t = self.turn = self.turn + 1
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        here = here.select("bucket", "node", "component", "n").join(self.facts, "node")

        def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
            part = df.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
            return part.alias("a"), df.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).alias("b")

        a, b = sides(here)
        may = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.component") != F.col("b.component")) & reaches("a", "b", self.percent)
        some = self.scratch.table(a.join(b, may, "left_semi").drop("chunk"), f"likely-{t}")
        self.read_sets(some.select("node").distinct(), t)
        a, b = sides(some.join(self.sets, "node"))
        common = F.size(F.array_intersect("a.items", "b.items")).cast("long")
        exact = 100 * common >= self.percent * (F.size("a.items") + F.size("b.items") - common)
        found = a.join(b, may & (F.col("a.node") < F.col("b.node")) & exact).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
        return self.scratch.table(found, f"links-{t}")

    def read_sets(self, need: DataFrame, t: int) -> None:
        """Adds the shingle sets of nodes that ``sets`` lacks."""
        if self.sets is not None:
            need = need.join(self.sets.select("node"), "node", "left_anti")
        seen = Observation()
        need = self.scratch.table(need.select(F.col("node").alias("doc_id")).observe(seen, F.count(F.lit(1)).alias("n")), f"need-{t}")
        need = F.broadcast(need) if seen.get["n"] <= BROADCAST_IDS else need  # else texts are shuffled by doc_id
        found = self.text.join(need, "doc_id", "left_semi").mapInArrow(each(shingle_sets), "node long, items array<long>")
        found = self.scratch.table(found, f"sets-{t}", compression="zstd")
        self.sets = found if self.sets is None else self.sets.union(found)

    def links(self, pairs: DataFrame) -> DataFrame:
        """(u, v): the (node, pivot) pairs whose full sets reach the threshold. Rows hold the
        node's set when they meet at their pivots (see ``likely``)."""
        t = self.turn = self.turn + 1
        seen = Observation()
        pairs = self.scratch.table(pairs.observe(seen, F.count(F.lit(1)).alias("n")), f"pairs-{t}")
        self.pairs = seen.get["n"]
        self.read_sets(pairs.select("node").union(pairs.select("pivot")).distinct(), t)
        both = pairs.join(self.sets.toDF("node", "items"), "node").join(self.sets.toDF("pivot", "items_p"), "pivot")
        both = both.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"), F.size(F.array_intersect("items", "items_p")).cast("long").alias("i"), (F.size("items") + F.size("items_p")).cast("long").alias("s"))
        return self.scratch.table(both.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * self.percent).select("u", "v"), f"links-{t}")

    def merge(self, links: DataFrame, labels: DataFrame | None) -> DataFrame:
        """(node, component) with ``links`` added to what ``labels`` has."""
        t = self.turn
        if labels is None:
            # A node meets at most one pivot a band: tie its pivots to the smallest of them, once for all its nodes.
            of = links.groupBy("v").agg(F.min("u").alias("m"), F.collect_set("u").alias("all"))
            of = self.scratch.table(of, f"pivots-{t}")
            ties = of.select(F.explode("all").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            return self.scratch.table(components(of.select(F.col("v").alias("u"), F.col("m").alias("v")).union(ties), self.scratch, f"cc-{t}"), f"labels-{t}")
        if links.isEmpty():
            return labels
        # Only ends of links are looked up, and a pivot of very many links is dealt to several tasks.
        of = lambda c: links.select(c).distinct().join(labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")), c)
        ends = dealt_join(dealt_join(links, of("u"), "u", "left"), of("v"), "v", "left").select("u", "v", F.coalesce("u_of", "u").alias("a"), F.coalesce("v_of", "v").alias("b"))
        joined = self.scratch.table(components(ends.select(F.col("a").alias("u"), F.col("b").alias("v")), self.scratch, f"cc-{t}"), f"joined-{t}")
        known = labels.union(ends.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("a").alias("component")), F.struct(F.col("v").alias("node"), F.col("b").alias("component")))).alias("x")).select("x.*")).groupBy("node").agg(F.min("component").alias("component"))
        moved = dealt_join(known, joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        return self.scratch.table(moved.select("node", F.coalesce("to", "component").alias("component")), f"labels-{t}")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct
    five-word shingles (lower-cased A-Z, split at ASCII white space; with fewer words the
    whole sequence is the one shingle); ``component_id`` is the smallest doc_id reachable.
    Null and empty texts have no shingles and link with nothing. Rows that repeat a
    doc_id count as one document. A row whose doc_id is null takes its group's component
    and is kept only if no doc_id is in the group. Other columns are not read."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8_text())
    sig = scratch.table(text.mapInArrow(each(signatures), SIGNATURES), "signatures", compression="zstd")

    nodes = scratch.table(
        sig.where("n_shingles > 0")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n_shingles"), F.min(F.struct("buckets", "sketch")).alias("x"))
        .select("k1", "k2", "node", "n_shingles", "x.buckets", "x.sketch"),
        "nodes",
        compression="zstd",
    )
    live = nodes.where("node is not null")
    facts = live.select("node", "n_shingles", "sketch")
    bands = live.select(F.explode("buckets").alias("bucket"), "node")
    pivots = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    bands = scratch.table(bands.join(pivots, "bucket").select("bucket", "node", "pivot", "n"), "bands")
    checked = Checker(text, facts, scratch, percent)

    labels = checked.merge(checked.links(checked.likely(bands.select("node", "pivot"))), None)
    here, few = bands.select("bucket", "node"), False
    for turn in range(1, MOST_TURNS + 1):
        here = here.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
        by_hash = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)), "node", "component")).alias("p")
        mixed = here.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), by_hash).where("low < high")
        here = scratch.table(here.join(mixed.select("bucket", "n", F.col("p.node").alias("pivot"), F.col("p.component").alias("of")), "bucket"), f"mixed-{turn}")
        same = here.groupBy("bucket", "n", "component").agg(F.count("*").alias("m")).groupBy("bucket", "n").agg(F.sum(F.col("m") * F.col("m")).alias("same"))
        rows, left = same.agg(F.sum("n"), F.sum(F.expr("(n * n - same) / 2"))).first()
        if not rows:
            break
        if left <= PAIRS_A_ROW * rows or turn == MOST_TURNS or few:
            labels = checked.merge(checked.apart(here), labels)
            break
        some = here.where((F.pmod(F.xxhash64("bucket"), F.lit(PARTS)) == turn % PARTS) & (F.col("component") != F.col("of")))
        links = checked.links(checked.likely(some.select("node", "pivot")))
        few = links.count() * 20 < checked.pairs
        labels = checked.merge(links, labels)
        here = here.select("bucket", "node")

    member = sig.select("doc_id", "n_shingles", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left").join(labels, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id"))
    out = member.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    return scratch.last(out, "result")
