"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch

#: Tasks to which the rows of one key are dealt.
PARTS = 8


def dealt_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (a row for each ``key``) by ``key``. The rows of a key are
    dealt to ``PARTS`` tasks by a hash of the whole row, and each has the key's row of ``one``,
    so a key with a large share of all rows does not wait for one task."""
    dealt = many.withColumn("part", F.pmod(F.xxhash64(*many.columns), F.lit(PARTS)).cast("int"))
    copies = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(copies, [key, "part"], how).drop("part")


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component: its smallest node.

    Each round replaces every edge by edges to a neighbourhood minimum, first over larger
    neighbours, then over smaller ones, until only stars to the minima are left
    (logarithmically many rounds). Neighbourhood minima are plain aggregates with partial
    sums, the way back deals a node's edges to several tasks, so one huge star is no one
    task's work. Each round is written to the shared folder. Null ends are ignored; an
    empty table gives an empty one."""
    edges = edges.where("u is not null and v is not null and u <> v")
    cur = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = None
    for i in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = dealt_join(both, low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        seen = Observation()
        cur = scratch.table(small.select("e.u", "e.v").where("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        if state == (state := (seen.get["n"], seen.get["h"])):
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())
