"""Operator 4: mixing sources to target weights, in DataFrame functions only.

Every source is a stream of words (its documents one after the other in a hashed order)
packed into blocks of a fixed length. Targets are the weights' shares of the budget,
stopped at a multiple of the source's size (water-filling). A source's target gives its
number of slots. Every slot of an output shard draws its source with the targets' odds, so
a shard's counts of slots by source are a multinomial draw. Over all shards a draw misses
a source's number by about its square root; the slots that a source draws beyond its
number, about one in a hundred, go to the sources that drew too few, so targets and limits
hold exactly. A slot's running number in its source goes through the source's own
pseudorandom permutation of its blocks, a fresh one for every pass, and blocks are joined
by index. Permutations are swap-or-not ciphers: exact on any domain, computed per row.

A source that holds a third of all documents is no task of its own: word offsets are sums
over hashed buckets of a source and running sums inside a bucket; slots are numbered
inside their shard.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .spans import let

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order (null last), repeating; share of all words; limit per source.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Words of a block; a source has at least so many blocks (smaller sources get shorter ones); slots of an output shard; slots that a task makes.
BLOCK, LEAST_BLOCKS, SHARD, TASK = 128, 64, 65_536, 100_000
#: Up to so many sources, the table of them (64 bytes each) is sent to all executors; beyond, it is joined by merging.
FEW_SOURCES = 10_000
#: Buckets of a source for running sums, at least.
BUCKETS = 1024
ROUNDS = 24


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Place of ``x`` in a pseudorandom permutation of 0..n-1 chosen by ``key``: swap-or-not
    (Hoang, Morris, Rogaway 2012), every round a bijection."""

    def turn(at: Column, i: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(*key, i), n) - at, n)
        return F.when(F.xxhash64(*key, F.greatest(at, mate), i).bitwiseAND(F.lit(1).cast("long")) == 1, mate).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), turn)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source_key, size, tie) of every row; ``tie`` tells rows of one doc_id apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("source_key"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(*[F.col(c) for c in sorted(docs.columns)]).alias("tie"),
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source_key, source_size, target) for (source_key, source_size), one row per source.

    The budget is ``share`` times all sizes. With sources ordered by cap over weight, a
    source is capped while the level that the ones before it leave reaches its own."""
    every = Window.orderBy("source_key")
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    left = lambda c: F.sum(c).over(whole) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left("weight"))
    s = s.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    s = s.withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "source_key"))).over(whole))
    return s.select("source_key", "source_size", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def located(points: DataFrame, at: str, spans: DataFrame, total: int, n_spans: int) -> DataFrame:
    """``points`` with the row of ``spans(low, size, ...)`` whose low..low+size-1 holds the
    point's ``at``; spans do not overlap and lie in 0..total-1. An equi-join on cells, of
    which there are several for each span, so a point meets few spans."""
    width = max(1, total // max(1024, 4 * n_spans))
    cell = lambda c: F.floor(c / width).cast("long")
    ends = spans.where("size > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("low") + F.col("size") - 1))))
    ends = F.broadcast(ends) if n_spans <= FEW_SOURCES else ends.hint("merge")
    return points.withColumn("cell", cell(F.col(at))).join(ends, "cell").where((F.col(at) >= F.col("low")) & (F.col(at) < F.col("low") + F.col("size"))).drop("cell")


class Mix:
    """The mix of ``docs(doc_id, source, text)``; tables are lazy.

    Blocks and slots meet by a merge join: both grow with the documents."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK):
        spark = docs.sparkSession
        scratch = Scratch(spark, "mix")
        buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = scratch.table(sized(docs), "sizes").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
        part = scratch.table(rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("n")), "buckets")
        plan = targets(part.groupBy("source_key").agg(F.sum("n").alias("source_size")), weights, share, most)
        length = F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / LEAST_BLOCKS))).cast("long")
        plan = plan.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
        plan = plan.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
        every = Window.orderBy("source_key")
        plan = plan.withColumn("first", F.sum("slots").over(every) - F.col("slots")).withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(1))))
        #: One row per source.
        self.plan = scratch.table(plan, "plan")
        row = self.plan.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
        self.n_sources, self.n_slots, self.scratch = row[0], row[1], scratch
        self.counted: DataFrame | None = None
        self.balanced: DataFrame | None = None
        within = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = part.select("source_key", "bucket", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before"))
        starts = starts.join(self.plan.select("source_key", "source_size", "target", "length"), "source_key")
        running = Window.partitionBy("source_key", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
        placed = rows.withColumn("start", F.sum("size").over(running) - F.col("size")).join(starts, ["source_key", "bucket"])
        #: One row per document: where its words stand in its source.
        self.placed = placed.select("doc_id", "tie", "source_key", "size", "source_size", "target", "length", (F.col("start") + F.col("before")).alias("start"))

    def draws(self) -> DataFrame:
        """(shard, slot, source_key): every slot of the output with the source it draws."""
        tasks = max(int(self.plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(self.n_slots / TASK))
        g = self.plan.sparkSession.range(0, self.n_slots, 1, tasks)
        g = g.select(F.floor(F.col("id") / SHARD).alias("shard"), F.pmod("id", F.lit(SHARD)).alias("slot"), F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(max(1, self.n_slots))).alias("at"))
        odds = self.plan.select("source_key", F.col("first").alias("low"), F.col("slots").alias("size"))
        return located(g, "at", odds, self.n_slots, self.n_sources).select("shard", "slot", "source_key")

    def shard_counts(self) -> DataFrame:
        """(shard, source_key, n): the multinomial draw of source counts per output shard."""
        if self.counted is None:
            self.counted = self.scratch.table(self.draws().groupBy("shard", "source_key").agg(F.count("*").alias("n")), "counts")
        return self.counted

    def balance(self) -> DataFrame:
        """One row per source: how many slots it drew and how many are its own, what it drew
        beyond them or short of them, and the sums of both over the sources before it."""
        if self.balanced is None:
            drawn = self.shard_counts().groupBy("source_key").agg(F.sum("n").alias("drawn"))
            before = lambda c: F.sum(c).over(Window.orderBy("source_key")) - F.col(c)
            both = self.plan.select("source_key", "slots", "blocks").join(drawn, "source_key", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
            both = both.withColumn("over", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))).withColumn("short", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)))
            self.balanced = self.scratch.table(both.withColumn("over_before", before("over")).withColumn("short_before", before("short")), "balance")
        return self.balanced

    def slots(self) -> DataFrame:
        """(source_key, block, pass, shard, slot): one row per slot of the output."""
        counts, both = self.shard_counts(), self.balance()
        shards = Window.partitionBy("source_key").orderBy(F.xxhash64("shard"), "shard").rowsBetween(Window.unboundedPreceding, -1)
        begins = counts.select("shard", "source_key", F.coalesce(F.sum("n").over(shards), F.lit(0)).alias("begin"))
        rank = F.row_number().over(Window.partitionBy("shard", "source_key").orderBy("slot")) - 1
        s = self.draws().withColumn("rank", rank).join(begins.hint("merge"), ["shard", "source_key"])
        facts = both.select("source_key", "slots", "blocks", "over_before")
        s = s.join(F.broadcast(facts) if self.n_sources <= FEW_SOURCES else facts, "source_key").withColumn("r", F.col("begin") + F.col("rank"))
        own = s.where("r < slots").select("shard", "slot", "source_key", "blocks", "r")
        surplus = s.where("r >= slots").select("shard", "slot", (F.col("over_before") + F.col("r") - F.col("slots")).alias("o"))
        short = both.select("source_key", "blocks", "drawn", F.col("short_before").alias("low"), F.col("short").alias("size"))
        given = located(surplus, "o", short, max(1, self.n_slots // 64), self.n_sources).select("shard", "slot", "source_key", "blocks", (F.col("drawn") + F.col("o") - F.col("low")).alias("r"))
        p = own.unionByName(given).withColumn("pass", F.floor(F.col("r") / F.col("blocks")))
        return p.select("source_key", permuted(F.pmod("r", "blocks"), F.col("blocks"), F.col("source_key"), F.col("pass")).alias("block"), "pass", "shard", "slot")

    def pieces(self) -> DataFrame:
        """(doc_id, tie, source_key, start, size, block, from_word, n_words): documents cut
        at block ends; words count from the document's own first."""
        end = F.col("start") + F.col("size")
        p = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((end - 1) / F.col("length")))))
        low, high = F.greatest(F.col("start"), F.col("block") * F.col("length")), F.least(end, (F.col("block") + 1) * F.col("length"))
        return p.withColumn("from_word", low - F.col("start")).withColumn("n_words", high - low)

    def output(self, how: str = "inner") -> DataFrame:
        """The mixed corpus: a row for every piece of a document in every slot that its block
        fills, blocks joined by index. With ``how="left"`` pieces that fill no slot too."""
        return self.pieces().join(self.slots().hint("merge"), ["source_key", "block"], how)

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every row of the documents.

        Null texts and texts without words have size 0 and nothing taken; null sources are
        a source of their own, last in order; repeated rows are rows of their own."""
        key = ["doc_id", "size", "source_size", "target", "source_key", "start"]
        some = self.output("left").groupBy(*key).agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("n_words")).otherwise(0)).alias("taken"))
        none = self.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        out = ["doc_id", "size", "source_size", "target", "taken"]
        return some.select(out).unionAll(none.select(out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The mix as documents with the columns of ``docs``: a row for every document and pass
    over its source, with the words of its blocks that fill slots in that pass, in the
    document's order. A document that is drawn whole keeps its text as it is; of one drawn
    in part the drawn words are joined by spaces; ``n_chars`` (if there) is the new length.
    Documents without words are not drawn. Rows that agree in all columns are drawn
    separately. A null doc_id is a document's like any other."""
    mix = Mix(docs, **options)
    key = ["doc_id", "tie", "source_key", "start", "size", "pass"]
    drawn = mix.output().groupBy(*key).agg(F.sum("n_words").alias("n"), F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("cuts"))
    own = docs.withColumn("tie", F.xxhash64(*[F.col(c) for c in sorted(docs.columns)])).dropDuplicates(["doc_id", "tie"])
    rows = own.alias("d").hint("merge").join(drawn.alias("m"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & (F.col("d.tie") == F.col("m.tie")))
    bound = F.struct(F.regexp_extract_all("d.text", F.lit(WORDS), F.lit(0)).alias("words"), F.col("m.cuts").alias("cuts"))
    some = let(bound, lambda x: F.array_join(F.flatten(F.transform(x["cuts"], lambda c: F.slice(x["words"], (c["from_word"] + 1).cast("int"), c["n_words"].cast("int")))), " "))
    text = F.when(F.col("m.n") == F.col("m.size"), F.col("d.text")).otherwise(some)
    out = rows.select(*[text.alias("text") if c == "text" else F.col(f"d.{c}") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
