"""Regular expression matches with positions, and linear folds over arrays, in built-in
column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,text:string>>"
#: Elements that a fold appends to one array; longer arrays are folded block by block.
BLOCK = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often and in whatever lambda it
    is used (a projection's column may be inlined into the lambdas that mention it)."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], empty: str) -> Column:
    """``emit(state, item)`` for every item, with the ``state`` that ``step(state, item)``
    made of the items before it; ``empty`` is the result's type.

    Arrays are immutable and a fold that appends to one copies it, so it does so in blocks:
    the states at the blocks' begins come first, and time is linear in the items."""
    none = F.array().cast(empty)

    def inside(block: Column, state: Column) -> Column:
        return F.aggregate(block, F.struct(state.alias("state"), none.alias("out")), lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out")), lambda a: a["out"])

    def whole(arr: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / BLOCK).cast("int")), lambda i: F.slice(arr, i * BLOCK + 1, F.lit(BLOCK)))

        def joined(parts: Column) -> Column:
            first = F.struct(start.alias("state"), F.array(start).alias("states"))
            entered = F.aggregate(
                F.slice(parts, F.lit(1), F.size(parts) - 1),
                first,
                lambda a, block: let(F.aggregate(block, a["state"], step), lambda s: F.struct(s.alias("state"), F.concat(a["states"], F.array(s)).alias("states"))),
                lambda a: a["states"],
            )
            return F.flatten(F.zip_with(parts, entered, inside))

        return let(blocks, joined)

    return let(items, lambda arr: F.when(F.size(arr) > BLOCK, whole(arr)).when(F.size(arr) > 0, inside(arr, start)).otherwise(none))


def find_spans(text: Column, pattern: str, gate: str | None = None) -> Column:
    """array<struct<start, end, text>>: the leftmost non-overlapping matches of a pattern
    that matches no empty string; positions in code points, ends exclusive.

    Matches and what stands between them (the split parts) alternate, so positions are
    running sums of their lengths. Texts that a cheaper pattern ``gate`` does not match
    (by default the pattern itself) are not split."""
    between = F.split(text, pattern, -1)
    pairs = F.filter(
        F.zip_with(between, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, m: F.struct(F.length(b).alias("skip"), F.length(m).alias("size"), m.alias("text"))),
        lambda x: x["text"].isNotNull(),
    )
    walked = scan(
        pairs,
        F.lit(0),
        lambda at, x: at + x["skip"] + x["size"],
        lambda at, x: F.struct((at + x["skip"]).alias("start"), (at + x["skip"] + x["size"]).alias("end"), x["text"].alias("text")),
        SPANS,
    )
    return F.when(text.rlike(gate or pattern), walked).otherwise(F.array().cast(SPANS))
