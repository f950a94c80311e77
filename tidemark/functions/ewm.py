"""Exponentially weighted means: y[0] = x[0], y[t] = (1 - a) * y[t-1] + a * x[t]."""

from __future__ import annotations

from math import ceil, log

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an observation still weighs after a block.
FORGOTTEN = 1e-16
#: The largest weight of a value; sums of prices below 1e20 cannot overflow.
LARGEST = 1e285


def ewm(df: DataFrame, sources: dict[str, tuple[str, float, int]], key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds exponentially weighted means to ``df`` in O(rows), by window functions.

    ``sources``: name -> (column, alpha, least observations). Rows are cut into blocks so
    long that what stands before a block's predecessor is forgotten; inside a block the
    mean is a running sum of values over growing weights, and the ends of the two blocks
    before are carried in. Means whose weights stay below LARGEST share the longest block,
    so that usually all of them are one sort by block. The columns must be dense: leading
    nulls are skipped, later ones are not supported (see ``ewm_gapped``). All windows share
    one exchange by ``key``."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    number = {c: f"_n_{c}" for c in sorted({c for c, _, _ in sources.values()})}
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    df = df.withColumns({"_row": place, **{n: F.count(c).over(upto) - 1 for c, n in number.items()}})
    for size, names in _block_sizes({name: 1 - alpha for name, (_, alpha, _) in sources.items()}):
        df = _with_means(df, {name: sources[name] for name in names}, number, size, key, order)
    return df.drop("_row", *number.values())


def _block_sizes(keep: dict[str, float]) -> list[tuple[int, list[str]]]:
    """(rows of a block, names that use it): each name joins the shortest of the longer
    blocks that its weights allow."""
    own = {name: max(1, ceil(log(FORGOTTEN) / log(k))) if k > 0 else 1 for name, k in keep.items()}
    sizes: dict[int, list[str]] = {}
    for name in sorted(own, key=own.get, reverse=True):
        fits = [s for s in sizes if keep[name] <= 0 or s * -log(keep[name]) <= log(LARGEST)]
        sizes.setdefault(min(fits, default=own[name]), []).append(name)
    return list(sizes.items())


def _with_means(df: DataFrame, sources: dict[str, tuple[str, float, int]], number: dict[str, str], size: int, key: str, order: str) -> DataFrame:
    df = df.withColumn("_block", F.floor(F.col("_row") / size))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_block", order).rowsBetween(Window.unboundedPreceding, -1)  # the sort of ``inside`` serves
    i = F.pmod(F.col("_row"), F.lit(size))
    sums, ends, second, out = {}, {}, {}, {}
    for name, (c, alpha, least) in sources.items():
        keep, n = 1 - alpha, F.col(number[c])
        weight = F.when(n == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        s, e1, e2 = f"_s_{name}", f"_e_{name}", f"_f_{name}"
        if alpha >= 1:
            out[name] = F.when(n + 1 >= least, F.col(c))
            continue
        sums[s] = F.pow(F.lit(keep), i) * F.sum(weight * F.col(c) * F.pow(F.lit(keep), -i)).over(inside)
        ends[e1] = F.last(F.when(i == size - 1, F.col(s)), True).over(before)
        second[e2] = F.last(F.when(i == size - 1, F.col(s) + F.lit(keep**size) * F.coalesce(e1, F.lit(0.0))), True).over(before)
        out[name] = F.when(n + 1 >= least, F.col(s) + F.pow(F.lit(keep), i + 1) * F.coalesce(e2, F.lit(0.0)))
    for step in (sums, ends, second):
        df = df.withColumns(step) if step else df
    return df.withColumns(out).drop("_block", *sums, *ends, *second)


def ewm_gapped(df: DataFrame, column: str, alpha: float, least: int, name: str, key: str = "ticker", order: str = "date") -> DataFrame:
    """The same for columns with gaps: a null keeps the mean, and after g rows the next
    value is weighed against (1 - a)**g of it. One pandas group per key."""
    schema = df.withColumn(name, F.lit(0.0)).schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pdf[name] = pdf[column].astype(float).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        return pdf

    return df.groupBy(key).applyInPandas(one, schema)
