"""Column functions that the operators share: nulls, windows, ranks, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def by_calendar() -> WindowSpec:
    """All rows in order of date: for calendars, which are one partition's work."""
    return Window.orderBy("date")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any float column becomes null; nothing downstream meets a NaN."""
    fix = {c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(fix) if fix else df


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return a / F.nullif(b, F.lit(0.0))


def at_least(x: Column, low: float) -> Column:
    """x raised to ``low``; null stays null (``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def at_most(x: Column, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(high)))


def holds(condition: Column) -> Column:
    """A predicate that is false where it is null."""
    return F.coalesce(condition, F.lit(False))


def trailing(n: int, w: WindowSpec | None = None, shift: int = 0) -> WindowSpec:
    """The frame of the last n rows, ended ``shift`` rows before the current one."""
    return (w or by_ticker()).rowsBetween(-(n - 1) - shift, -shift)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, least: int | None = None, w: WindowSpec | None = None, shift: int = 0) -> Column:
    """``agg`` over the last n rows, null until ``least`` (n) of them are not null."""
    frame = trailing(n, w, shift)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def change(x: Column, periods: int, w: WindowSpec | None = None) -> Column:
    return divide(x, F.lag(x, periods).over(w or by_ticker())) - 1


def forward_filled(x: Column, limit: int, w: WindowSpec | None = None) -> Column:
    """The last non-null value at most ``limit`` rows back."""
    return F.last(x, True).over((w or by_ticker()).rowsBetween(-limit, 0))


def percent_rank_average(df: DataFrame, column: str, by: str = "date") -> Column:
    """Average rank over non-null values as a share of their count, times 100."""
    x = F.col(column)
    place = F.rank().over(Window.partitionBy(by).orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, column))
    return F.when(x.isNotNull(), (place + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(by)) * 100)


def min_max(x: Column, w: WindowSpec, invert: bool = False, constant: float | None = 0.5) -> Column:
    """Position of x between the window's least and largest value; ``constant`` where
    they are equal; null where x is null."""
    low, high = F.min(x).over(w), F.max(x).over(w)
    part = (high - x) if invert else (x - low)
    same = F.when(x.isNotNull(), F.lit(constant).cast("double"))
    return F.when(high == low, same).otherwise(divide(part, high - low))


# ------------------------------------------------------------------------------ dates


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in [start, end), no holidays."""

    def before(x: Column) -> Column:
        n = F.datediff(x, F.lit("1970-01-05").cast("date"))  # a Monday
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return (before(end) - before(start)).cast("int")


def business_dates(spark, start: str, end: str) -> DataFrame:  # noqa: ANN001
    """The weekdays from start to end, both included, in order."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return d.where(F.weekday("date") < 5)


def parse_date(x: Column) -> Column:
    """A date from text, null where there is none."""
    return F.coalesce(F.try_to_timestamp(x).cast("date"), F.try_to_timestamp(x, F.lit("dd-MM-yyyy")).cast("date"))


def since_months(df: DataFrame, months: int) -> DataFrame:
    """Rows of the last ``months`` months up to the largest date."""
    last = df.agg(F.max("date").alias("last_date"))
    return df.join(F.broadcast(last), F.col("date") > F.add_months("last_date", -months)).drop("last_date")  # one row is broadcast


# ------------------------------------------------------------------- runs and as-of


def run_lengths(df: DataFrame, label: str, order: WindowSpec) -> DataFrame:
    """``run_id`` (number of label changes so far) and ``in_run`` (place in the run)."""
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(order)) | (F.row_number().over(order) == 1)
    return df.withColumn("run_id", F.sum(changed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def as_of(left: DataFrame, right: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``left`` with the latest non-null ``right.value`` at or before its ``date`` (within ``by``).

    A tagged union and a running last value: one exchange by the keys, no range join.
    With no keys the union is one partition, which suits calendars only."""
    by = by or []
    cols = left.columns
    both = left.withColumn(value, F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    fill = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols if c not in ("date", *by)]
    other = right.select("date", *by, *fill, value, F.lit(0).alias("_side")).select(both.columns)
    w = Window.partitionBy(*by).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(other).withColumn(value, F.last(value, True).over(w)).where("_side = 1").drop("_side")
