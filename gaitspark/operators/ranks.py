"""Numbers, running totals and ranks of a whole table in a total order, without one task for all rows.

Rows are dealt into ranges of the order and sorted within each; what reaches the driver is one count for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A row's place, from monotonically_increasing_id: the range in the upper bits, the place within it in the lower.
PLACE_BITS = 33


def dealt(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df as a table with _range and _place: ranges follow the order, and so do the places in each of them. Rows that
    compare equal are spread over ranges by where they lie in the input, so that many equal rows aren't one range."""
    keys = [*order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, "ranges")
    return rows.withColumns({"_range": F.shiftright("_at", PLACE_BITS), "_place": F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_at")


def offsets(rows: DataFrame, total: Column) -> DataFrame:
    """(_range, _before): the sum of the ranges' totals before each; a row for each range."""
    sums = sorted((r["_range"], r["n"]) for r in rows.groupBy("_range").agg(total.alias("n")).collect())
    out, before = [], 0
    for k, n in sums:
        out.append((k, before))
        before += n
    return F.broadcast(rows.sparkSession.createDataFrame(out, "_range long, _before long"))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """df with a running number from 1 in the order; rows that compare equal are numbered in any order."""
    rows = dealt(df, order)
    out = rows.join(offsets(rows, F.count("*")), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1)
    return out.drop("_range", "_place", "_before")


def totals_before(df: DataFrame, order: Sequence[Column | str], value: str, name: str = "before") -> DataFrame:
    """df with the sum of an integer column over all rows before each in the order."""
    rows = dealt(df, order)
    own = F.sum(value).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    summed = rows.withColumn("_own", F.coalesce(own, F.lit(0)))
    return summed.join(offsets(rows, F.sum(value)), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_place", "_before", "_own")


def average_ranks(df: DataFrame, x: str, by: Sequence[str] = (), rows: Column | None = None, extra: Sequence[Column] = (), name: str = "rank") -> DataFrame:
    """(by, x, n, name, extra aggregates): each distinct value's number of rows (or sum of `rows`) and rank from 1 within
    its group, ties on their average. NULLs come first. A group may be the whole table: only distinct values are ordered,
    in ranges."""
    values = df.groupBy(*by, x).agg((F.count("*") if rows is None else F.sum(rows)).alias("n"), *extra)
    placed = totals_before(values, [F.asc_nulls_first(c) for c in (*by, x)], "n", "_before_all")
    if by:
        first = placed.groupBy(*[F.struct(c).alias(f"_{i}") for i, c in enumerate(by)]).agg(F.min("_before_all").alias("_first"))
        same = F.lit(True)
        for i, c in enumerate(by):
            same = (F.struct(c) == F.col(f"_{i}")) & same
        placed = placed.join(first, same).drop(*[f"_{i}" for i in range(len(by))])
    else:
        placed = placed.withColumn("_first", F.lit(0))
    return placed.withColumn(name, F.col("_before_all") - F.col("_first") + (F.col("n") + 1) / 2).drop("_before_all", "_first")
