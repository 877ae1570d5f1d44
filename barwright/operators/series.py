"""Date-ordered series per ticker, computed in segments.

A plain window over a ticker puts its whole history into one task. Here the window runs inside
(ticker, calendar year), which a unique (ticker, date) key bounds at 366 rows, and what one segment hands to
the next travels in a side table of one row per segment. That table comes from a map-side aggregation, is a few
hundred times smaller than the rows, and joins back on the partitioning that the window already has. Every
segment has its row there, so a left join keeps the rows as they are; unlike an inner one it adds no filter to one
side only, and Spark can share the shuffle that both sides start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEGMENT = "_segment"
Keys = tuple[str, ...]


def _segmented(df: DataFrame, by: Keys, date: str) -> DataFrame:
    """Rows with their segment; a row without a key belongs to no series."""
    return df.filter(" AND ".join(f"{key} IS NOT NULL" for key in by)).withColumn(SEGMENT, F.year(date))


def _inside(by: Keys, date: str) -> WindowSpec:
    return Window.partitionBy(*by, SEGMENT).orderBy(date)


def _across(by: Keys) -> WindowSpec:
    """Over the segments of a series: as many rows as it has calendar years."""
    return Window.partitionBy(*by).orderBy(SEGMENT)


def _carried(rows: DataFrame, by: Keys, total: Column, handed_on: Column) -> DataFrame:
    """One row per segment: ``total`` is formed inside the segment, ``handed_on`` from the ones before it."""
    totals = rows.groupBy(*by, SEGMENT).agg(total.alias("_total"))
    return totals.select(*by, SEGMENT, handed_on.alias("_carried"))


def with_previous_filled(
    df: DataFrame, column: str, out: str, by: Keys = ("ticker",), date: str = "date"
) -> DataFrame:
    """Add the last value that is not null before each row: a forward fill up to the row before."""
    rows = _segmented(df, by, date)
    inside = _inside(by, date).rowsBetween(Window.unboundedPreceding, -1)
    across = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(
        rows,
        by,
        F.max_by(column, F.when(F.col(column).isNotNull(), F.col(date))),
        F.last("_total", ignorenulls=True).over(across),
    )
    local = rows.withColumn("_local", F.last(column, ignorenulls=True).over(inside))
    return local.join(carried, [*by, SEGMENT], "left").select(*df.columns, F.coalesce("_local", "_carried").alias(out))


def with_lag(df: DataFrame, column: str, out: str, by: Keys = ("ticker",), date: str = "date") -> DataFrame:
    """Add the value of the row before, null when that row has none: a plain shift by one."""
    rows = _segmented(df, by, date)
    inside = _inside(by, date)
    carried = _carried(rows, by, F.max_by(column, date), F.lag("_total").over(_across(by)))
    local = rows.withColumns(
        {"_local": F.lag(column).over(inside), "_first": F.row_number().over(inside) == 1}
    )
    value = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_local"))
    return local.join(carried, [*by, SEGMENT], "left").select(*df.columns, value.alias(out))


def with_growth(df: DataFrame, column: str, by: Keys = ("ticker",), date: str = "date") -> DataFrame:
    """Add ``_lag``, ``_filled`` and ``_growth`` of a level in one pass: one shuffle of the rows, one carried table.

    ``_lag`` is the value of the row before, ``_filled`` the last value that is not null before the row, and ``_growth`` the
    product of all steps ``value / _filled`` up to the row, missing values filled; a step from nothing or from zero counts as
    one. A segment's part of all three is in a few mergeable aggregates (its last row, its first, last and first nonzero
    value, and whether a zero follows one that is not), because the steps inside a segment multiply to last over first.
    """
    rows = _segmented(df, by, date)
    value = F.col(column)
    known, nonzero = value.isNotNull(), value != 0
    zero_day, nonzero_day = F.when(value == 0, F.col(date)), F.when(nonzero, F.col(date))
    totals = rows.groupBy(*by, SEGMENT).agg(
        F.max_by(F.struct(value.alias("v")), date).alias("_last_row"),
        F.min_by(column, F.when(known, F.col(date))).alias("_first"),
        F.max_by(column, F.when(known, F.col(date))).alias("_last"),
        F.min_by(column, nonzero_day).alias("_start"),
        (F.max(zero_day) > F.min(nonzero_day)).alias("_lost"),
    )
    across = _across(by)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumns({"_carried": F.last("_last", ignorenulls=True).over(before), "_carried_row": F.lag("_last_row").over(across)})
    inner = F.when(F.col("_start").isNull(), 1.0).when(F.col("_lost"), 0.0).otherwise(F.col("_last") / F.col("_start"))
    entry = F.coalesce(F.try_divide("_first", "_carried"), F.lit(1.0))  # the step from the last value of earlier segments
    carried = carried.withColumn("_step", entry * inner)
    carried = carried.select(*by, SEGMENT, "_carried", "_carried_row", F.product("_step").over(before).alias("_grown"))

    inside = _inside(by, date)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({
        "_local": F.last(column, ignorenulls=True).over(so_far),
        "_local_row": F.lag(F.struct(value.alias("v"))).over(inside),
    })
    joined = local.join(carried, [*by, SEGMENT], "left")
    filled = F.coalesce("_local", "_carried")
    step = F.coalesce(F.try_divide(F.coalesce(value, filled), filled), F.lit(1.0))
    joined = joined.withColumns({"_filled": filled, "_lag": F.coalesce("_local_row", "_carried_row")["v"], "_own": step})
    grown = F.product("_own").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) * F.coalesce("_grown", F.lit(1.0))
    return joined.withColumn("_growth", grown).select(*df.columns, "_lag", "_filled", "_growth")


def with_running_product(
    df: DataFrame, factor: Column, out: str, by: Keys = ("ticker",), date: str = "date"
) -> DataFrame:
    """Add the product of ``factor`` from the first row of the series to the current one."""
    rows = _segmented(df, by, date).withColumn("_factor", factor)
    inside = _inside(by, date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(rows, by, F.product("_factor"), F.product("_total").over(across))
    local = rows.withColumn("_local", F.product("_factor").over(inside))
    value = F.col("_local") * F.coalesce("_carried", F.lit(1.0))
    return local.join(carried, [*by, SEGMENT], "left").select(*df.columns, value.alias(out))
