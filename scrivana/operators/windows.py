"""Order-dependent logic as windows over (page or case, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivana.functions.text import is_blank


def carry_group_key(rows: DataFrame, table: list[str], order: str, cells: str = "cells", header: str = "header") -> DataFrame:
    """Group keys carried down onto the rows of their groups.

    A band is a row with only its first cell filled. A row with a blank first cell takes the last key above it; the
    latest band is then dropped, as its key stands on the row. Header rows pass through. An ordinary row's own key
    replaces the last key but leaves a band waiting, so the band also goes if a blank row follows later.
    """
    w = Window.partitionBy(*table).orderBy(order)
    first = F.col(cells)[0]
    blank = is_blank(first)
    others = F.exists(F.slice(F.col(cells), 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda x: ~is_blank(x))
    body = ~F.col(header) & (F.size(cells) > 0)
    marked = rows.withColumns({"_key": F.when(body & ~blank, first), "_band": body & ~blank & ~others, "_blank": body & blank})
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumns({"_above": F.last("_key", ignorenulls=True).over(above), "_bands": F.sum(F.col("_band").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    takes = F.col("_blank") & ~is_blank(F.col("_above"))
    taken = F.max(takes.cast("int")).over(Window.partitionBy(*table, "_bands"))
    carried = F.when(takes, F.transform(F.col(cells), lambda x, i: F.when(i == 0, F.col("_above")).otherwise(x))).otherwise(F.col(cells))
    out = marked.withColumns({"_taken": taken, cells: carried}).where(~F.col("_band") | (F.col("_taken") == 0))
    return out.drop("_key", "_band", "_blank", "_above", "_bands", "_taken")


def span_runs(rows: DataFrame, table: list[str], order: list[str], value: str, breaks: Column | None = None, to: str = "rowspan") -> DataFrame:
    """Runs of equal values: the run's length on its first row, 0 on the rest. A row that ``breaks`` stands alone."""
    w = Window.partitionBy(*table).orderBy(*order)
    alone = F.coalesce(breaks, F.lit(False)) if breaks is not None else F.lit(False)
    rows = rows.withColumn("_alone", alone)
    starts = F.col("_alone") | F.coalesce(F.lag("_alone").over(w), F.lit(True)) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    rows = rows.withColumn("_starts", starts).withColumn("_run", F.sum(F.col("_starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*table, "_run"))
    return rows.withColumn(to, F.when(F.col("_starts"), size).otherwise(0).cast("int")).drop("_alone", "_starts", "_run")


def balance_breaks(rows: DataFrame, case: list[str], order: list[str], paid: str, received: str, balance: str) -> DataFrame:
    """Rows with ``expected`` and ``holds``: is each balance the last one, less what was paid, plus what came in?

    The first row of a case holds by itself.
    """
    w = Window.partitionBy(*case).orderBy(*order)
    rows = rows.withColumn("expected", F.lag(balance).over(w) - F.coalesce(F.col(paid), F.lit(0)) + F.coalesce(F.col(received), F.lit(0)))
    return rows.withColumn("holds", F.col("expected").isNull() | (F.col("expected") == F.col(balance)))


def opening_balance(rows: DataFrame, case: list[str], order: list[str], paid: str, received: str, balance: str) -> DataFrame:
    """(case, opening, closing): what stood before the first row, and the last row's balance."""
    by = F.struct(*order)
    first = F.min_by(F.struct(F.col(balance).alias("b"), F.coalesce(F.col(paid), F.lit(0)).alias("p"), F.coalesce(F.col(received), F.lit(0)).alias("r")), by)
    out = rows.groupBy(*case).agg(first.alias("f"), F.max_by(balance, by).alias("closing"))
    return out.select(*case, (F.col("f.b") - F.col("f.r") + F.col("f.p")).alias("opening"), "closing")


def date_bands(rows: DataFrame, case: list[str], order: list[str], date: str) -> DataFrame:
    """``new_band`` where the date changes (a band row stands before it), ``shown_date`` with repeats blanked."""
    changed = ~F.col(date).eqNullSafe(F.lag(date).over(Window.partitionBy(*case).orderBy(*order)))
    first = F.row_number().over(Window.partitionBy(*case).orderBy(*order)) == 1
    return rows.withColumn("new_band", changed | first).withColumn("shown_date", F.when(F.col("new_band"), F.col(date)).otherwise(F.lit(None)))


def reading_order(events: DataFrame, page: list[str], seq: str, category: str) -> DataFrame:
    """Events with a category, numbered 0..n-1 in capture order."""
    w = Window.partitionBy(*page).orderBy(seq)
    return events.where(F.col(category).isNotNull()).withColumn("order", (F.row_number().over(w) - 1).cast("int"))


def order_faults(numbered: DataFrame, page: list[str], order: str = "order") -> DataFrame:
    """Pages whose order has a gap or a duplicate."""
    counts = numbered.groupBy(*page).agg(F.count(order).alias("n"), F.countDistinct(order).alias("different"), F.max(order).alias("last"), F.min(order).alias("least"))
    return counts.where((F.col("n") != F.col("different")) | (F.col("last") != F.col("n") - 1) | (F.col("least") != 0))


def first_per_group(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
