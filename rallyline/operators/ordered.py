"""Fills, lags, islands and running states along a stream's order.

A stream is a set of partition keys and one order column, the only valid order.  All operators of one stream share one
window specification, so Spark shuffles and sorts once for a chain of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stream:
    keys: tuple[str, ...]
    order: str

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def within(self, *more: str) -> Stream:
        return Stream((*self.keys, *more), self.order)


def forward_fill(value: Column, stream: Stream, default: object) -> Column:
    """The last value that isn't null, up to this row."""
    return F.coalesce(F.last(value, ignorenulls=True).over(stream.so_far), F.lit(default))


def previous_known(value: Column, stream: Stream) -> Column:
    """The last value that isn't null, strictly before this row."""
    return F.last(value, ignorenulls=True).over(stream.before)


def moved_backwards(value: Column, stream: Stream, start: object = 0) -> Column:
    """True where the value is below the one of the row before; the first row is held against `start`."""
    return value < F.coalesce(F.lag(value).over(stream.window), F.lit(start))


def running_maximum(value: Column, stream: Stream) -> Column:
    return F.max(value).over(stream.so_far)


def island(stream: Stream, *values: Column) -> Column:
    """Numbers of the maximal runs of consecutive rows that agree in all values (nulls agree), from 1."""
    same = F.lit(True)
    for v in values:
        same &= F.lag(v).over(stream.window).eqNullSafe(v)
    first = F.row_number().over(stream.window) == 1
    return F.when(first | ~same, 1).otherwise(0)


def islands(df: DataFrame, stream: Stream, out: str, *values: Column) -> DataFrame:
    marked = df.withColumn("_new", island(stream, *values))
    return marked.withColumn(out, F.sum("_new").over(stream.so_far)).drop("_new")


def decreases(df: DataFrame, stream: Stream, value: str) -> DataFrame:
    """Violations: rows whose known value is below the last known one before."""
    known = previous_known(F.col(value), stream)
    return df.withColumn("_before", known).where(F.col(value) < F.col("_before")).drop("_before")


def repeated_order(df: DataFrame, stream: Stream) -> DataFrame:
    """Violations: order values that aren't unique in their stream."""
    return df.groupBy(*stream.keys, stream.order).count().where("count > 1")


def backwards_report(df: DataFrame, stream: Stream, value: str) -> DataFrame:
    """Per stream: how often the value went backwards, and the largest step back."""
    step = F.coalesce(F.lag(value).over(stream.window), F.lit(0)) - F.col(value)
    return df.withColumn("_back", step).groupBy(*stream.keys).agg(
        F.count_if(F.col("_back") > 0).alias("n_backwards"),
        F.coalesce(F.max(F.when(F.col("_back") > 0, F.col("_back"))), F.lit(0)).alias("largest_back"),
    )


def running_state(df: DataFrame, stream: Stream, turns_on: Column, turns_off: Column, initial: Column) -> DataFrame:
    """On/off state per stream after each row; setting a state again changes nothing and is flagged as an issue.

    Adds state (after the row), was (before it), changed and issue.
    """
    told = F.when(turns_on, True).when(turns_off, False)
    rows = df.withColumn("_told", told)
    state = F.coalesce(F.last("_told", ignorenulls=True).over(stream.so_far), initial)
    was = F.coalesce(F.last("_told", ignorenulls=True).over(stream.before), initial)
    rows = rows.withColumn("state", state).withColumn("was", was)
    changed = F.col("_told").isNotNull() & (F.col("state") != F.col("was"))
    return rows.withColumn("changed", changed).withColumn("issue", F.col("_told").isNotNull() & ~F.col("changed")).drop("_told")
