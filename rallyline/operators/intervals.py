"""Intervals of positions: merging, containment, and segments between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyline.session import durable


def merged(spans: DataFrame, keys: tuple[str, ...], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping spans of each key as one: rows (keys, start, end, parts).  Spans that only touch stay apart."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    rows = rows.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_span").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")
    ).drop("_span")


def spans_of(df: DataFrame, keys: tuple[str, ...], group: tuple[str, ...], order: str) -> DataFrame:
    """First and last position of each group of rows: rows (keys, group, start, end)."""
    return df.groupBy(*keys, *group).agg(F.min(order).alias("start"), F.max(order).alias("end"))


def covering(points: DataFrame, spans: DataFrame, keys: tuple[str, ...], at: str, start: str = "start", end: str = "end", closed: bool = True) -> DataFrame:
    """Each point once for every span of its key that covers it, with the span's other columns: a sweep, not a range join.

    One ordered pass over the points and both ends of the spans numbers the points and tells how many lie before each end.
    So a span covers a run of point numbers, which is laid out and joined on equality: the work is that of sorting and of
    the result, however many spans are open at a time.  A null end is open; a null start or point covers or is covered by
    nothing; with `closed` off a span ends before its end.
    """
    ends = F.array(F.struct(F.col("_from").alias("_at"), F.lit(0).alias("_kind")), F.struct(F.col("_to").alias("_at"), F.lit(2 if closed else 0).alias("_kind")))
    rest = [c for c in spans.columns if c not in (*keys, start, end)]
    named = spans.where(F.col(start).isNotNull()).select(*keys, F.struct(F.lit(True).alias("_is"), *rest, start, end).alias("_span"), F.col(start).alias("_from"), F.col(end).alias("_to"))
    marks = named.select(*keys, "_span", F.posexplode(ends).alias("_end", "e")).select(*keys, "_span", "_end", "e.*")
    asked = points.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"))
    order = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_last(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked, allowMissingColumns=True)
    # written: the points' numbers must be the same on both sides of the join
    both = durable(both.withColumn("_n", F.count("_point").over(order)))
    # of equal spans each is laid out as often as it comes: both ends stand equally often
    runs = both.where("_span IS NOT NULL").groupBy(*keys, "_span").agg(F.min(F.when(F.col("_end") == 0, F.col("_n"))).alias("_lo"), F.max(F.when(F.col("_end") == 1, F.col("_n"))).alias("_hi"), (F.count("*") / 2).cast("int").alias("_times"))
    covered = F.flatten(F.array_repeat(F.sequence(F.col("_lo") + 1, F.col("_hi")), F.col("_times")))
    runs = runs.where("_hi > _lo").select(*[F.col(k).alias(f"_{k}") for k in keys], "_span", F.explode(covered).alias("_m"))
    on = F.col("_n") == F.col("_m")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = both.where("_point IS NOT NULL").select(*keys, "_n", "_point").join(runs, on)
    return rows.select("_point.*", *[F.col(f"_span.{c}").alias(c) for c in spans.columns if c not in keys])


def latest_begun(points: DataFrame, spans: DataFrame, keys: tuple[str, ...], at: str, start: str, out: str) -> DataFrame:
    """Adds `out`: the span (a struct of its columns but the keys) that began last up to each point, null where none has.

    One ordered pass.  Where the spans of a key don't overlap, this is the only one that can cover the point.
    """
    begun = spans.select(*keys, F.col(start).alias(at), F.struct(*[c for c in spans.columns if c not in keys]).alias(out))
    both = points.withColumn("_asks", F.lit(1)).unionByName(begun.withColumn("_asks", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy(at, "_asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last(out, ignorenulls=True).over(so_far)).where("_asks = 1").drop("_asks")


def segment_index(points: DataFrame, spans: DataFrame, keys: tuple[str, ...], at: str, out: str) -> DataFrame:
    """How many spans end before each point, as one ordered pass over points and span ends instead of a range join."""
    ends = spans.select(*keys, F.col("end").alias(at), F.lit(1).alias("_end"))
    both = points.withColumn("_end", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at, "_end").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(out, F.coalesce(F.sum("_end").over(order), F.lit(0))).where("_end = 0").drop("_end")
