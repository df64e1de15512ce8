"""Change-only histories and as-of reading of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(rows: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """Rows whose value differs (nulls equal each other) from that of the row before; the first of a key always."""
    w = Window.partitionBy(key).orderBy(at, tie)
    marked = rows.withColumn("_nth", F.row_number().over(w)).withColumn("_was", F.lag(value).over(w))
    return marked.where((F.col("_nth") == 1) | ~F.col(value).eqNullSafe(F.col("_was"))).drop("_nth", "_was")


def as_of_days(history: DataFrame, days: DataFrame, key: str, at: str, tie: str, values: dict[str, Column]) -> DataFrame:
    """key, day and for each name in values what held just before the day's end; only keys and days of `days` (key, day).

    Probes and events are put in one order by a union, so the work is events plus
    probes, not their product. A value that is null at its event stays null: it is
    carried inside a struct.
    """
    end = F.date_add("day", 1).cast("timestamp")
    probe = days.select(key, end.alias("_t"), F.lit(0).alias("_event"), F.lit(None).cast("long").alias("_tie"), "day", *[F.lit(None).alias(f"_{n}") for n in values])
    event = history.select(key, F.col(at).alias("_t"), F.lit(1).alias("_event"), F.col(tie).cast("long").alias("_tie"), F.lit(None).cast("date").alias("day"), *[F.struct(c.alias("v")).alias(f"_{n}") for n, c in values.items()])
    w = Window.partitionBy(key).orderBy("_t", "_event", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    held = event.unionByName(probe).select(key, "day", "_event", *[F.last(f"_{n}", ignorenulls=True).over(w).alias(f"_{n}") for n in values])
    return held.where("_event = 0").select(key, "day", *[F.col(f"_{n}.v").alias(n) for n in values])


def newest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def exact_median(values: Column) -> Column:
    """Median of an array of whole numbers; half way between two goes to the even one."""
    s = F.array_sort(values)
    n = F.size(s)
    both = F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))
    return _half(both)


def _half(both: Column) -> Column:
    half = F.floor(both / 2)
    return (F.when(both % 2 == 1, half + half % 2).otherwise(half)).cast("long")


def bands(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, low, median, high, n of the whole numbers `value` of each key; median as exact_median.

    Equal values are counted first, so a key's rows meet as its different values with their
    numbers, in order, and never as one array.
    """
    of = Window.partitionBy(key)
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_upto", F.sum("_n").over(of.orderBy(value))).withColumn("_all", F.sum("_n").over(of))
    at = lambda nth: F.min(F.when(F.col("_upto") >= nth, F.col(value)))
    both = at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)
    return ranked.groupBy(key).agg(F.min(value).alias("low"), _half(both).alias("median"), F.max(value).alias("high"), F.sum("_n").alias("n"))
