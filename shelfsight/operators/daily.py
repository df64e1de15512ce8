"""Numbers of each day: what stood at its end, and the table in which a day is kept once.

`standing` doesn't look at every day's table: each newest row of a key adds to the day on which it comes and
takes away on the day that replaces it, and running sums over the days give the rest. `keep_days` writes a day
as one partition, so that a job that runs twice, or again after a crash, leaves each day once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def standing(rows: DataFrame, key: Sequence[str], at: str, order: Sequence[str], scope: Column, flags: Mapping[str, Column], first: dt.date, last: dt.date) -> DataFrame:
    """day, scope and for each flag how many keys held it at the day's end, from `first` to `last`, by the newest row of each key (of one time the greatest in `order`).

    scope is an array: a row counts in each of its scopes, whose days are all given from the first on
    that has a row. Rows without a key's part are keys as well; those without a time or without a
    scope take no part; a flag that is null doesn't hold. A key's rows of one day are one before the keys' days
    are put in order, so a key never has more rows there than days.
    """
    marks = [F.coalesce(c, F.lit(False)).cast("int").alias(f"_{n}") for n, c in flags.items()]
    plain = rows.where(F.col(at).isNotNull()).select(*key, F.to_date(at).alias("_day"), F.struct(at, *order).alias("_order"), F.struct(scope.alias("_scope"), *marks).alias("_row"))
    ends = plain.groupBy(*key, "_day").agg(F.max_by("_row", "_order").alias("_row")).where(F.col("_day") <= F.lit(last))
    nexts = F.lead("_day").over(Window.partitionBy(*key).orderBy("_day"))
    moves = F.explode(F.array_compact(F.array(F.struct(F.col("_day").alias("day"), F.lit(1).alias("sign")), F.when(F.col("_until").isNotNull(), F.struct(F.col("_until").alias("day"), F.lit(-1).alias("sign"))))))
    moved = ends.withColumn("_until", nexts).select("_row", moves.alias("_m")).select(F.explode("_row._scope").alias("scope"), F.greatest(F.col("_m.day"), F.lit(first)).alias("day"), *[(F.col(f"_row._{n}") * F.col("_m.sign")).alias(n) for n in flags])
    by_day = moved.where("scope is not null").groupBy("scope", "day").agg(*[F.sum(n).alias(n) for n in flags])
    every = by_day.groupBy("scope").agg(F.explode(F.sequence(F.min("day"), F.lit(last))).alias("day"))
    so_far = Window.partitionBy("scope").orderBy("day")
    return every.join(by_day, ["scope", "day"], "left").select("day", "scope", *[F.sum(F.coalesce(n, F.lit(0))).over(so_far).alias(n) for n in flags])


def kept_days(spark: SparkSession, folder: str) -> list[dt.date]:
    """The days that a folder holds, from the names of its partitions."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(dt.date.fromisoformat(n.removeprefix("day=")) for n in names if n.startswith("day="))


def keep_days(counts: DataFrame, folder: str, replace: bool = False) -> None:
    """Writes counts (with day, a date) by day; days that are kept stay as they are, or with `replace` give way as a whole. Days that aren't in counts stay."""
    held = [] if replace else kept_days(counts.sparkSession, folder)
    new = counts.where(F.col("day").isNotNull() & (~F.col("day").isin(held) if held else F.lit(True)))
    new.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def history(spark: SparkSession, folder: str, schema: str, days: int, today: dt.date, scope: str = "all") -> DataFrame:
    """Kept days of one scope: the last `days` up to today, read by their partitions only; no rows if nothing is kept. schema names all columns, day among them."""
    if not kept_days(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).where(F.col("day").between(F.lit(today - dt.timedelta(days=days - 1)), F.lit(today)) & (F.col("scope") == scope))
