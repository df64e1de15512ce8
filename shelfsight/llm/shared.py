"""Saved intermediate tables, connected components and small column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.saved import saved  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, in a session whose Arrow batches hold at most `rows` rows from now on: whole texts are large, and two batches are held at a time.

    Spark reads this setting when a plan runs, so it can't be set back here; a smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def spare(columns: Sequence[str], stem: str) -> str:
    """stem with underscores before it, so that no column's name begins with it, whatever its case."""
    while any(c.lower().startswith(stem.lower()) for c in columns):
        stem = f"_{stem}"
    return stem


def _in_parts(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """rows with _part and _nth: the part of a sort over all machines, and the place in it from 0."""
    placed = rows.orderBy(*order).withColumn("_part", F.spark_partition_id())
    return saved(placed.withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """rows with their place from 1 in an order; no task sees more than a part of them. Only parts are summed in one."""
    parts = _in_parts(rows, order)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return parts.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_nth") + 1).drop("_part", "_nth", "_base")


def running(rows: DataFrame, order: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """rows with the sum of each column over all rows before, under the name that `sums` gives it; as `numbered`."""
    parts = _in_parts(rows, order)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    base = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(every), F.lit(0)).alias(f"_b_{c}") for c in sums])
    before = Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(base), "_part")
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.drop("_part", "_nth", *[f"_b_{c}" for c in sums])


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node of an edge list.

    Alternates large-star and small-star steps, each one shuffle with partial
    minima, so that a node with very many neighbours is never gathered. Nodes
    are longs; null ends and loops are left out. Steps go on until one changes
    nothing (their number grows with the logarithm of the longest path). Only two
    numbers a round reach the driver.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    pairs = saved(pairs.distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: what is larger than u moves below the least neighbour of u
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large)
        # small star: u and its smaller neighbours move below the least of them
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        pairs = saved(small)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
