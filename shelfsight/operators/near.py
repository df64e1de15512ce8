"""Entries of one model that are the same but for one number, and that number nearly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import near_value

#: A little wider than the logarithms of near values can lie apart: -ln 0.95 is 0.0513.
BIN = 0.0514


def near_entries(entries: DataFrame, numbers: list[str], words: list[str]) -> DataFrame:
    """brand, category, model, axis, low, high, a, b, a_n, b_n: pairs of values of one number axis within five in a hundred, all else that the entries say being equal, with the first entry of each value and how many there are.

    entries: variant_id, brand, category, model, a column for each axis (null: not held). Entries that say the same are one class. A class is filed by
    the logarithm of its number and meets its own bin and the next only. A null brand, category or model is one of its own.
    """
    of = ["brand", "category", "model"]
    said = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    def filed(axis: str) -> DataFrame:
        rest = F.concat_ws("\x1f", *[said(c) for c in [*of, *[x for x in (*numbers, *words) if x != axis]]])
        return entries.where(F.col(axis).isNotNull() & (F.col(axis) != 0)).select("variant_id", *of, F.lit(axis).alias("axis"), rest.alias("rest"), F.col(axis).cast("decimal(30,6)").alias("value"))

    rows = reduce(DataFrame.unionByName, map(filed, numbers))
    classes = rows.groupBy("axis", "rest", "value").agg(*[F.first(c).alias(c) for c in of], F.min("variant_id").alias("first"), F.count("*").alias("n"))
    classes = classes.withColumn("sign", F.signum("value").cast("int")).withColumn("bin", F.floor(F.log(F.abs("value").cast("double")) / BIN).cast("long"))
    small = classes.select("axis", "rest", "sign", F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"), *of, F.col("value").alias("x"), F.col("first").alias("x_first"), F.col("n").alias("x_n"))
    large = classes.select("axis", "rest", "sign", "bin", F.col("value").alias("y"), F.col("first").alias("y_first"), F.col("n").alias("y_n"))
    met = small.join(large, ["axis", "rest", "sign", "bin"]).where((F.abs("x") < F.abs("y")) & near_value(F.col("x"), F.col("y")))
    turned = F.col("x") > F.col("y")  # both below zero
    end = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    return met.select(*of, "axis", end("x", "y", "low"), end("y", "x", "high"), end("x_first", "y_first", "a"), end("y_first", "x_first", "b"), end("x_n", "y_n", "a_n"), end("y_n", "x_n", "b_n"))
