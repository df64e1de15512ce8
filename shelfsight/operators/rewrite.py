"""Changes of tables as rewrites by key: upsert, update from, delete, merges of entries. A dry run is the plan without the write.

An upsert merges both sides by a shuffle: changes grow with their table, and keys alone look small by the size of their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows of `changes` in place of those with their keys, and after those with none."""
    return table.hint("merge").join(changes.select(*key), key, "left_anti").unionByName(changes.select(*table.columns))


def updated(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table with values of `changes` where it has a row of the key; changes of no row are left out."""
    values = [c for c in changes.columns if c not in key]
    new = changes.select(*key, F.struct(*values).alias("_new"))
    out = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns]
    return table.join(new, key, "left").select(*out)


def absent_only(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table with those rows of `changes` whose key it doesn't have."""
    return table.unionByName(changes.join(table.select(*key), key, "left_anti").select(*table.columns))


def merged(table: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """The table with entries replaced by what they went into (pairs: from, into; no `into` is a `from`)."""
    to = pairs.select(F.col("from").alias(column), F.col("into").alias("_into"))
    return table.join(to, column, "left").select(*[F.coalesce("_into", column).alias(c) if c == column else F.col(c) for c in table.columns])
