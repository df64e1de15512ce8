"""Values that listings state and no registry knows, by value and reason, each with a few spellings and examples.

A few of each are kept by rank in their group, which Spark cuts to that many in each task before it
shuffles, so no group is ever gathered, however many listings state one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .saved import saved

SPELLINGS, EXAMPLES = 5, 3


def value_key(written: Column) -> Column:
    return F.lower(F.trim(written))


def cases(stated: DataFrame, registry: DataFrame) -> DataFrame:
    """offer_id, field, written, reason, resolves_to of values (offer_id, field, written) against a registry (spelling, canonical).

    A value that isn't known is unknown, or a pair if all of its parts (between commas or slashes) are known and differ; only such values of a listing count,
    if it has any. What a value means is found once for each different one and written: a common value's listings aren't brought together where
    the values are few. Else values of one listing that mean different things are in conflict, and if they mean one they resolve now.
    """
    known = registry.select(value_key(F.col("spelling")).alias("key"), "canonical").groupBy("key").agg(F.min("canonical").alias("canonical"))
    rows = stated.where("trim(written) <> ''").withColumn("key", value_key(F.col("written"))).withColumn("parts", F.transform(F.split("key", r"\s*[,/]\s*"), F.trim))
    keys = saved(rows.select("key", "parts").distinct())
    words = keys.select(F.explode(F.array_union(F.array("key"), "parts")).alias("key")).distinct().join(known, "key")
    meant = keys.join(words.withColumnRenamed("canonical", "resolves_to"), "key", "left")
    part = meant.where("resolves_to is null and size(parts) > 1").select("key", F.explode("parts").alias("part")).distinct().join(words.select(F.col("key").alias("part"), "canonical"), "part", "left")
    pairs = part.groupBy("key").agg(F.count_if(F.col("canonical").isNull()).alias("lost"), F.array_sort(F.collect_set("canonical")).alias("found")).where("lost = 0 and size(found) > 1").select("key", F.array_join("found", "-").alias("pair"))
    whole = rows.drop("parts").join(saved(meant.join(pairs, "key", "left").select("key", "resolves_to", "pair")), "key", "left")
    of = whole.groupBy("offer_id").agg(F.count_if(F.col("resolves_to").isNull()).alias("_unknown"), F.min("resolves_to").alias("_low"), F.max("resolves_to").alias("_high"))
    whole = whole.join(of, "offer_id").where("_unknown = 0 or resolves_to is null")
    reason = F.when(F.col("_unknown") > 0, F.when(F.col("pair").isNotNull(), "pair").otherwise("unknown")).when(F.col("_low") != F.col("_high"), "conflict").otherwise("resolves_now")
    return whole.select("offer_id", "field", "written", "key", reason.alias("reason"), F.coalesce("resolves_to", "pair").alias("resolves_to"))


def unresolved(stated: DataFrame, registry: DataFrame, dismissed: DataFrame) -> DataFrame:
    """value, reason, resolves_to, listings, spellings (those of the least listings' ids), examples (offer_id, field, written) of `cases`, without dismissed values (value)."""
    rows = cases(stated, registry).join(dismissed.select(value_key(F.col("value")).alias("key")).distinct(), "key", "left_anti").withColumnRenamed("key", "value")
    of = ["value", "reason"]
    total = rows.groupBy(*of).agg(F.countDistinct("offer_id").alias("listings"), F.min("resolves_to").alias("resolves_to"))

    def few(found: DataFrame, n: int, order: list[str], keep: Column, name: str) -> DataFrame:
        ranked = found.withColumn("_k", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("_k") <= n)
        held = ranked.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("_k", keep.alias("v")))).alias("_held"))
        return held.select(*of, F.transform("_held", lambda x: x["v"]).alias(name))

    spelled = rows.groupBy(*of, "written").agg(F.min("offer_id").alias("first"))
    shown = rows.groupBy(*of, "offer_id").agg(F.min(F.struct("field", "written")).alias("x"))
    out = total.join(few(spelled, SPELLINGS, ["first", "written"], F.col("written"), "spellings"), of)
    return out.join(few(shown, EXAMPLES, ["offer_id"], F.struct("offer_id", "x.field", "x.written"), "examples"), of)
