"""Mixing sources to target weights by capped water-filling.

Method. Sources get shares of the mix by weight; a source whose share is above `cap`
times its size is clamped there and its excess goes to the others by weight, until
none is above. That level is found in closed form from running sums over the sources
in the order of their cap per weight. A source's documents are then repeated: all of
them floor(target / size) times, and one further time as many of them, in a seeded
order, as fill the rest; the document at the boundary is taken in part, so that a
source's taken words are its target rounded. The boundary is found from sums over
4096 hash buckets of each source, so no source is gathered or sorted as a whole; nor are
the sources themselves, whose order and running sums come from a sort over all machines.

Rows: a null text has no words and takes none. A null source is a source of its own,
ordered last. Rows with one doc_id are separate documents (which of them stand at the
boundary is settled by their sizes); a null doc_id is one too. A mix of nothing, or of
wordless documents, has targets of 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, numbered, running, saved, spare, word_count

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2, 17


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """source, source_size, target for sizes (source, source_size); one row for each source."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    rows = numbered(sizes, [F.col("source").asc_nulls_last()], "nth").withColumn("weight", weight).withColumn("limit", limit).withColumn("ratio", limit / weight)
    rows = running(rows, ["ratio", "nth"], {"limit": "limit_before", "weight": "weight_before"})
    total = saved(rows.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight")))
    level = (F.col("all_size") * F.lit(share) - F.col("limit_before")) / (F.col("all_weight") - F.col("weight_before"))
    rows = saved(rows.crossJoin(F.broadcast(total)).withColumn("level", level).drop("all_size", "all_weight"))
    water = rows.where(F.col("level") <= F.col("ratio")).agg(F.max("level").alias("water"))  # one row
    target = F.least(F.col("limit"), F.coalesce(F.col("water") * F.col("weight"), F.col("limit")))
    return rows.crossJoin(F.broadcast(water)).select("source", "source_size", target.alias("target"))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, text, source), and columns of docs that `also` names; these settle ties."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"), *also)
    sized = saved(sized.withColumn("bucket", F.substring("key", 1, 3)))
    sums = saved(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = saved(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap))
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", (F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")).cast("long"))

    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    edge = sums.withColumn("before", so_far).join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    edge = saved(edge.select("source", "bucket", "words", "before", "rest", "source_size", "target", "whole"))
    known = sized.join(edge.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    boundary = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *also).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))))
    outside = F.when(F.col("before") + F.col("words") <= F.col("rest"), F.col("size")).otherwise(0)
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", *also]
    parts = known.where(~boundary).select(*columns, outside.alias("more")).unionByName(known.where(boundary).select(*columns, cut.alias("more")))
    return parts.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"), *also)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself, columns as they are: each document once for each repetition, the last one cut to the words it takes.

    Columns may have any names. A cut text keeps its first words and what stands between them. Each row keeps its own number of words,
    also where rows share a doc_id or have none; of such rows of one size a hash of the row settles who is cut.
    """
    own = spare(docs.columns, "_mix")
    mark, row, size, took, time, left = (f"{own}_{x}" for x in ("hash", "row", "size", "taken", "time", "left"))
    known = saved(docs.withColumn(mark, F.xxhash64(*docs.columns)).withColumn(row, F.monotonically_increasing_id()))
    taken = mixture(known, weights, share, cap, seed, [mark, row]).where("taken > 0").select(row, F.col("size").alias(size), F.col("taken").alias(took))
    times = known.join(taken, row).withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(took) / F.col(size)))))
    times = times.withColumn(left, F.least(F.col(size), F.col(took) - (F.col(time) - 1) * F.col(size)))
    whole = F.col(left) == F.col(size)
    text = F.when(whole, F.col("text")).otherwise(first_words(F.col("text"), F.col(left)))
    out = {c: F.col(c) for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return times.select(*[x.alias(c) for c, x in out.items()])


def first_words(text, n):
    """The text up to the end of its nth word."""
    words = F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1), F.lit(1), n.cast("int"))
    return F.array_join(words, "")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (nth - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS lim FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
      - coalesce(sum(lim) OVER (ORDER BY lim / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY lim / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(lim, coalesce((SELECT max(level) FROM l WHERE level <= lim / weight) * weight, lim)) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, r.source_size, r.target, r.whole, CAST(floor(r.target + 0.5) AS BIGINT) - r.whole * r.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM c
"""
