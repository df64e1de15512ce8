"""Exact top-k inner products by distributed histogram selection.

Method. Queries and candidates are packed in blocks and each query block is held
against each candidate block. A pass scores a pair of blocks with one matrix product
and gives, for each query, a histogram of its scores over the interval in which its
kth score is known to lie; counts are summed over all blocks, and the interval shrinks
to the bin in which the kth score falls, until bins are one wide and the kth score is
known exactly. A last pass keeps scores that reach it; ties go to the smaller id.
A block pair reports only its k best bins' worth of counts: bins below those can't
hold the kth score of a query.

Scores are integers: each component x becomes floor(scale * x), x as double. A product
is taken in float64 where all partial sums stay below 2**53, and in int64 otherwise.

Rows: vectors that are null, empty, or hold null or non-finite components take no part.
Null ids take no part. Rows with one id count each for themselves (a row isn't a
candidate for the queries with its own id). Vectors of another length than the query's
are no candidates. No queries, or no candidates, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved
from .vectors import against, blocks, query_blocks, unpack, usable

SCALE = 256
BINS = 1024


def _integers(numbers: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(numbers * scale)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of two blocks of whole numbers."""
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= 2**53:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return (q @ c.T).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple]:
    """Query ids, candidate ids, scores and the other columns of each pair of blocks."""
    for batch in batches:
        for x in batch.to_pylist():
            q_ids, q = unpack(x["q_ids"], x["q_numbers"], x["dim"])
            c_ids, c = unpack(x["ids"], x["numbers"], x["dim"])
            yield q_ids, c_ids, scores(_integers(q, scale), _integers(c, scale)), x


def _counts(batches: Iterator[pa.RecordBatch], scale: int, bins: int, k: int) -> Iterator[pa.RecordBatch]:
    for q_ids, c_ids, s, x in _pairs(batches, scale):
        low, width = np.array(x["low"])[:, None], np.array(x["width"])[:, None]
        at = (s - low) // width
        own = q_ids[:, None] == c_ids[None, :]
        at[own] = -1
        out = []
        # bins below the kth best of this block pair can't hold the kth best of all
        last = np.maximum(np.partition(at, -k, axis=1)[:, -k], 0) if at.shape[1] >= k else np.zeros(len(at), dtype=np.int64)
        for i in range(len(q_ids)):
            some = at[i][at[i] >= last[i]]
            values, n = np.unique(np.minimum(some, bins), return_counts=True)
            out.append((np.full(len(values), x["q_rows"][i]), values, n))
        rows, values, n = (np.concatenate(c) for c in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), pa.array(values.astype(np.int32)), pa.array(n.astype(np.int64))], ["q_row", "bin", "n"])


def _reaching(batches: Iterator[pa.RecordBatch], scale: int, k: int) -> Iterator[pa.RecordBatch]:
    """Candidates whose score reaches the kth; of those that are equal only the k smallest ids."""
    for q_ids, c_ids, s, x in _pairs(batches, scale):
        good = (s >= np.array(x["low"])[:, None]) & (q_ids[:, None] != c_ids[None, :])
        i, j = np.nonzero(good)
        v = s[i, j]
        order = np.lexsort((c_ids[j], -v, i))
        i, j, v = i[order], j[order], v[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        few = nth < k
        i, j, v = i[few], j[few], v[few]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x["q_rows"], dtype=np.int64)[i]), pa.array(q_ids[i]), pa.array(c_ids[j]), pa.array(v)], ["q_row", "query_id", "vec_id", "score"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each query of a block: its number there, and its largest possible score."""
    for batch in batches:
        for x in batch.to_pylist():
            ids, numbers = unpack(x["q_ids"], x["q_numbers"], x["dim"])
            reach = np.abs(_integers(numbers, x["scale"])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), x["block"], dtype=np.int64)), pa.array((x["block"] << 20) + np.arange(len(ids))), pa.array(reach)], ["block", "q_row", "reach"])


def top_k(rows: DataFrame, queries: DataFrame, k: int, scale: int = SCALE, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score for rows and queries (vec_id, vector): k best each."""
    spark = rows.sparkSession
    candidates = saved(blocks(rows))
    largest = candidates.mapInArrow(partial(_largest, scale=scale), "most double").agg(F.max("most")).first()[0]
    asked = query_blocks(queries)
    numbers = asked.count()
    if largest is None or not numbers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    reach = F.ceil(F.col("reach") * F.lit(float(largest))).cast("long") + 1
    state = asked.withColumn("scale", F.lit(scale)).mapInArrow(_block_rows, "block long, q_row long, reach double")
    state = saved(state.select("block", "q_row", (-reach).alias("low"), F.greatest(F.lit(1), F.ceil((2 * reach + 1) / bins)).cast("long").alias("width"), F.lit(k).cast("long").alias("wanted")))

    def with_state() -> DataFrame:
        fields = F.array_sort(F.collect_list(F.struct("q_row", "low", "width"))).alias("s")
        each = state.groupBy("block").agg(fields)
        q = asked.join(each, "block").select("block", "dim", "q_ids", "q_numbers", F.col("s.q_row").alias("q_rows"), F.col("s.low").alias("low"), F.col("s.width").alias("width"))
        return against(candidates, q, numbers)

    while state.where("width > 0").head(1):
        counted = with_state().mapInArrow(partial(_counts, scale=scale, bins=bins, k=k), "q_row long, bin int, n long").groupBy("q_row", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("q_row").orderBy(F.desc("bin"))  # bins are at most BINS + 1 a query
        above = counted.withColumn("upto", F.sum("n").over(w)).join(state, "q_row").where("upto >= wanted").groupBy("q_row").agg(F.max("bin").alias("bin"))
        # a query with fewer than k candidates has no such bin: all of its candidates reach the lowest score
        step = state.join(above, "q_row", "left")
        low = F.col("low") + F.coalesce("bin", F.lit(0)) * F.col("width")
        narrow = F.when(F.col("bin").isNull() | (F.col("width") <= 1), 0).otherwise(F.ceil(F.col("width") / bins)).cast("long")
        state = saved(step.select("block", "q_row", low.alias("low"), narrow.alias("width"), "wanted"))
    best = with_state().mapInArrow(partial(_reaching, scale=scale, k=k), "q_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _largest(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            _, c = unpack(x["ids"], x["numbers"], x["dim"])
            yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(_integers(c, scale)).max(initial=0))])], ["most"])


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = table.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
