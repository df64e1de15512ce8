"""Vectors of a table as packed blocks, and block products of queries with candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Rows of a block; a block of 64 dimensions is 1 MB.
BLOCK = 2048
#: Query blocks up to this many (some 32 MB at 64 dimensions) are broadcast.
BROADCAST = 32
SALTS = 64


def usable(vector: Column) -> Column:
    """Whether a vector is there, is not empty and has only finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as a matrix."""
    flat = column.flatten()
    return np.asarray(flat).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one length: their ids and numbers as bytes."""
    held: dict[int, list] = {}
    counts: dict[int, int] = {}

    def flush(dim: int) -> pa.RecordBatch:
        ids, rows = zip(*held.pop(dim))
        counts.pop(dim)
        ids, rows = np.concatenate(ids), np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], ["dim", "n", "ids", "numbers"])

    for batch in batches:
        dims = np.asarray(pc.list_value_length(batch.column("vector")))
        for dim in np.unique(dims):
            some = batch.filter(pa.array(dims == dim))
            for at in range(0, some.num_rows, block):
                part = some.slice(at, block)
                held.setdefault(int(dim), []).append((np.asarray(part.column("vec_id")).astype(np.int64), matrix(part.column("vector")).astype(np.float64)))
                counts[int(dim)] = counts.get(int(dim), 0) + part.num_rows
                if counts[int(dim)] >= block:
                    yield flush(int(dim))
    for dim in list(held):
        yield flush(dim)


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """dim, n, ids (int64 bytes) and numbers (float64 bytes) of blocks of rows (vec_id, vector)."""
    return rows.select("vec_id", "vector").mapInArrow(partial(_packed, block=block), "dim int, n int, ids binary, numbers binary")


def unpack(ids: bytes, numbers: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(numbers, dtype=np.float64).reshape(-1, dim)


def query_blocks(queries: DataFrame) -> DataFrame:
    """block, dim, q_ids, q_numbers: full blocks of the queries, each with a number."""
    rows = saved(queries.select("vec_id", "vector"))
    packed = saved(blocks(rows.repartition(max(1, -(-rows.count() // BLOCK)), "vec_id")))
    numbered = saved(packed.withColumn("block", F.monotonically_increasing_id()))
    return numbered.select("block", "dim", F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers"))


def against(candidates: DataFrame, asked: DataFrame, n_asked: int) -> DataFrame:
    """Each block of candidates with each block of queries of its dimension.

    A few query blocks are broadcast; more are dealt out, each to SALTS places at which
    a part of the candidates is (by their content, so that a repeated task deals alike), so that both sides move as blocks and never as pairs of rows.
    """
    if n_asked <= BROADCAST:
        return candidates.join(F.broadcast(asked), "dim")
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int"))
    return salted.join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["dim", "salt"]).drop("salt")
