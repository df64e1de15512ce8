"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

Method. Each of TABLES tables turns a vector by pseudo-random rotations (three rounds
of random signs and a fast Hadamard transform, length padded to a power of two) and
files it under its nearest signed axis; from FINE rows for each axis on, under a pair of
them, one axis of each of two rotations, so that buckets stay small as the table grows.
A query looks into those buckets of each table whose axes are nearest to it: `share` of
all of them. Their rows are scored exactly; each query keeps its best k.

How many buckets a given recall needs follows from how near the neighbours are. They
lie farther off in small tables, so the share is SHARE * (1 + SMALL / rows) of single axes
(tables of few rows are searched whole), and PAIR_SHARE of pairs. Recall against brute
force is in the README.

Buckets are dealt to shards of about SHARD_BYTES of vectors, a bucket with more rows to
several, so a vector with very many copies is gathered nowhere; every row is filed once a
table and no bucket is cut short. A query goes once to each shard that holds one of its
buckets, with a list of them. Where there are more queries than QUERIES they go in
several parts, and shards to each part. Vectors move as float32 where that is all they hold.

Nearness is the inner product of the vectors as they are. Where their norms differ, an
extra coordinate sqrt(longest**2 - norm**2) makes all stored vectors equally long for
hashing (queries have 0 there), which leaves inner products as they are. Queries that
found fewer than k rows are held against all rows, block by block.

Rows: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do null ids. Vectors of another length than the query's are no candidates.
Rows that share an id are one candidate, with the best of their scores, and queries that
share one are one query, with the best of each pair. An id is no candidate for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved
from .vectors import against, blocks, matrix, query_blocks, unpack, usable
from .words import mix

TABLES = 2
SHARE, SMALL, PAIR_SHARE = 0.375, 1000, 0.1875
#: Rows for each axis from which buckets are pairs of axes, unless these were more than PAIRS.
FINE, PAIRS = 8192, 65536
SHARD_BYTES, QUERIES = 1 << 23, 16384
_FOUND = "query_id long, vec_id long, score double"


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row; their length is a power of two."""
    n, h = rows.shape[1], 1
    while h < n:
        halves = rows.reshape(len(rows), n // (2 * h), 2, h)
        rows = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(rows), n)
        h *= 2
    return rows / np.sqrt(n)


def rotate(rows: np.ndarray, table: int) -> np.ndarray:
    signs = np.random.default_rng([table, rows.shape[1]]).choice([-1.0, 1.0], size=(3, rows.shape[1]))
    for s in signs:
        rows = hadamard(rows * s)
    return rows


@dataclass(frozen=True)
class Hashing:
    """Tables over n rows, whose norms are at most `longest` (0: all alike)."""

    tables: int
    longest: float
    n: int
    fine: int = FINE

    def axes(self, dim: int) -> int:
        """Number of signed axes for vectors of a length."""
        return 2 << max(1, int(dim + bool(self.longest) - 1).bit_length())

    def paired(self, dim: int) -> bool:
        return self.n > self.fine * self.axes(dim) and self.axes(dim) ** 2 <= PAIRS

    def buckets(self, dim: int) -> int:
        return self.axes(dim) ** (1 + self.paired(dim))

    def probes(self, dim: int) -> int:
        """In how many buckets of a table a query looks."""
        return int(np.ceil(self.buckets(dim) * (PAIR_SHARE if self.paired(dim) else min(1.0, SHARE * (1 + SMALL / max(self.n, 1))))))

    def unit(self, rows: np.ndarray, stored: bool) -> np.ndarray:
        """Vectors of length 1 for hashing, padded to a power of two."""
        if self.longest:
            extra = np.sqrt(np.maximum(self.longest**2 - (rows**2).sum(axis=1), 0)) if stored else np.zeros(len(rows))
            full = np.column_stack([rows / self.longest, extra / self.longest])
        else:
            full = rows / np.linalg.norm(rows, axis=1)[:, None]
        return np.pad(full, ((0, 0), (0, self.axes(rows.shape[1]) // 2 - full.shape[1])))

    def turned(self, full: np.ndarray, table: int, dim: int) -> list[np.ndarray]:
        """Of each row to each signed axis, for the table's rotations."""
        return [np.concatenate([x, -x], axis=1) for x in (rotate(full, 2 * table + i) for i in range(1 + self.paired(dim)))]

    def nearest(self, full: np.ndarray, table: int, dim: int) -> np.ndarray:
        """The bucket of each row."""
        one, *other = [x.argmax(axis=1) for x in self.turned(full, table, dim)]
        return one * self.axes(dim) + other[0] if other else one

    def nearness(self, full: np.ndarray, table: int, dim: int) -> np.ndarray:
        """Of each row to each bucket."""
        one, *other = self.turned(full, table, dim)
        return (one[:, :, None] + other[0][:, None, :]).reshape(len(full), -1) if other else one


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = np.asarray(pc.list_value_length(batch.column("vector")))
    for dim in np.unique(dims):
        some = batch.filter(pa.array(dims == dim))
        yield int(dim), some, matrix(some.column("vector")).astype(np.float64)


def _short(rows: np.ndarray) -> list[bytes]:
    """Each vector's bytes: float32 if that holds it, else float64."""
    with np.errstate(over="ignore"):
        half = rows.astype("<f4")
    return [a.tobytes() if same else b.tobytes() for a, b, same in zip(half, rows.astype("<f8"), (half == rows).all(axis=1))]


def _long(numbers: list[bytes], dim: int) -> np.ndarray:
    if all(len(x) == 4 * dim for x in numbers):
        return np.frombuffer(b"".join(numbers), "<f4").reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8") for x in numbers], dtype=np.float64).reshape(-1, dim)


def _counted(batches: Iterator[pa.RecordBatch], by: Hashing) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, _, rows in _by_length(batch):
            full = by.unit(rows, True)
            for table in range(by.tables):
                bucket, count = np.unique(by.nearest(full, table, dim), return_counts=True)
                same = np.ones(len(bucket), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (same * dim, same * table, bucket.astype(np.int64), count.astype(np.int64))], ["dim", "table", "bucket", "n"])


class Shards:
    """How many parts each bucket has, and in which shard each is: one number for each bucket of each table and length of vectors."""

    def __init__(self, counts: list[tuple[int, int, int, int]], by: Hashing, shard_bytes: int) -> None:
        self.parts: dict[tuple[int, int], np.ndarray] = {}
        rows: dict[tuple[int, int], int] = {}
        size = lambda dim: max(1, shard_bytes // (8 * dim))
        for dim, table, bucket, count in counts:
            self.parts.setdefault((dim, table), np.zeros(by.buckets(dim), dtype=np.int64))[bucket] = -(-count // size(dim))
            rows[dim, table] = rows.get((dim, table), 0) + count
        self.shards = {key: -(-count // size(key[0])) for key, count in rows.items()}

    def of(self, dim: int, table: int, bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
        return ((bucket * 2654435761 + part * 40503 + 12345) >> 7) % self.shards[dim, table]


def _dealt(batches: Iterator[pa.RecordBatch], by: Hashing, shards: Shards) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, some, rows in _by_length(batch):
            full, numbers = by.unit(rows, True), pa.array(_short(rows), pa.binary())
            ids = np.asarray(some.column("vec_id")).astype(np.int64)
            for table in range(by.tables):
                bucket = by.nearest(full, table, dim)
                part = (mix(ids.view(np.uint64)) >> np.uint64(1)).astype(np.int64) % np.maximum(shards.parts[dim, table][bucket], 1)
                columns = [np.full(len(ids), dim), np.full(len(ids), table), shards.of(dim, table, bucket, part), bucket.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], some.column("vec_id").cast(pa.int64()), numbers], ["dim", "table", "shard", "bucket", "vec_id", "numbers"])


def _asked(batches: Iterator[pa.RecordBatch], by: Hashing, shards: Shards) -> Iterator[pa.RecordBatch]:
    """A query once for each shard in which it looks, with its buckets there."""
    names = ["dim", "table", "shard", "vec_id", "numbers", "probes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for dim, some, rows in _by_length(batch):
            ids, numbers, full, probes = some.column("vec_id").to_pylist(), _short(rows), by.unit(rows, False), by.probes(dim)
            for table in range(by.tables):
                parts = shards.parts.get((dim, table))
                if parts is None:
                    continue
                out: list[tuple] = []
                for at in range(0, len(full), 64):
                    near = by.nearness(full[at : at + 64], table, dim)
                    for i, best in enumerate(np.argpartition(-near, probes - 1, axis=1)[:, :probes], at):
                        each = parts[best]
                        bucket = np.repeat(best, each)
                        part = np.arange(len(bucket)) - np.repeat(np.cumsum(each) - each, each)
                        shard = shards.of(dim, table, bucket, part)
                        order = np.argsort(shard, kind="stable")
                        for where in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                            if len(where):
                                out.append((dim, table, int(shard[where[0]]), ids[i], numbers[i], np.unique(bucket[where]).astype("<i4").tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best rows; scores are summed from the first component to the last, so that equal vectors tie."""
    s = q @ c.T
    s[q_ids[:, None] == c_ids[None, :]] = -np.inf
    lowest = -np.finfo(float).max / 2
    least = np.maximum(np.partition(s, -k, axis=1)[:, -k], lowest) if s.shape[1] > k else np.full(len(s), lowest)
    slack = 1e-9 * np.maximum(1, np.abs(least))
    i, j = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
    exact = np.zeros(len(i))
    for a, b in zip(q.T, c.T):
        exact += a[i] * b[j]
    order = np.lexsort((c_ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    few = np.arange(len(i)) - np.searchsorted(i, i) < k
    return pd.DataFrame({"query_id": q_ids[i[few]], "vec_id": c_ids[j[few]], "score": exact[few]})


def _few(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k best ids of each query, each once."""
    if not found:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    every = pd.concat(found).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
    return every[every.groupby("query_id").cumcount() < k]


def _in_shard(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query against the rows of its buckets, a bucket at a time."""
    if not len(queries) or not len(rows):
        return _few([], k)
    dim = int(key[0])
    rows = rows.sort_values(["bucket", "vec_id"], kind="stable")
    c_ids, c, bucket = rows["vec_id"].to_numpy(), _long(rows["numbers"].tolist(), dim), rows["bucket"].to_numpy()
    q_ids, q = queries["vec_id"].to_numpy(), _long(queries["numbers"].tolist(), dim)
    probed = [np.frombuffer(x, "<i4") for x in queries["probes"]]
    who = np.repeat(np.arange(len(q)), [len(x) for x in probed])
    order = np.argsort(probed := np.concatenate(probed), kind="stable")
    who, probed = who[order], probed[order]
    found: list[pd.DataFrame] = []
    held = 0
    for b in np.unique(bucket):
        low, high = np.searchsorted(bucket, [b, b + 1])
        mine = who[slice(*np.searchsorted(probed, [b, b + 1]))]
        step = max(1, (1 << 21) // int(high - low))
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            found.append(_best(q_ids[some], q[some], c_ids[low:high], c[low:high], k))
            held += len(found[-1])
        if held > 4 * k * len(q) + 100_000:
            found = [_few(found, k)]
            held = len(found[0])
    return _few(found, k)


def _all_pairs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            found = _best(*unpack(x["q_ids"], x["q_numbers"], x["dim"]), *unpack(x["ids"], x["numbers"], x["dim"]), k)
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)


def nearest(rows: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, fine: int = FINE, shard_bytes: int = SHARD_BYTES, most_queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for usable rows and queries (vec_id, vector)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    n, low, high = rows.agg(F.count("*"), F.min(norm), F.max(norm)).first()
    by = Hashing(tables, float(high) if high and high - low > 1e-6 * high else 0.0, n, fine)
    counted = rows.mapInArrow(partial(_counted, by=by), "dim long, table long, bucket long, n long").groupBy("dim", "table", "bucket").agg(F.sum("n"))
    shards = Shards([tuple(r) for r in counted.collect()], by, shard_bytes)  # at most tables x PAIRS (or the axes) numbers for each length of vectors
    parts = max(1, -(-queries.count() // most_queries))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    dealt = rows.mapInArrow(partial(_dealt, by=by, shards=shards), "dim long, table long, shard long, bucket long, vec_id long, numbers binary").withColumn("part", every)
    asked = queries.mapInArrow(partial(_asked, by=by, shards=shards), "dim long, table long, shard long, vec_id long, numbers binary, probes binary").withColumn("part", part)
    key = ["dim", "table", "shard", "part"]

    def in_shard(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _in_shard(key, queries, rows, k)

    found = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(in_shard, _FOUND)

    def ranked(pairs: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = saved(ranked(found))
    full = first.where(F.col("rank") == k).select("query_id")
    short = queries.join(full, queries["vec_id"] == full["query_id"], "left_anti")
    rest = query_blocks(short)
    n = rest.count()
    if not n:
        return first
    again = ranked(against(blocks(rows), rest, n).mapInArrow(partial(_all_pairs, k=k), _FOUND))
    return first.join(full, "query_id", "left_semi").unionByName(again)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = table.where(F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    return nearest(rows, rows.where("vec_id % 20 = 0"), 20)


#: Exact neighbours: tables of up to 600 rows of one norm are searched whole.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
