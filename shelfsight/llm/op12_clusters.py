"""Centroid clustering of whole-number vectors with a pivot table (LAESA).

Method. Components become whole numbers, floor(SCALE * x). Vectors are filed once as blocks, each
with its vectors' distances to fixed pivots; pivots are starting centroids, each next one the
farthest from those before it. In a round, centroids are measured to the pivots, and the largest
difference of a vector's and a centroid's pivot distances is a lower bound of their own distance.
The centroid with the least bound is measured first, then every centroid whose bound
isn't above that; measured distances are exact whole numbers, and bounds, which are
doubles, have a margin of 1e-9 of both distances, so no nearest centroid and no tie is lost. A vector's
answer is the nearest centroid, of equally near ones the one with the smaller number.

A task sums the vectors of each cluster and hands on at most k * dim sums, cut in limbs of 30 bits, that Spark adds
up; so sums are exact at any size. Only centroids and their sums (k * dim numbers) reach the driver, and
only centroids go to tasks.

Rows: vectors that are null, have another number of components, or hold a null or non-finite one
(before or after scaling) take no part. Repeated rows are vectors of their own. A row without
vec_id is clustered but starts no centroid; of rows with one vec_id each may start one, ordered by their
components. With fewer than k vectors that have an id there are that many centroids; with none, no rows. Empty
clusters keep their centroid. Numbers too large for 64-bit sums (a component of 2**26 and more) are
counted with Python's integers without bounds; a distance or sum above 2**63 - 1 is returned as that. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved
from .vectors import matrix, usable

DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
PIVOTS = 8
#: Rows of a block; a block of 64 dimensions is 1 MB.
BLOCK = 2048
#: Components below this keep squared distances of up to 2**9 dimensions within 64 bits.
SAFE = 1 << 26
LIMB = 30
MOST = (1 << 63) - 1
MARGIN = 1e-9


def whole(numbers: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers, or as Python's if any of them isn't safe."""
    scaled = np.floor(numbers.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() >= SAFE:
        return np.array([[int(x) for x in row] for row in scaled], dtype=object).reshape(scaled.shape)
    return scaled.astype(np.int64)


def unpacked(numbers: bytes, wide: bool, dim: int) -> np.ndarray:
    if wide:
        return np.array([int(x) for x in numbers.split(b",")], dtype=object).reshape(-1, dim)
    return np.frombuffer(numbers, np.int64).reshape(-1, dim)


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = rows - point
    return (apart * apart).sum(axis=1)


def safe(rows: np.ndarray) -> bool:
    return rows.dtype != object


def chosen_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Numbers of points, the first one and each next one the farthest from those taken (ties: smaller number)."""
    taken = [0][: len(points)]
    while taken and len(taken) < min(n, len(points)):
        near = np.min([squared(points, points[i]) for i in taken], axis=0)
        if not near.max() > 0:
            break
        taken.append(int(near.argmax()))
    return points[taken]


def _filed(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, scale: int, block: int) -> Iterator[pa.RecordBatch]:
    """n, wide, ids, numbers and pivot distances of blocks of vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            ids = part.column("vec_id")
            rows = whole(matrix(part.column("vector")), scale)
            wide = not safe(rows)
            numbers = b",".join(str(x).encode() for x in rows.ravel()) if wide else rows.tobytes()
            table = b"" if wide or not safe(pivots) else np.sqrt(np.stack([squared(rows, p) for p in pivots], axis=1).astype(np.float64)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([wide]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([numbers], pa.binary()), pa.array([table], pa.binary())], ["n", "wide", "ids", "numbers", "pivots"])


def nearest(rows: np.ndarray, table: np.ndarray | None, points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest point, its squared distance, and how many distances were measured."""
    n, k = len(rows), len(points)
    if table is None or not safe(points):
        every = np.stack([squared(rows, p) for p in points], axis=1)
        best = np.array([min(range(k), key=lambda c: (d[c], c)) for d in every], dtype=np.int64)
        return best, every[np.arange(n), best], n * k
    of_points = np.sqrt(np.stack([squared(points, p) for p in pivots], axis=1).astype(np.float64))
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        own, far = table[:, p, None], of_points[None, :, p]
        np.maximum(bound, np.abs(own - far) - MARGIN * (own + far), out=bound)
    first = bound.argmin(axis=1)
    apart = rows - points[first]
    exact = np.full((n, k), MOST, np.int64)
    exact[np.arange(n), first] = (apart * apart).sum(axis=1)
    reach = np.sqrt(exact[np.arange(n), first].astype(np.float64)) * (1 + MARGIN)
    measured = n
    for c in range(k):
        asked = np.flatnonzero((bound[:, c] <= reach) & (first != c))
        exact[asked, c] = squared(rows[asked], points[c])
        measured += len(asked)
    best = exact.argmin(axis=1)
    return best, exact[np.arange(n), best], measured


def _table(pivots: bytes, n: int) -> np.ndarray | None:
    return np.frombuffer(pivots, np.float64).reshape(n, -1) if pivots else None


def _sums(batches: Iterator[pa.RecordBatch], points: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """cluster, axis, limb, part: sums of the vectors of each cluster; axis -1 is their number, axis -2 the distances measured for them."""
    k, dim = points.shape
    sums = np.zeros((k, dim + 2), dtype=object)
    for batch in batches:
        for n, wide, numbers, table in zip(*(batch.column(c).to_pylist() for c in ("n", "wide", "numbers", "pivots"))):
            rows = unpacked(numbers, wide, dim)
            best, _, measured = nearest(rows, _table(table, n), points, pivots)
            for c in np.unique(best):
                mine = best == c
                sums[c, :dim] += rows[mine].sum(axis=0)
                sums[c, dim] += int(mine.sum())
            sums[0, dim + 1] += measured
    out = []
    for c in range(k):
        for axis in range(dim + 2):
            rest, limb = abs(int(sums[c, axis])), 0
            while rest:
                part = rest & ((1 << LIMB) - 1)
                out.append((c, axis if axis < dim else dim - 1 - axis, limb, part if sums[c, axis] > 0 else -part))
                rest, limb = rest >> LIMB, limb + 1
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "axis", "limb", "part"])


def _answers(batches: Iterator[pa.RecordBatch], points: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, wide, ids, numbers, table in zip(*(batch.column(c).to_pylist() for c in ("n", "wide", "ids", "numbers", "pivots"))):
            best, apart, _ = nearest(unpacked(numbers, wide, points.shape[1]), _table(table, n), points, pivots)
            far = pa.array([min(int(x), MOST) for x in apart], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best.astype(np.int32)), far], ["vec_id", "cluster", "distance"])


def kept_vectors(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id, vector of the rows (vec_id, embedding) that take part."""
    vector = F.col("embedding").cast("array<double>")
    fits = usable(vector) & (F.size(vector) == dim) & ~F.exists(vector, lambda x: F.abs(x * scale) == float("inf"))
    return rows.where(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))


def clusters(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, n_pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, list[float]]:
    """vec_id, cluster, distance of each vector of rows (vec_id, embedding); the last centroids; and for each round the share of distances that were measured."""
    kept = kept_vectors(rows, dim, scale)
    spark = rows.sparkSession
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.where("vec_id is not null").orderBy(draw, "vector").limit(k).select("vector").collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64), []
    points = whole(np.array([r.vector for r in start], dtype=np.float64), scale)
    pivots = chosen_pivots(points, n_pivots)
    filed = saved(kept.mapInArrow(partial(_filed, pivots=pivots, scale=scale, block=BLOCK), "n int, wide boolean, ids array<bigint>, numbers binary, pivots binary"))
    shares = []
    for _ in range(rounds):
        parts = filed.mapInArrow(partial(_sums, points=points, pivots=pivots), "cluster int, axis int, limb int, part long")
        total = np.zeros((len(points), dim + 2), dtype=object)
        for c, axis, limb, part in parts.groupBy("cluster", "axis", "limb").agg(F.sum("part")).collect():
            total[c, axis if axis >= 0 else dim - 1 - axis] += part << (LIMB * limb)
        shares.append(total[0, dim + 1] / max(1, total[:, dim].sum() * len(points)))
        moved = [[s // t[dim] for s in t[:dim]] if t[dim] else list(map(int, p)) for t, p in zip(total, points)]
        big = max(abs(x) for p in moved for x in p) >= SAFE
        points = np.array(moved, dtype=object if big else np.int64)
    return filed.mapInArrow(partial(_answers, points=points, pivots=pivots), "vec_id long, cluster int, distance long"), points, shares


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, points, _ = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = saved(found)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    # one row a centroid, of which there are K at most
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points.tolist())], "cluster int, centroid_sha256 string")
    fits = lambda x: F.least(x, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    known = sums.join(digests, "cluster").crossJoin(sums.agg(F.sum("own").alias("every"))).select("cluster", fits(F.col("own")).alias("cluster_inertia"), fits(F.col("every")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    """Vectors' nearest of the centroids c{i}, and the centroids after them."""
    return f"""
d{i} AS MATERIALIZED (SELECT v.n, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN c{i} c ON c.axis = v.axis GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT n, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY n),
m{i} AS (SELECT a.cluster, v.axis, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS m FROM a{i} a JOIN v ON v.n = a.n GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, c.axis, CASE WHEN m IS NULL THEN c.x ELSE (s - ((s % m) + m) % m) // m END AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster AND m.axis = c.axis)"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
), v AS MATERIALIZED (
  SELECT n, vec_id, unnest(range({DIM})) AS axis, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept
), first AS (
  SELECT n, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < {K}
), c0 AS MATERIALIZED (SELECT f.cluster, v.axis, v.x FROM first f JOIN v ON v.n = f.n),{",".join(_round(i) for i in range(ROUNDS))},
d AS MATERIALIZED (SELECT v.n, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN c{ROUNDS} c ON c.axis = v.axis GROUP BY ALL),
a AS MATERIALIZED (SELECT n, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d GROUP BY n),
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY axis)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a JOIN kept USING (n) JOIN h ON h.cluster = a.cluster
"""
