"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Method. Each document's set of word shingles is sketched by rounds of hashed bin
placement: in round i each shingle falls into one random bin, an empty bin keeps
the least hash it gets, and in t further rounds every shingle goes to bin
i - t, so that all t bins are full and agree between two sets with the
probability of their similarity (concentrated as t independent draws are).
Bands of the bins give buckets; documents of one bucket are candidates. Links are
confirmed on the full sets, and components are taken over confirmed links only.

Groups of copies never become pairs. Documents with equal sets are one class from
the start. Classes that buckets join form clusters; a cluster is dealt out in
chunks of CHUNK classes, each chunk is resolved by one task with an incidence
product, a few classes of each chunk meet again to join what the chunks found, and
at last the classes outside a cluster's largest component (few) are held against
all chunks. Together these cover all pairs of a cluster but those already joined.

Results for odd rows: a null or wordless text has no shingles, links to nothing and
is kept. Rows with one doc_id count as one document whose texts are all linked.
A null doc_id takes no part: component_id null, kept true. Any other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, saved, small_batches, spare
from .words import Words, mix, ngram_hashes, slices, words_of

BANDS, ROWS = 32, 5
#: A similarity of exactly 0.8 misses all bands with probability (1 - 0.8**5)**32 < 4e-6.
CHUNK = 96
PIVOTS = 8
_KEY_BITS = 52
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_keys(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 52-bit key of each distinct shingle, by row; at most 4096 rows."""
    h = w.hashes()
    counts, rows = w.counts, w.row
    keys = ngram_hashes(h, n)
    of = rows[: len(keys)]
    whole = of == rows[n - 1 :] if len(keys) else np.zeros(0, dtype=bool)
    keys, of = [keys[whole]], [of[whole]]
    for k in range(1, n):  # fewer words than a shingle: the whole sequence
        short = np.flatnonzero(counts == k)
        if len(short):
            keys.append(mix(ngram_hashes(h, k)[w.first_word[short]], k))
            of.append(short)
    both = np.concatenate(keys) >> np.uint64(64 - _KEY_BITS) | np.concatenate(of).astype(np.uint64) << np.uint64(_KEY_BITS)
    both.sort()
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both >> np.uint64(_KEY_BITS)).astype(np.int64), both & np.uint64((1 << _KEY_BITS) - 1)


def sketch(rows: np.ndarray, keys: np.ndarray, n_rows: int, t: int) -> np.ndarray:
    """The fast similarity sketch of each row's keys: n_rows x t; rows without keys stay empty."""
    out = np.full(n_rows * t, _EMPTY, dtype=np.uint64)
    left = rows, keys
    for i in range(2 * t):
        of, x = left
        if not len(of):
            break
        h = mix(x, 2 * i + 1)
        bins = (h >> np.uint64(32)) % np.uint64(t) if i < t else np.full(len(x), i - t, dtype=np.uint64)
        slot = of * t + bins.astype(np.int64)
        free = out[slot] == _EMPTY
        np.minimum.at(out, slot[free], mix(x[free], 2 * i + 2) >> np.uint64(1))
        full = (out.reshape(n_rows, t) != _EMPTY).all(axis=1)
        going = ~full[of]
        left = of[going], x[going]
    return out.reshape(n_rows, t)


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            for at in range(0, part.num_rows, 4096):
                few = part.slice(at, 4096)
                w = words_of(few.column("text"), lower=True)
                of, keys = shingle_keys(w, shingle)
                n = few.num_rows
                size = np.bincount(of, minlength=n)
                sums = []
                for seed in (901, 902):
                    total = np.zeros(len(keys) + 1, dtype=np.uint64)
                    np.cumsum(mix(keys, seed), out=total[1:])
                    ends = np.concatenate([[0], np.cumsum(size)])
                    sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                cells = sketch(of, keys, n, bands * rows).reshape(n, bands, rows)
                band = np.zeros((n, bands), dtype=np.uint64)
                for r in range(rows):
                    band = mix(band ^ cells[:, :, r], r)
                band = mix(band + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), 77)
                some = size > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])


def _links(texts: pd.Series, shingle: int) -> np.ndarray:
    """Intersection sizes (off the diagonal) and set sizes (on it) of some documents, from their whole sets.

    The incidence matrix is made in blocks of its columns, and shingles of one document only are left out of it.
    """
    rows, keys = [], []
    for at, text in enumerate(texts):  # one at a time: a chunk may hold long documents
        r, k = shingle_keys(words_of(pa.array([text], type=pa.large_string()), lower=True), shingle)
        rows.append(np.full(len(k), at))
        keys.append(k)
    n = len(rows)
    sizes = np.array([len(k) for k in keys])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    rows, keys = rows[order], keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1 if len(keys) else new
    rows, column = rows[often], column[often]
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    both = np.zeros((n, n))
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, width), dtype=np.float32)
        block[rows[a:b], column[a:b] - at] = 1
        both += block @ block.T
    np.fill_diagonal(both, sizes)
    return both


def _linked(both: np.ndarray, percent: int) -> np.ndarray:
    sizes = np.diag(both)
    union = sizes[:, None] + sizes[None, :] - both
    return (100 * both >= percent * union) & (sizes[:, None] > 0) & (sizes[None, :] > 0)


def _local_roots(links: np.ndarray) -> np.ndarray:
    """The first member of each one's component."""
    n = len(links)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                near = links[front].any(axis=0) & (root < 0)
                front = np.flatnonzero(near)
                root[front] = i
    return root


def _resolve(group: pd.DataFrame, shingle: int, percent: int, pivots: int) -> pd.DataFrame:
    """The components of one chunk: each document with the least of its component; pivot marks a few of the largest one."""
    group = group.sort_values("doc_id", ignore_index=True)
    root = _local_roots(_linked(_links(group["text"], shingle), percent))
    size = np.bincount(root, minlength=len(group))
    largest = np.flatnonzero(root == size.argmax())[:pivots]
    pivot = np.zeros(len(group), dtype=bool)
    pivot[largest] = True
    return pd.DataFrame({"doc_id": group["doc_id"], "root": group["root"], "to": group["doc_id"].to_numpy()[root], "pivot": pivot})


def _resolve_across(group: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    """One link, if there is any, between each straggler and each other component of a chunk."""
    group = group.sort_values(["straggler", "doc_id"], ignore_index=True)
    linked = _linked(_links(group["text"], shingle), percent)
    late = np.flatnonzero(group["straggler"].to_numpy())
    i, j = np.nonzero(linked[late])
    ids, label = group["doc_id"].to_numpy(), group["label"].to_numpy()
    found = pd.DataFrame({"doc_id": ids[late[i]], "to": ids[j], "of": label[late[i]], "other": label[j]})
    return found[found["of"] != found["other"]].drop_duplicates(["doc_id", "other"])[["doc_id", "to"]]


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    percent = round(similarity * 100)
    plain = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = saved(plain.mapInArrow(partial(_sketches, shingle=shingle, bands=bands, rows=rows), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"))
    some = known.where("n_shingles > 0 and doc_id is not null")
    classes = saved(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")))
    member = saved(some.select("doc_id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b", "n_shingles"]).select("doc_id", "rep").distinct())

    # buckets of class representatives, and the clusters that they join
    banded = some.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    buckets = saved(banded.groupBy("band").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("other")).where("center != other").select("band", "center"))
    stars = banded.join(buckets, "band").where("doc_id != center").select(F.col("doc_id").alias("a"), F.col("center").alias("b"))
    cluster = saved(components(stars).withColumnRenamed("node", "doc_id"))
    sizes = saved(cluster.groupBy("root").agg(F.count("*").alias("size")))
    at_hand = saved(plain.join(cluster.join(sizes, "root"), "doc_id").select("doc_id", "text", "root", "size"))

    # chunks, then what a few of each chunk join, until one chunk holds a cluster's pivots
    out = "doc_id long, root long, to long, pivot boolean"
    resolve = partial(_resolve, shingle=shingle, percent=percent, pivots=max(1, min(PIVOTS, chunk // 4)))  # fewer at each round

    def resolved(members: DataFrame) -> DataFrame:
        parts = F.ceil(F.col("size") / chunk)
        dealt = members.withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("doc_id"), parts)).otherwise(F.lit(0)))
        return saved(dealt.groupBy("root", "part").applyInPandas(resolve, out))

    found = resolved(at_hand)
    links = [found.where("doc_id != to").select("doc_id", "to")]
    large = saved(sizes.where(F.col("size") > chunk))
    wide = large
    while wide.head(1):
        pivots = found.where("pivot").join(wide.select("root"), "root", "left_semi").select("doc_id", "root")
        count = saved(pivots.groupBy("root").agg(F.count("*").alias("size")))
        found = resolved(at_hand.select("doc_id", "text").join(pivots, "doc_id").join(count, "root"))
        links.append(found.where("doc_id != to").select("doc_id", "to"))
        wide = saved(count.where(F.col("size") > chunk))

    if large.head(1):
        # outside the largest component of a cluster that had more than one chunk: against all of the cluster
        edges = links[0]
        for more in links[1:]:
            edges = edges.unionByName(more)
        label = saved(components(edges, "doc_id", "to"))
        inside = at_hand.join(large.select("root"), "root", "left_semi")
        inside = saved(inside.join(label.select(F.col("node").alias("doc_id"), F.col("root").alias("label")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
        count = inside.groupBy("root", "label").agg(F.count("*").alias("n"))
        main = saved(count.groupBy("root").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")))
        known_main = inside.join(main, "root").withColumn("parts", F.ceil(F.col("all") / chunk)).withColumn("late_parts", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / chunk)))
        numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        home = known_main.where("all > most").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).withColumn("late_part", F.explode(numbers(F.col("late_parts")))).withColumn("straggler", F.lit(False))
        late = known_main.where("label != main").withColumn("late_part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("late_parts"))).withColumn("part", F.explode(numbers(F.col("parts")))).withColumn("straggler", F.lit(True))
        columns = ["root", "part", "late_part", "doc_id", "text", "label", "straggler"]
        across = home.select(columns).unionByName(late.select(columns)).groupBy("root", "part", "late_part")
        links.append(saved(across.applyInPandas(partial(_resolve_across, shingle=shingle, percent=percent), "doc_id long, to long")))

    # texts of one doc_id are one document
    several = member.groupBy("doc_id").agg(F.min("rep").alias("to"), F.max("rep").alias("other")).where("to != other")
    links.append(member.join(several.select("doc_id", "to"), "doc_id").select(F.col("rep").alias("doc_id"), "to"))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    label = saved(components(edges, "doc_id", "to"))
    final = member.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("component_id"))
    sized = known.select("doc_id", "n_shingles")
    return sized.join(final, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, copies: bool = True) -> DataFrame:
    """The rows of docs whose document is kept, all columns as they are; of rows with one doc_id all stay.

    Without `copies` one row of those that are equal in doc_id and text stays. A row without
    an id is a document of its own, compared by a number beyond all ids.
    """
    least, most = docs.agg(F.coalesce(F.min(F.col("doc_id").cast("long")), F.lit(0)), F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0))).first()
    own = spare(docs.columns, "_near")
    mark, body, row, key = (f"{own}_{x}" for x in ("hash", "text", "row", "id"))
    number = F.monotonically_increasing_id()
    beyond = F.lit(most + 1) + number if most < 1 << 62 else F.lit(least - 1) - number
    numbered = docs.withColumn(mark, F.xxhash64(*docs.columns)).withColumn(body, F.sha2(F.col("text").cast("string"), 256)).withColumn(row, number)
    numbered = saved(numbered.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), beyond)))
    kept = near_duplicates(numbered.select(F.col(key).alias("doc_id"), "text"), shingle, similarity).where("kept").select(F.col("doc_id").alias(key)).distinct()
    rows = numbered.select(key, body, mark, row).join(kept, key, "left_semi")
    if not copies:
        rows = rows.groupBy(key, body).agg(F.min_by(row, F.struct(mark, row)).alias(row))
    return numbered.join(rows.select(row), row, "left_semi").select(docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


#: In SQL: pairs from an index of shingles, and the least id that links reach.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [md5(array_to_string(w, ' '))] ELSE list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' '))) END) AS keys FROM d),
c AS (SELECT min(doc_id) AS id, keys, len(keys) AS n FROM (SELECT doc_id, list_sort(keys) AS keys FROM s WHERE len(keys) > 0) GROUP BY keys),
k AS MATERIALIZED (SELECT id, n, unnest(keys) AS key FROM c),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT id, id AS far FROM c UNION SELECT r.id, l.b FROM r JOIN l ON r.far = l.a),
g AS (SELECT id, min(far) AS least FROM r GROUP BY id)
SELECT s.doc_id, len(s.keys) AS n_shingles, coalesce(g.least, s.doc_id) AS component_id, coalesce(g.least, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON c.keys = list_sort(s.keys) LEFT JOIN g ON g.id = c.id
"""
