"""Grouping of spelling variants by blocked Gram matrices of letter counts.

Method. Words are dealt to blocks of adjacent lengths: block n has the words of n characters and those
of n + 1. The products of a block's letter counts (NumPy, in strips of rows) give squared distances;
one replaced character is a distance of two between words of one length, one inserted or
deleted a distance of one between neighbouring lengths, and pairs that pass are verified character
by character. Only verified pairs leave a task.

A block of over TILE words is dealt anew, so that products grow with the words and not with their
square: of the characters in which its words may differ, either the first half or the second is
the same in two near words, so each word goes to a block of those that share its first half and to one of
those that share its second, until blocks are small or a single character is left (then they hold
no more words than an alphabet has letters and pairs of letters). A word is copied twice at a step, and only
in large blocks; steps end after the logarithm of the longest word. Two words may meet in several
blocks; their link counts once.

Each task adds up words before they are shuffled, so a frequent word is a few rows. Chains of forms at least double
their count at every step; they are followed by doubling jumps. Only numbers of rows reach the driver.

Rows: a null or empty text has no words; a null doc_id counts as an empty one in the hash.
Repeated rows count each. Texts are taken whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, small_batches

LEAST_LENGTH, LEAST_COUNT, DROP, RATIO = 5, 3, 97, 2
#: Words of a block whose products are made in one task, and rows of a strip.
TILE, STRIP = 4096, 512
#: Different words that a task adds up before it hands them on.
HELD = 200_000
#: Characters of pairs that are compared at once.
CELLS = 1 << 22

#: Letters that words are made of: a place in the count vector for each.
PLACES = {c: i for i, c in enumerate([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])}


def _counted(batches: Iterator[pa.RecordBatch], least: int, drop: int) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
            if not text.is_valid:
                continue
            seen = Counter(runs(text.as_py().lower().decode("utf-8", "replace")))
            base = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for word, n in seen.items():
                h = zlib.crc32(word.encode(), base)
                if h % drop == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                total[word] += n
            if len(total) > HELD:
                yield out()
                total.clear()
    if total:
        yield out()


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """word, n of docs (doc_id, text): words of so many characters and occurrences at least."""
    plain = small_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = plain.mapInArrow(partial(_counted, least=least_length, drop=drop), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Rows of counts of the places of PLACES; one more column takes all other characters."""
    m, n = codes.shape
    table = np.full(max(PLACES) + 1, len(PLACES))
    table[list(PLACES)] = list(PLACES.values())
    place = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], len(PLACES))
    flat = np.bincount((np.arange(m)[:, None] * (len(PLACES) + 1) + place).ravel(), minlength=m * (len(PLACES) + 1))
    return flat.reshape(m, -1).astype(np.float32 if n < 2048 else np.float64)  # products stay whole numbers


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether what two words share at the beginning and at the end covers the shorter."""
    n = short.shape[1]
    head = np.minimum.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    tail = np.minimum.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def near_pairs(short: np.ndarray, long: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether of two lengths, rows of short, rows of short or long) of the near pairs in a block of character codes."""
    if not len(short):
        return
    counts = {False: letter_counts(short), True: letter_counts(long) if len(long) else None}
    own = counts[False]
    norms = {k: (x * x).sum(axis=1) for k, x in counts.items() if x is not None}
    step = max(1, CELLS // short.shape[1])
    for longer, other in counts.items():
        if other is None:
            continue
        for at in range(0, len(own), STRIP):
            strip = own[at : at + STRIP]
            apart = norms[False][at : at + STRIP, None] + norms[longer][None, :] - 2 * (strip @ other.T)
            i, j = np.nonzero(apart <= 2)
            i += at
            if not longer:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), step):
                a, b = i[k : k + step], j[k : k + step]
                near = one_inserted(short[a], long[b]) if longer else one_replaced(short[a], short[b])
                yield longer, a[near], b[near]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near, near_n both ways for the near pairs of each block; a block's rows follow each other."""

    def pairs(rows: list[tuple[str, int]], length: int) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in rows if len(r[0]) == n] for n in (length, length + 1)]
        if not sides[0] or len(rows) < 2:
            return
        words, counts = [np.array([r[0] for r in s], dtype=object) for s in sides], [np.array([r[1] for r in s], dtype=np.int64) for s in sides]
        codes = [_codes([r[0] for r in s], n) for s, n in zip(sides, (length, length + 1))]
        for longer, a, b in near_pairs(*codes):
            if len(a):
                u, v, n, m = words[0][a], words[longer][b], counts[0][a], counts[longer][b]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in (((u, v), pa.string()), ((v, u), pa.string()), ((m, n), pa.int64()))], ["word", "near", "near_n"])

    held: list[tuple[str, int]] = []
    key, length = None, 0
    for batch in batches:
        for k, of, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "length", "word", "n"))):
            if k != key:
                yield from pairs(held, length)
                key, length, held = k, of, []
            held.append((word, n))
    yield from pairs(held, length)


def _halves(word: Column, length: Column, head: Column, tail: Column) -> Column:
    """The blocks into which a word of the block (length, head, tail) goes: one more half of what is open is shared."""
    left = length - head - tail
    half = F.floor(left / 2).cast("int")
    return F.array(F.struct((head + half).alias("head"), tail.alias("tail")), F.struct(head.alias("head"), (tail + left - half).cast("int").alias("tail")))


def blocks(words: DataFrame, tile: int = TILE) -> DataFrame:
    """length, head, tail, key, word, n: words of `length` characters or one more that share the first `head` and the last `tail`, tile at most where these leave more than one open."""
    size = F.length("word").cast("int")
    open_ = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length"), F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit("").alias("key"))
    of = ["length", "head", "tail", "key"]
    done = None
    while True:
        open_ = saved(open_)
        large = open_.groupBy(*of).agg(F.count("*").alias("_n")).where((F.col("_n") > tile) & (F.col("length") - F.col("head") - F.col("tail") > 1)).drop("_n")
        large = saved(large.withColumn("_large", F.lit(True)))
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        marked = open_.join(large, of, "left")
        small = marked.where("_large is null").drop("_large")
        done = small if done is None else done.unionByName(small)
        halves = marked.where("_large").select("word", "n", "length", F.explode(_halves(F.col("word"), F.col("length"), F.col("head"), F.col("tail"))).alias("x")).select("word", "n", "length", "x.*")
        open_ = halves.withColumn("key", F.concat(F.substring("word", 1, F.col("head")), F.lit("|"), F.expr("right(word, tail)")))


def links(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, near, near_n: near words of words (word, n), each once."""
    dealt = blocks(words, tile).withColumn("key", F.concat_ws(":", "length", "head", "tail", "key")).select("key", "length", "word", "n")
    met = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "word string, near string, near_n long")
    return met.distinct()


def forms(words: DataFrame, tile: int = TILE, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root for words (word, n)."""
    near = links(words, tile).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    known = words.join(near, "word", "left")
    enough = -F.col("best.less") >= F.col("n") * ratio
    known = saved(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    jumps = saved(known.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = saved(jumps.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        jumps = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return known.join(jumps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = saved(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return forms(words).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = f"""
WITH RECURSIVE step AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS tab FROM range(256) t(i)
), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), seen AS (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS hashed FROM run WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run
), byte AS (
  SELECT run, n, flatten(list_transform(string_split(hashed, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END)) AS b FROM seen
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) AS h FROM byte, step
), word AS MATERIALIZED (
  SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND sum(n) >= {LEAST_COUNT}
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON b.word = a.rest
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word
), form AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * w.n THEN (SELECT min(near) FROM near x WHERE x.word = w.word AND x.near_n = most) END AS form, CASE WHEN most >= {RATIO} * w.n THEN most END AS form_n
  FROM word w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, coalesce(form, word) AS root FROM form
  UNION SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON c.word = f.word JOIN form e ON e.word = c.root AND e.form IS NULL
"""
