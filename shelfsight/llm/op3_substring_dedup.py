"""Removal of word passages that repeat, by suffix automata of reference shards.

A window is `size` consecutive words of one document; words of every window whose
sequence also starts anywhere else (same document included) go.

Method. Streaming every document through automata of every shard would cost shards
times corpus, so the shards are cut such that a window can only occur in one of
them, and meet only what can match there:

1. Each window is filed under its anchor, the leftmost least hash among its word
   k-grams. Equal windows have equal anchors, as far from their starts. Neighbouring
   windows with an anchor at one place are a run, so that no run holds a window twice;
   a document has some eight runs in a hundred words, and only their hashes move.
2. Anchors that occur once hold no repeated window. Under the others, equal runs (told
   apart by 128 bits, those of anchor and run) are one, with the number of its places.
3. One text of each different run goes to its anchor's shard, whose suffix automaton,
   with the number of places of each state, gives each run's matching statistics: windows
   that the automaton has at two places or more go, at all places of the run.
   An anchor with over HOT different runs is not gathered: its windows are compared
   one by one as 128-bit keys in an ordinary aggregation.

Broadcast is not used: a reference as large as the corpus has no size bound. A run with more
than a thousandth of all places (so one of a thousand at most) meets its places by a
broadcast of such runs, so that no task gets them all.

Rows: null texts have no words (n_words 0, the hash of nothing); texts shorter than a
window lose nothing. Fully repeated rows are copies of each other. Rows with one
doc_id but different texts are separate documents. A null doc_id is kept as it is.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, small_batches
from .words import WORD_BASE, mix, ngram_hashes, powers, slices, words_of

SIZE = 35
#: Words of an anchor's k-gram.
GRAM = 12
#: Different runs of an anchor that are gathered at most (some 100 MB as an automaton).
HOT = 2048
#: A run with more than one in so many of all places is a heavy one.
HEAVY = 1000
#: Runs in a shard, about.
SHARD = 1000
_NO_ID = -(1 << 63)


class SuffixAutomaton:
    """Of words, with the number of (weighted) places at which each state's words end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places = [0]
        self.last = 0

    def add(self, word: object, weight: int) -> None:
        following, link, length = self.next, self.link, self.length
        current, p = len(length), self.last
        following.append({})
        length.append(length[p] + 1)
        link.append(0)
        self.places.append(weight)
        while p >= 0 and word not in following[p]:
            following[p][word] = current
            p = link[p]
        if p >= 0:
            q = following[p][word]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                clone = len(length)
                following.append(following[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                self.places.append(0)
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = clone
                    p = link[p]
                link[q] = link[current] = clone
        self.last = current

    def add_text(self, words: list, weight: int, mark: object) -> None:
        """The words, then a mark that occurs in no text, so that no match crosses it."""
        for word in words:
            self.add(word, weight)
        self.add(mark, 0)

    def count(self) -> None:
        """Places of shorter suffixes include those of longer ones; once, after all texts."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] >= 0:
                self.places[self.link[state]] += self.places[state]

    def repeated(self, words: list, size: int) -> list[int]:
        """Starts of the windows of `words` (a text that was added) that are at two places or more."""
        found, state = [], 0
        for at, word in enumerate(words):
            state = self.next[state][word]
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            if at + 1 >= size and self.places[state] > 1:
                found.append(at + 1 - size)
        return found


def _spans(starts: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, how many)."""
    out: list[tuple[int, int]] = []
    for x in starts:
        if out and out[-1][0] + out[-1][1] == x:
            out[-1] = out[-1][0], out[-1][1] + 1
        else:
            out.append((x, 1))
    return out


def _runs(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "text_key", "anchor", "run", "first", "windows"]
    for batch in batches:
        for part in slices(batch, "text"):
            w = words_of(part.column("text"))
            h, row = w.hashes(), w.row
            n = len(h) - size + 1
            if n <= 0:
                continue
            whole = row[size - 1 :] == row[:n]
            least, at, span, width = ngram_hashes(h, gram), np.arange(len(h) - gram + 1, dtype=np.int32), 1, size - gram + 1
            while span < width:  # the leftmost least of ever more k-grams
                step = min(span, width - span)
                later = least[step:] < least[:-step]
                least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
                span += step
            new = np.ones(n, dtype=bool)
            new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
            start = np.flatnonzero(new & whole)
            if not len(start):
                continue
            so_far = np.concatenate([[0], np.cumsum(whole)])
            windows = so_far[np.append(start[1:], n)] - so_far[start]
            up, down = powers(WORD_BASE, len(h) + 1)
            sums = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h * up[: len(h)], out=sums[1:])
            run = mix((sums[start + windows + size - 1] - sums[start]) * down[start], 5)
            of = pa.array(row[start])
            first = start - w.first_word[row[start]]
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(of), part.column("text_key").take(of), pa.array(least[start].view(np.int64)), pa.array(run.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32))], names
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: they are moved between machines twice."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        packed = pa.array([None if not x.is_valid else press.compress(x.as_buffer()) for x in texts], type=pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), packed], ["id", "text_key", "packed"])


def _unpacked(packed: bytes | None, press: zstandard.ZstdDecompressor) -> list[bytes]:
    """The words of a packed text; bytes.split() splits at the same six separators."""
    return press.decompress(packed).split() if packed is not None else []


_TEXTS = "anchor long, run long, n long, id long, text_key long, first int, words string, key binary"


def _run_texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """What each request asks for: a run's words, or under a hot anchor the key of each of its windows. Rows of one id and text follow each other, and the first of them answers for all."""
    press = zstandard.ZstdDecompressor()
    answered = None
    for batch in batches:
        out: list[tuple] = []
        for at, packed, wanted in zip(batch.column("id").to_pylist(), batch.column("packed").to_pylist(), batch.column("wanted").to_pylist()):
            if answered == (at, wanted[0]["text_key"]):
                continue
            answered = at, wanted[0]["text_key"]
            words = _unpacked(packed, press)
            for x in wanted:
                first, last = x["first"], x["first"] + x["windows"]
                if x["hot"]:
                    for i in range(first, last):
                        key = hashlib.blake2b(b" ".join(words[i : i + size]), digest_size=16).digest()
                        out.append((x["anchor"], x["run"], x["n"], at, x["text_key"], i, None, key))
                else:
                    out.append((x["anchor"], x["run"], x["n"], at, x["text_key"], first, b" ".join(words[first : last + size - 1]).decode(), None))
        if out:
            names = [x.split()[0] for x in _TEXTS.split(", ")]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names)


_GONE = "anchor long, run long, n long, id long, text_key long, first int, windows int"


def _shard(group: pd.DataFrame, size: int) -> pd.DataFrame:
    """Repeated windows of each run, as spans from the run's start."""
    group = group.drop_duplicates(["anchor", "run"])
    number: dict[str, int] = {}
    texts = [[number.setdefault(w, len(number)) for w in text.split(" ")] for text in group["words"]]
    automaton = SuffixAutomaton()
    for mark, (words, n) in enumerate(zip(texts, group["n"])):
        automaton.add_text(words, int(n), ~mark)
    automaton.count()
    columns = ["anchor", "run", "n", "id", "text_key", "first"]
    out = []
    for words, row in zip(texts, group[columns].itertuples(index=False, name=None)):
        out += [(*row[:-1], row[-1] + a if row[2] == 1 else a, k) for a, k in _spans(automaton.repeated(words, size))]
    return pd.DataFrame(out, columns=[*columns, "windows"])


def _without(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for at, packed, spans in zip(batch.column("id").to_pylist(), batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
            words = _unpacked(packed, press)
            n = len(words)
            if spans:
                edge = np.zeros(n + 1, dtype=np.int64)
                first = np.array([x["first"] for x in spans])
                np.add.at(edge, first, 1)
                np.add.at(edge, first + np.array([x["windows"] for x in spans]) + size - 1, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            out.append((None if at == _NO_ID else at, n, n - len(words), b" ".join(words)))
        ids, n, gone, kept = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
        )


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space) of each row of docs (doc_id, text)."""
    text = F.col("text").cast("string")
    plain = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    runs = plain.mapInArrow(partial(_runs, size=size, gram=gram), "id long, text_key long, anchor long, run long, first int, windows int")
    often = saved(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    held = saved(runs.join(often, "anchor"))
    place = F.struct("id", "text_key", "first", "windows")
    kinds = saved(held.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(place).alias("at")))
    count = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    kinds = saved(kinds.join(count, "anchor").select("anchor", "run", "n", "at.*", (F.col("kinds") > hot).alias("hot")))

    asked = kinds.groupBy("id", "text_key").agg(F.collect_list(F.struct("anchor", "run", "n", "text_key", "first", "windows", "hot")).alias("wanted"))
    packed = plain.mapInArrow(_packed, "id long, text_key long, packed binary")
    texts = saved(packed.join(asked, ["id", "text_key"]).mapInArrow(partial(_run_texts, size=size), _TEXTS))
    some = texts.where("words is not null")
    shards = max(1, some.count() // shard)
    parts = saved(some.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(partial(_shard, size=size), _GONE))

    # hot anchors: runs at several places go as a whole, the others by their windows
    single = texts.where("key is not null").dropDuplicates(["anchor", "run", "first", "id", "text_key"])
    twice = saved(single.groupBy("key").agg(F.sum("n").alias("places")).where("places > 1").select("key"))
    alone = single.where("n = 1").join(twice, "key").select("id", "text_key", "first", F.lit(1).alias("windows"))
    wide = kinds.where("hot and n > 1").select("anchor", "run", "n", F.lit(0).alias("first"), "windows")

    # windows from a run's start, at all of its places
    known = saved(parts.where("n > 1").select("anchor", "run", "n", "first", "windows").unionByName(wide).withColumnsRenamed({"first": "from", "windows": "many"}))
    places = held.select("anchor", "run", "id", "text_key", "first")
    total = held.count()
    heavy = F.col("n") * HEAVY > total
    few = F.broadcast(known.where(heavy))  # at most HEAVY runs
    rest = places.join(F.broadcast(kinds.where(heavy).select("anchor", "run")), ["anchor", "run"], "left_anti").join(known.where(~heavy), ["anchor", "run"])
    every = places.join(few, ["anchor", "run"]).unionByName(rest).select("id", "text_key", (F.col("first") + F.col("from")).alias("first"), F.col("many").alias("windows"))

    gone = every.unionByName(parts.where("n = 1").select("id", "text_key", "first", "windows")).unionByName(alone)
    spans = gone.groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "windows")).alias("spans"))  # of copies with one id, once
    return packed.join(spans, ["id", "text_key"], "left").mapInArrow(partial(_without, size=size), "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: In SQL: words go where a window of theirs starts at two places or more.
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT rid, i, md5(array_to_string(w[i:i + {SIZE - 1}], ' ')) AS key FROM (SELECT rid, w, unnest(range(1, len(w) - {SIZE - 2})) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY key) AS n FROM p) WHERE n > 1),
g AS (SELECT DISTINCT rid, i + k AS j FROM r, range({SIZE}) t(k)),
k AS (SELECT d.rid, any_value(d.doc_id) AS doc_id, count(*) FILTER (WHERE x.j IS NOT NULL) AS n_words, count(g.j) AS n_removed, string_agg(d.w[x.j], ' ' ORDER BY x.j) FILTER (WHERE g.j IS NULL) AS kept
  FROM d LEFT JOIN (SELECT rid, unnest(range(1, len(w) + 1)) AS j FROM d) x ON x.rid = d.rid LEFT JOIN g ON g.rid = x.rid AND g.j = x.j GROUP BY d.rid)
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
