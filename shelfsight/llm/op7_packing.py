"""Packing of documents into sequences by cutting-stock column generation.

Method. A document's tokens are cut into full sequences and one remainder, and a remainder
into quarters of a sequence and the rest: what is that short combines almost without
waste (remainders kept whole left 13 % of padding on the test tables, however well they
were combined; cut in halves, 5 %). The lengths of these
remainders make a histogram (at most `size` - 1 numbers, whatever the input);
over it a linear program picks patterns, each a way to fill one sequence. Its columns
are generated: a knapsack by dynamic programming prices all patterns against the
program's duals, until the best one improves the bound by less than GAP. Pattern counts
are rounded down, what is left is filled greedily, and remainders, ranked in each length
class by a hash bucket and their order in it, are dealt to the patterns' slots.

Lengths up to EXACT are classes of their own, longer ones are rounded up to STEP; the
program has some 90 rows. Ranks come from counts of (class, bucket), so that a class
which holds a third of all documents is never sorted in one task. Only the histogram
reaches the driver. Texts are read once and never shuffled.

A text's tokens are those of its words one after the other: the vocabulary's normaliser
and splitter treat white space as a boundary and drop it.

Rows: a null or empty text has the end token only. Repeated rows and rows with one doc_id
are packed each for itself. A null doc_id stays null. Empty tables give no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, small_batches

SIZE, END = 2048, 1
EXACT, STEP = 64, 16
#: Remainders are cut at this part of a sequence.
QUARTERS = 4
GAP, ROUNDS = 0.002, 600
#: Words whose tokens a task keeps at most, and those that the next task starts with (the first met, so the common ones).
CACHE, COMMON = 500_000, 300_000
#: Bytes of words whose tokens a task keeps at most; a word may be as long as a text.
CACHE_BYTES = 64_000_000
#: New parts of words that are encoded together.
JOINED = 4096
#: Texts that are turned into tokens together.
GROUP = 200
#: Remainders in a hash bucket, about.
BUCKET = 1000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters that the normaliser's first steps leave alone, and whose kind all versions of Unicode agree on.
_SETTLED = "\x21-\x7e\xa1-\u024f\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u20ac\u4e00-\u9fa5"
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f\u0430-\u0481\u048a-\u04ff\u4e00-\u9fa5"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_settled = re.compile(f"[{_SETTLED}\n]+").fullmatch
#: The vocabulary's own splitter, over settled characters in lower case; a line feed stands between words.
_parts = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|\n|[^{_LETTER}{_NUMBER}\n]+").findall


class WordTokens:
    """Token ids of whole texts as little-endian 32-bit bytes, word by word.

    The ids of words, and of the parts into which the vocabulary's splitter cuts them, are
    kept. New parts are encoded many at a time in one text and told apart by the
    vocabulary's word ends: the last token of a part, and no other, has one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in words.items() if piece.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        """Back to the common words where there are too many, and to none where too long ones were met."""
        if self.held > CACHE_BYTES:
            self.known, self.parts, self.held = {}, {}, 0
        if len(self.known) > COMMON:
            self.known = dict(islice(self.known.items(), COMMON))
        if len(self.parts) > CACHE:
            self.parts = {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE or self.held > CACHE_BYTES:
            self.forget()
        words = [text.split() for text in texts]
        found = [list(map(self.known.get, some)) for some in words]
        new: set[bytes] = set()
        for some, got in zip(words, found):
            if None in got:
                new.update(w for w, x in zip(some, got) if x is None)
        if new:
            self.learn(new)
            known = self.known
            found = [[known[w] if x is None else x for w, x in zip(some, got)] if None in got else got for some, got in zip(words, found)]
        return [b"".join(got) for got in found]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Words of settled characters by their parts in lower case; others, and those that may hold a special token, whole."""
        every = list(words)
        for at in range(0, len(every), JOINED):
            some = every[at : at + JOINED]
            text = b"\n".join(some).decode()
            low = text.lower()
            if "<|" in text or not _settled(text) or not _settled(low):
                plain = [w for w in some if b"<|" not in w and _settled(w.decode()) and _settled(w.decode().lower())]
                whole = list(set(some).difference(plain))
                self.known.update(zip(whole, [x.tobytes() for x in self.encoded([w.decode() for w in whole])]))
                some, low = plain, b"\n".join(plain).decode().lower()
            if some:
                self.learn_settled(some, _parts(low + "\n"))
        self.held += sum(map(len, every))

    def learn_settled(self, words: list[bytes], cut: list[str]) -> None:
        """Words from their parts, with a line feed after those of each."""
        ends = "\n"
        parts = self.parts
        parts[ends] = b""
        new = list({p for p in cut if p not in parts})
        if new:
            ids = self.encoded([" ".join(new)])[0]
            bounds = np.flatnonzero(self.ends[ids]) + 1
            if len(bounds) == len(new) and bounds[-1] == len(ids):
                body, stops = ids.tobytes(), (bounds * 4).tolist()
                parts.update(zip(new, [body[a:b] for a, b in zip([0, *stops], stops)]))
            else:  # a vocabulary without such word ends
                parts.update(zip(new, [x.tobytes() for x in self.encoded(new)]))
            self.held += sum(map(len, new))
        got = [parts[p] for p in cut]
        last = np.fromiter(map(ends.__eq__, cut), dtype=bool, count=len(cut))
        body, stops = b"".join(got), np.cumsum(np.fromiter(map(len, got), dtype=np.int64, count=len(got)))[last].tolist()
        self.known.update(zip(words, [body[a:b] for a, b in zip([0, *stops], stops)]))


@lru_cache(maxsize=1)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(path)
    last = np.array([end], dtype="<u4").tobytes()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        out: list[tuple] = []
        texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
        bodies = [body for at in range(0, len(texts), GROUP) for body in tokens.ids(texts[at : at + GROUP])]
        for doc, body in zip(ids, bodies):
            body += last
            total = len(body) // 4
            cuts = [*range(0, total, size), total]
            if total - cuts[-2] < size:
                cuts[-1:] = [*range(cuts[-2] + size // QUARTERS, total, size // QUARTERS), total]
            for start, stop in zip(cuts, cuts[1:]):
                piece = body[start * 4 : stop * 4]
                out.append((doc, start, stop - start, zlib.crc32(piece), total))
        if out:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
    tokens.forget()


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable way to fill a sequence, each length as often as wanted."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes, worth = sizes[order], worth[order]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        n = upto[w]
        value[w], pick[w] = value[w - 1], -1
        if n:
            gain = value[w - sizes[:n]] + worth[:n]
            at = gain.argmax()
            if gain[at] > value[w] + 1e-12:
                value[w], pick[w] = gain[at], at
    counts = np.zeros(len(sizes), dtype=np.int64)
    w = capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[order[pick[w]]] += 1
            w -= sizes[pick[w]]
    return float(value[capacity]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns (how often each length) and how many sequences follow each; together they hold the demand."""
    m = len(sizes)
    if not m:
        return []
    columns = [np.where(np.arange(m) == i, capacity // sizes[i], 0).astype(np.int64) for i in range(m)]
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand
    for _ in range(rounds):
        worth = inverse.sum(axis=0)  # each pattern costs one sequence
        value, column = best_pattern(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + gap:
            break
        enter = inverse @ column
        going = enter > 1e-9
        ratio = np.full(m, np.inf)
        ratio[going] = x[going] / enter[going]
        leave = int(ratio.argmin())
        step = ratio[leave]
        x = np.maximum(x - step * enter, 0)
        x[leave] = step
        row = inverse[leave] / enter[leave]
        inverse -= np.outer(enter, row)
        inverse[leave] = row
        columns[leave] = column
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    for column, times in zip(columns, np.floor(x + 1e-9).astype(np.int64)):
        if times > 0 and column.any():
            out.append((column, int(times)))
            left -= column * times
    left = np.maximum(left, 0)
    descending = np.argsort(-sizes)
    while left.any():
        room, column = capacity, np.zeros(m, dtype=np.int64)
        for c in descending:
            n = min(left[c], room // sizes[c])
            column[c] = n
            room -= n * sizes[c]
        times = int(min(left[column > 0] // column[column > 0]))
        out.append((column, times))
        left -= column * times
    return out


def class_of(length, exact: int = EXACT, step: int = STEP):
    """The size of a length's class, for columns and for numbers of numpy."""
    rounded = (length + step - 1) - (length + step - 1) % step
    return F.when(length <= exact, length).otherwise(rounded).cast("int") if not isinstance(length, np.ndarray) else np.where(length <= exact, length, rounded)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, bucket: int = BUCKET) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    plain = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = saved(plain.mapInArrow(partial(_pieces, path=path, size=size, end=end), kind))
    rest = pieces.where(F.col("length") < size).withColumn("class", class_of(F.col("length")))
    histogram = dict(rest.groupBy("class").agg(F.count("*")).collect())  # at most size - 1 classes
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)

    slots, begun, sequences = [], dict.fromkeys(sizes.tolist(), 0), 0
    for column, times in patterns(sizes, demand, size):
        for c in np.flatnonzero(column):
            s, each = int(sizes[c]), int(column[c])
            slots.append((s, begun[s], begun[s] + each * times, each, sequences))
            begun[s] += each * times
        sequences += times
    # some hundred patterns of a few classes each, whatever the input
    slots = spark.createDataFrame(slots, "class int, low long, high long, each long, first long")

    n_buckets = max(1, int(demand.sum()) // bucket)
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_buckets)))
    counts = dealt.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("nth", nth).join(saved(before).hint("merge"), ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("nth"))
    inside = (ranked["class"] == slots["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(slots), inside).withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank")
    offset = F.sum("length").over(order) - F.col("length")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    packed = placed.withColumn("offset", offset).select(*columns, "offset")
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", F.monotonically_increasing_id() + sequences).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full.select(*columns, "offset"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
