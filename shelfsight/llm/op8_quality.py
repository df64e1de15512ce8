"""Document quality by a linear-chain conditional random field over lines.

Method. Every line is described by shares of kinds of characters and words, by its
length and by whether it repeats, its neighbours by the same numbers. A two-state chain
(bad, good) is fitted by maximum conditional likelihood on lines of labelled documents,
each line having its document's label; forward-backward gives the probability that each
line is good, and a document's score is that of its lines weighted by their lengths,
put on the scale of the labels by a logistic curve fitted on the same documents.

The fit takes at most TRAIN documents, those with the least hash of their id among the
labelled ones that may be learned from, and of each at most STRETCH lines in a row, from a
place that the hash of its features settles: at most TRAIN * STRETCH lines reach the driver,
however long documents are. Everything else is over whole texts of all rows. Nothing but
the text enters a score.

Rows: texts without words (null, empty, blank) score the share of good documents in the
fitted sample. Without labels of both kinds every score is that share (1 if there are
none). Repeated rows score alike; a null doc_id is scored and is not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches
from .words import WORD_BASE, mix, powers, slices, words_of

#: The most labelled documents that a fit takes.
TRAIN = 4000
#: The most lines of one of them.
STRETCH = 64
THRESHOLD = 0.7
STEPS, RATE, RIDGE = 250, 0.08, 1e-4

_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"%$#&*", b"|<>{}[]=_~^\\/@+", b"\"'()-")
_ENDS = (b"!", b"%$#&*", b"|", b".", b",")


def _tables(groups: tuple[bytes, ...]) -> np.ndarray:
    out = np.zeros((len(groups), 256), dtype=np.int32)
    for i, group in enumerate(groups):
        out[i, list(group)] = 1
    return out


_CHARS, _LAST = _tables(_GROUPS), _tables(_ENDS)


@dataclass
class Lines:
    """Lines with words of some documents: features, lengths, and where each document begins."""

    features: np.ndarray
    length: np.ndarray
    first: np.ndarray  # of each document, and the end of the last


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of whole numbers between bounds."""
    total = np.cumsum(values)
    total = np.concatenate([np.zeros(1, total.dtype), total])  # a plain 0 would turn uint64 into float64
    return total[first[1:]] - total[first[:-1]]


def _float_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each document's values alone, whatever stands before it."""
    out = np.zeros(len(first) - 1)
    has = np.diff(first) > 0
    if has.any():
        out[has] = np.add.reduceat(values, first[:-1][has])
    return out


def lines_of(column: pa.Array) -> Lines:
    w = words_of(column)
    if not len(w.start):
        return Lines(np.zeros((0, 32), np.float32), np.zeros(0), np.zeros(len(w.first_word), np.int64))
    # a line begins at a document's first word, and at the first word after a line feed
    feeds = np.concatenate([[0], np.cumsum(w.data == 10)])
    row, line_no = w.row, feeds[w.start]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (line_no[1:] != line_no[:-1])])
    first_word = np.append(np.flatnonzero(new), len(row))
    start, end = w.start[first_word[:-1]], w.end[first_word[1:] - 1]
    n_words, n_bytes = np.diff(first_word), end - start
    span = np.concatenate([first_word])
    long = w.end - w.start
    h = w.hashes()
    line = np.cumsum(new) - 1
    key = (h >> np.uint64(24)) | (line.astype(np.uint64) << np.uint64(40))
    key.sort()
    kinds = np.bincount((key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=len(n_words))
    same = np.concatenate([[False], (h[1:] == h[:-1]) & ~new[1:]])
    up, down = powers(WORD_BASE, len(h) + 1)
    text = mix(_sums(h * up[: len(h)], span) * down[first_word[:-1]]) ^ n_words.astype(np.uint64)
    of = row[first_word[:-1]]
    order = np.lexsort((text, of))
    run = np.concatenate([[True], (text[order][1:] != text[order][:-1]) | (of[order][1:] != of[order][:-1])])
    group = np.cumsum(run) - 1
    copies = np.empty(len(of))
    copies[order] = np.bincount(group)[group]
    columns = []
    for table in _CHARS:
        total = np.concatenate([[0], np.cumsum(table[w.data])])
        columns.append((total[end] - total[start]) / n_bytes)
    last = w.data[w.end - 1]
    for table in _LAST:
        columns.append(_sums(table[last], span) / n_words)
    head = w.data[w.start]
    columns += [
        _sums((head >= 65) & (head <= 90), span) / n_words,
        _sums(long <= 2, span) / n_words,
        _sums(long <= 4, span) / n_words,
        _sums(long >= 12, span) / n_words,
        _sums(long >= 30, span) / n_words,
        _sums(long, span) / n_words / 10,
        np.sqrt(np.maximum(_sums(long.astype(float) ** 2, span) / n_words - (_sums(long, span) / n_words) ** 2, 0)) / 10,
        kinds / n_words,
        _sums(same, span) / n_words,
        np.log1p(n_words) / 5,
        np.log1p(n_bytes) / 8,
        np.minimum(copies - 1, 5) / 5,
        (n_bytes - _sums(long, span)) / n_bytes,
    ]
    plain = np.column_stack(columns).astype(np.float32)
    counts = np.bincount(of, minlength=len(w.first_word) - 1)
    return Lines(plain, n_bytes.astype(np.float64), np.concatenate([[0], np.cumsum(counts)]))


def _beside(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """x with that of the line before and of the line after it; 0 beyond a document."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    has = np.diff(first) > 0
    before[first[:-1][has]] = 0
    after[first[1:][has] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def marginals(node: np.ndarray, edge: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each line's two states, and expected transitions, by forward-backward over all documents at once."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, n = first[:-1][order], n[order]
    most = int(n[0]) if len(n) else 0
    going = [int(np.searchsorted(-n, -t, side="left")) for t in range(most + 1)]  # documents with more than t lines
    bad, good = np.ascontiguousarray(node[:, 0]), np.ascontiguousarray(node[:, 1])
    (bb, bg), (gb, gg) = edge
    f_bad, f_good, b_bad, b_good = bad.copy(), good.copy(), np.zeros_like(bad), np.zeros_like(good)
    for t in range(1, most):
        i = at[: going[t]] + t
        x, y = f_bad[i - 1], f_good[i - 1]
        f_bad[i] += np.logaddexp(x + bb, y + gb)
        f_good[i] += np.logaddexp(x + bg, y + gg)
    for t in range(most - 2, -1, -1):
        i = at[: going[t + 1]] + t
        x, y = bad[i + 1] + b_bad[i + 1], good[i + 1] + b_good[i + 1]
        b_bad[i] = np.logaddexp(bb + x, bg + y)
        b_good[i] = np.logaddexp(gb + x, gg + y)
    every = np.logaddexp(f_bad + b_bad, f_good + b_good)
    p = np.exp(np.column_stack([f_bad + b_bad, f_good + b_good]) - every[:, None])
    inner = np.ones(len(node), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    came, goes = (f_bad[i - 1], f_good[i - 1]), (bad[i] + b_bad[i] - every[i], good[i] + b_good[i] - every[i])
    return p, np.array([[np.exp(came[a] + edge[a, b] + goes[b]).sum() for b in (0, 1)] for a in (0, 1)])


@dataclass
class Model:
    cuts: np.ndarray  # quantiles of each feature
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edge: np.ndarray
    curve: tuple[float, float]
    prior: float

    def described(self, lines: Lines) -> np.ndarray:
        x = (lines.features - self.mean) / self.scale
        steps = (lines.features[:, :, None] > self.cuts.T[None]).reshape(len(x), self.cuts.size)
        return np.concatenate([_beside(np.clip(x, -4, 4), lines.first), steps, np.ones((len(x), 1))], axis=1)

    def log_odds(self, lines: Lines) -> np.ndarray:
        """Of each document's length-weighted share of good lines; nan without lines."""
        node = np.zeros((len(lines.length), 2))
        node[:, 1] = (self.described(lines) * self.weights).sum(axis=1)  # a product of matrices rounds by a row's place
        p, _ = marginals(node, self.edge, lines.first)
        weight = _float_sums(lines.length, lines.first)
        share = _float_sums(lines.length * p[:, 1], lines.first) / np.where(weight > 0, weight, np.nan)
        return np.log((share + 1e-4) / (1 - share + 1e-4))

    def scores(self, lines: Lines) -> np.ndarray:
        a, b = self.curve
        return np.nan_to_num(1 / (1 + np.exp(-(a * self.log_odds(lines) + b))), nan=self.prior)


def fit(lines: Lines, good: np.ndarray) -> Model:
    """Maximum conditional likelihood by gradient steps with adapted rates."""
    x = lines.features
    prior = float(good.mean()) if len(good) else 1.0
    cuts = np.quantile(x, [0.02, 0.1, 0.3, 0.7, 0.9, 0.98], axis=0) if len(x) else np.zeros((6, x.shape[1]))
    model = Model(cuts, x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), (x.std(axis=0) if len(x) else np.zeros(x.shape[1])) + 1e-3, np.zeros(0), np.zeros((2, 2)), (0.0, 0.0), prior)
    design = model.described(lines)
    model.weights = np.zeros(design.shape[1])
    if len(set(good.tolist())) < 2 or not len(x):
        model.curve = (0.0, float(np.log((prior + 1e-9) / (1 - prior + 1e-9))))
        return model
    y = np.repeat(good, np.diff(lines.first)).astype(np.int64)
    inner = np.ones(len(y), dtype=bool)
    inner[lines.first[:-1][np.diff(lines.first) > 0]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    parameters = np.zeros(design.shape[1] + 4)
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    design = design.astype(np.float32)  # half the memory to pass over at each step
    for step in range(1, STEPS + 1):
        node = np.zeros((len(y), 2))
        node[:, 1] = design @ parameters[:-4].astype(np.float32)
        p, pairs = marginals(node, parameters[-4:].reshape(2, 2), lines.first)
        slope = np.concatenate([(y - p[:, 1]).astype(np.float32) @ design, (seen - pairs).ravel()]) / len(y) - RIDGE * parameters
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        parameters += RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.edge = parameters[:-4], parameters[-4:].reshape(2, 2)
    odds = model.log_odds(lines)
    some = ~np.isnan(odds)
    odds, label = odds[some], good[some]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve
        s = 1 / (1 + np.exp(-(a * odds + b)))
        w = s * (1 - s) + 1e-6
        slope = np.array([((label - s) * odds).sum() - 1e-3 * a, (label - s).sum()])
        bend = np.array([[(w * odds * odds).sum() + 1e-3, (w * odds).sum()], [(w * odds).sum(), w.sum()]])
        da, db = np.linalg.solve(bend, slope)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    model.curve = (max(a, 1e-3), b)
    return model


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            lines = lines_of(part.column("text"))
            stretches = [_stretch(lines, i) for i in range(part.num_rows)]
            features, length = ([a[x:y].tobytes() for x, y in stretches] for a in (lines.features, lines.length))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("good"), pa.array(features, pa.binary()), pa.array(length, pa.binary())], ["doc_id", "good", "features", "length"])


def _stretch(lines: Lines, i: int) -> tuple[int, int]:
    """At most STRETCH lines of a document that follow each other."""
    low, high = int(lines.first[i]), int(lines.first[i + 1])
    if high - low > STRETCH:
        low += zlib.crc32(lines.features[low:high].tobytes()) % (high - low - STRETCH + 1)
    return low, min(high, low + STRETCH)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            scores = model.scores(lines_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in part.schema.names if c != "text"] + [pa.array(scores)], [c for c in part.schema.names if c != "text"] + ["score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Model:
    """A model from labelled documents that aren't held out; labels: doc_id, quality."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = texts.mapInArrow(_described, "doc_id long, good int, features binary, length binary").dropDuplicates(["doc_id"]).collect()  # at most `most` documents of STRETCH lines
    rows.sort(key=lambda r: r["doc_id"])
    width = lines_of(pa.array(["a"])).features.shape[1]
    features = [np.frombuffer(r["features"], dtype=np.float32).reshape(-1, width) for r in rows]
    lengths = [np.frombuffer(r["length"], dtype=np.float64) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lengths])]).astype(np.int64)
    lines = Lines(np.concatenate(features) if rows else np.zeros((0, width), np.float32), np.concatenate(lengths) if rows else np.zeros(0), first)
    return fit(lines, np.array([r["good"] for r in rows], dtype=np.int64))


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    plain = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(partial(_scored, model=model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _good_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("text")
        for part in slices(batch, "text"):
            good = model.scores(lines_of(part.column(at).cast(pa.large_string()))) >= THRESHOLD
            yield part.filter(pa.array(good))


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model accepts, columns as they are."""
    return small_batches(docs).mapInArrow(partial(_good_rows, model=model), docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
