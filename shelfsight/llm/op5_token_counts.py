"""Token counts of whole texts by count-only Viterbi over a unigram vocabulary.

Method. Aho-Corasick enumerates all pieces of the vocabulary that end at each character;
dynamic programming keeps, for each end, the best score, the number of tokens on its path
and whether the path ends in an unknown character. No path is stored.

Tie rules are the tokenizer library's own: of paths with one score to one end, the one
whose last piece starts first (the longest) stays; an unknown character, which is a
candidate only where no piece of one character starts, comes last, at UNKNOWN below the
least score of the vocabulary. Unknown characters that follow each other are one piece;
with byte fallback that piece counts a token for each of its bytes, otherwise one.

A text is counted whole, as the model's normaliser leaves it: a mark before it, each space
a mark, other white space as it is (a line feed is an unknown character, so a byte piece).
Control, unknown and byte pieces match no text. A task keeps the counts of chunks that it
has met. A chunk is a run of spaces with the word after it, or a run of STRANGE characters
that no piece holds: every path passes through its ends, as no piece holds a mark after
another character and the mark is a piece. Where a vocabulary doesn't say so, a text is one chunk.

Rows: null and empty texts have no tokens, blank ones those of their white space. Each row
counts for itself, so repeated rows and null ids return as they come. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Sequence
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches

MARK = "▁"
UNKNOWN = 10.0
#: White space that ends a chunk where no piece of the vocabulary holds it.
STRANGE = "\n\t\r\x0b\x0c"
#: Chunks whose counts a task keeps.
CACHE = 500_000


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def silent(path: str) -> frozenset[str]:
    """Pieces of a model file that match no text: control, unknown and byte ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(model.id_to_piece(i) for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i))


class TokenCounter:
    def __init__(self, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True, hidden: Collection[str] = ()) -> None:
        self.matcher = ahocorasick.Automaton()
        held = dict(reversed([p for p in pieces if p[0]]))
        heard = [p for p in held if p not in hidden]
        for piece in heard:
            self.matcher.add_word(piece, (len(piece), held[piece]))
        self.matcher.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.known_bytes = byte_fallback and all(f"<0x{b:02X}>" in held for b in range(256))
        # unknown characters side by side are one token without byte fallback, so they end no chunk then
        odd = "".join(c for c in STRANGE if not any(c in p for p in heard)) if self.known_bytes else ""
        parted = MARK in heard and not any(MARK in p.lstrip(MARK) for p in heard)
        self.chunks = re.compile((rf" *[^ {odd}]+| +|[{odd}]+" if odd else " *[^ ]+| +").encode() if parted else b"(?s).+").findall
        self.known: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        """Tokens of one text, its spaces being marks."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.matcher.iter(text):
            ends[end + 1].append(found)
        score, tokens, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, of, single = None, 0, False
            for length, worth in sorted(ends[end], reverse=True):
                at = score[end - length] + worth
                if best is None or at > best:
                    best, of = at, length
                single |= length == 1
            if not single:
                at = score[end - 1] + self.unknown
                if best is None or at > best:
                    best, of = at, 0
            score[end] = best
            if of:
                tokens[end] = tokens[end - of] + 1
            else:
                odd[end] = True
                more = len(text[end - 1].encode()) if self.known_bytes else not odd[end - 1]
                tokens[end] = tokens[end - 1] + more
        return tokens[n]

    def total(self, text: bytes) -> tuple[int, int]:
        """Words of a text and its tokens."""
        if not text:
            return 0, 0
        chunks, known = self.chunks(b" " + text.replace(MARK.encode(), b" ")), self.known
        if len(known) > CACHE:
            known.clear()
        for c in set(chunks):
            if c not in known:
                known[c] = self.count(c.decode().replace(" ", MARK))
        return len(text.split()), sum(map(known.__getitem__, chunks))


def _counted(batches: Iterator[pa.RecordBatch], path: str, byte_fallback: bool) -> Iterator[pa.RecordBatch]:
    counter = TokenCounter(vocabulary(path), byte_fallback, silent(path))
    for batch in batches:
        found = [counter.total(x.as_py()) if x.is_valid else (0, 0) for x in batch.column("text").cast(pa.large_binary())]
        words, tokens = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, path: str, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens of each row of docs (doc_id, text)."""
    plain = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(partial(_counted, path=path, byte_fallback=byte_fallback), "doc_id long, n_words long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
