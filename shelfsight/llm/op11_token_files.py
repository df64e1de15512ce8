"""Token ids as Arrow files of equal-length sequences, and reading them back by place.

Format. A shard is two Arrow IPC files (the stream format with a footer, so that each batch is
found without reading those before it). `<name>.ids.arrow` holds `ids`, fixed-size lists of
`size` unsigned integers (16 bits where the vocabulary fits in them), and `mask`, lists of as
many bits, true for ids and false for padding; all batches but the last have ROWS sequences,
so sequence i is row i % ROWS of batch i // ROWS, a view of the mapped file with nothing
copied. `<name>.docs.arrow` holds doc_id, start and n_tokens of each document, start
being its place among the shard's ids. Documents run on across sequences; a shard's last one is padded.

Writing. Documents are dealt to shards by ranges of doc_id, and those of one id (or of none) by
their text's hash and their place in the input, so one id with very many rows fills several
shards. A task streams its shard in order, holding one batch, and its files have a name of
their own; a manifest row (shard, name, n_tokens, n_docs) is written only for the attempt that
succeeded, so files of lost or repeated attempts are never read. Files go to a folder of
`spark.checkpoint.dir` by pyarrow's file systems (local or mounted, hdfs, s3, gs). Only the
number of shards reaches the driver.

A text's ids are those of its chunks: a space with the characters up to the next white space, or
the white space between, which the vocabulary's splitter never takes together with what stands
on the other side. Ids of chunks are kept in a task. Texts with other white space than space,
tab and line ends, or with `<|`, are encoded whole; an added token counts as that token, which
is the library's default.

Rows: a null or empty text has the end id only. Repeated rows and rows of one doc_id are
documents of their own, in the order said above. A null doc_id stays null and comes first. An
empty table gives no rows. Other columns are ignored. Results don't depend on the number of shards.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.saved import shared_dir
from .shared import running, saved, small_batches
from .words import slices

SIZE, END = 2048, 0
#: Sequences of a batch: 256 KB of 16-bit ids.
ROWS = 64
#: Chunks (and their parts) whose ids a task keeps at most, those that stay when there are more (the first met, so the common ones), and their bytes (a chunk may be as long as a text).
CACHE, COMMON, CACHE_BYTES = 500_000, 250_000, 64_000_000
#: Bytes of text whose chunks are looked up together.
GROUP_BYTES = 900_000
#: Documents of a batch of the index.
INDEX = 4096

_chunks = re.compile(rb" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]").findall
#: White space of Unicode and controls on which libraries differ, and what may begin an added token; told by the first byte, then by what follows it.
_odd = re.compile(
    rb"[\x0b\x0c\x1c-\x1f<\xc2\xe1-\xe3\xef](?:(?<=[\x0b\x0c\x1c-\x1f])|(?<=<)\||(?<=\xc2)[\x85\xa0]|(?<=\xe1)(?:\x9a\x80|\xa0\x8e)|(?<=\xe2)(?:\x80[\x80-\x8f\xa8-\xaf]|\x81\x9f)|(?<=\xe3)\x80\x80|(?<=\xef)\xbb\xbf)"
).search


#: Characters on whose kind all versions of Unicode agree; the vocabulary's own splitter over them, a line end standing after each chunk.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u048a-\u04ff\u4e00-\u9fa5"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_settled = re.compile(f"[{_LETTER}{_NUMBER}\x20-\x7e\n\xa1-\xbf\xd7\xf7\u2010-\u2027\u2030-\u205e\u20ac]*").fullmatch
_parts = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+|\n| ?[^ \n{_LETTER}{_NUMBER}]+").findall


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokens:
    """Ids of whole texts as bytes of little-endian integers of `kind`."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        words = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(words.values()) + 1, np.int64)  # bytes of each piece: a character of a byte-level vocabulary is a byte
        self.lengths[list(words.values())] = list(map(len, words))
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> None:
        """Ids of chunks, from those of their parts where the splitter's parts are sure; others are encoded one by one."""
        sure = [c for c in chunks if c[-1] not in b" \t\n\r"]
        text = b"\n".join([*sure, b""]).decode("utf-8", "replace")
        if not _settled(text):
            sure = [c for c in sure if _settled(c.decode("utf-8", "replace"))]
            text = b"\n".join([*sure, b""]).decode()
        cut = _parts(text)
        parts = self.parts
        parts["\n"] = b""
        self.learn_parts([p for p in dict.fromkeys(cut) if p not in parts])
        got = [parts[p] for p in cut]
        last = np.fromiter(map("\n".__eq__, cut), bool, len(cut))
        body, stops = b"".join(got), np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))[last].tolist()
        self.known.update(zip(sure, [body[a:b] for a, b in zip([0, *stops], stops)]))
        if len(sure) < len(chunks):
            rest = list(set(chunks).difference(sure))
            self.known.update(zip(rest, self.encoded(rest)))
        self.held += sum(map(len, chunks))

    def learn_parts(self, new: list[str]) -> None:
        """Parts are encoded in one text and told apart by the bytes of its pieces; a line end keeps one without a space from the one before."""
        if not new:
            return
        joined = [p.encode() if p[0] == " " else b"\n" + p.encode() for p in new]
        ids = np.frombuffer(self.encoded([b"".join(joined)])[0], self.kind)
        ends = np.cumsum(self.lengths[ids])
        bounds = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        stops = np.searchsorted(ends, bounds) + 1
        if stops[-1] == len(ids) and (ends[stops - 1] == bounds).all():
            starts = np.concatenate([[0], stops[:-1]]) + np.fromiter((p[0] != " " for p in new), np.int64, len(new))
            body, n = ids.tobytes(), self.kind.itemsize
            self.parts.update(zip(new, [body[a:b] for a, b in zip((starts * n).tolist(), (stops * n).tolist())]))
        else:  # another kind of vocabulary
            self.parts.update(zip(new, self.encoded([p.encode() for p in new])))
        self.held += sum(map(len, new))

    def forget(self) -> None:
        """Back to the common ones where there are too many, and to none where too long ones were met."""
        keep = COMMON if self.held <= CACHE_BYTES else 0
        self.known, self.parts = (dict(islice(x.items(), keep)) if len(x) > CACHE or not keep else x for x in (self.known, self.parts))
        self.held = sum(map(len, self.known)) + sum(map(len, self.parts))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [self.encoded([t])[0] if _odd(t) else None for t in texts]
        plain = [i for i, x in enumerate(out) if x is None]
        if self.held > CACHE_BYTES or max(len(self.known), len(self.parts)) > CACHE:
            self.forget()
        chunks = [_chunks(texts[i]) for i in plain]
        found = [list(map(self.known.get, some)) for some in chunks]
        short = [i for i, got in enumerate(found) if None in got]
        if short:
            self.learn(list({c for i in short for c, x in zip(chunks[i], found[i]) if x is None}))
            known = self.known
            for i in short:
                found[i] = [known[c] if x is None else x for c, x in zip(chunks[i], found[i])]
        for i, got in zip(plain, found):
            out[i] = b"".join(got)
        return out


@lru_cache(maxsize=1)
def _tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def schema_of(kind: np.dtype, size: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), False), size)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), size))])


class SequenceWriter:
    """Ids one after the other, as batches of sequences."""

    def __init__(self, sink, kind: np.dtype, size: int, rows: int) -> None:
        self.kind, self.size, self.block = kind, size, rows * size * kind.itemsize
        self.schema = schema_of(kind, size)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held = bytearray()

    def add(self, ids: bytes) -> None:
        self.held += ids
        at = 0
        while len(self.held) - at >= self.block:
            self.write(np.frombuffer(self.held[at : at + self.block], self.kind))
            at += self.block
        if at:
            del self.held[:at]

    def write(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.size)
        whole = np.zeros(n * self.size, self.kind)
        whole[: len(ids)] = ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((whole, np.arange(len(whole)) < len(ids)), self.schema)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self.write(np.frombuffer(self.held, self.kind))
        self.file.close()


class TokenFile:
    """Sequences of a file by place: `len(f)`, `f[i]` gives ids and mask of sequence i as views, `f.pieces(a, b)` the ids from a to b."""

    def __init__(self, system: fs.FileSystem, at: str) -> None:
        local = isinstance(system, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(at) if local else system.open_input_file(at))
        self.size = self.reader.schema.field("ids").type.list_size
        n = self.reader.num_record_batches
        self.rows = self.batch(0).num_rows if n else 1
        self.sequences = (n - 1) * self.rows + self.batch(n - 1).num_rows if n else 0

    @lru_cache(maxsize=2)  # noqa: B019  two batches, gone with the file
    def batch(self, i: int) -> pa.RecordBatch:
        return self.reader.get_batch(i)

    @lru_cache(maxsize=2)  # noqa: B019
    def flat(self, i: int) -> np.ndarray:
        return self.batch(i).column("ids").flatten().to_numpy(zero_copy_only=True)

    def __len__(self) -> int:
        return self.sequences

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < self.sequences:
            raise IndexError(i)
        batch, row = divmod(i, self.rows)
        return self.flat(batch)[row * self.size : (row + 1) * self.size], self.batch(batch).column("mask").slice(row, 1).flatten()

    def pieces(self, a: int, b: int) -> Iterator[np.ndarray]:
        """Views of the ids from a to b, a batch each."""
        block = self.rows * self.size
        while a < b:
            i, at = divmod(a, block)
            part = self.flat(i)[at : at + b - a]
            yield part
            a += len(part)

    def tokens(self) -> int:
        """How many ids the masks count."""
        return sum(self.reader.get_batch(i).column("mask").flatten().true_count for i in range(self.reader.num_record_batches))


def _encoded(tokens: ByteTokens, batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and ids of the batch's texts, GROUP_BYTES of text at once."""
    for part in slices(batch, "text", GROUP_BYTES):
        texts = [t or b"" for t in part.column("text").cast(pa.large_binary()).to_pylist()]
        yield from zip(part.column("doc_id").to_pylist(), tokens.ids(texts))


def _write(batches: Iterator[pa.RecordBatch], path: str, to: str, size: int, rows: int, end: int) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(path)
    last = np.array([end], tokens.kind).tobytes()
    system, folder = fs.FileSystem.from_uri(to)
    index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    shard, files, docs, total, count = TaskContext.get().partitionId(), None, [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if files is None:
            name = f"{shard:08d}-{uuid.uuid4().hex}"
            system.create_dir(folder, recursive=True)
            sinks = [system.open_output_stream(f"{folder}/{name}.{x}.arrow") for x in ("ids", "docs")]
            files = SequenceWriter(sinks[0], tokens.kind, size, rows), pa.ipc.new_file(sinks[1], index)
        for doc, ids in _encoded(tokens, batch):
            ids += last
            files[0].add(ids)
            n = len(ids) // tokens.kind.itemsize
            docs.append((doc, total, n))
            total, count = total + n, count + 1
            if len(docs) == INDEX:
                files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*docs)], schema=index))
                docs = []
    if files is not None:
        if docs:
            files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*docs)], schema=index))
        for file in (*files, *sinks):
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name]), pa.array([total], pa.int64()), pa.array([count], pa.int64())], ["shard", "name", "n_tokens", "n_docs"])


def _read(batches: Iterator[pa.RecordBatch], to: str) -> Iterator[pa.RecordBatch]:
    system, folder = fs.FileSystem.from_uri(to)
    for batch in batches:
        for name, before, total in zip(*(batch.column(c).to_pylist() for c in ("name", "before", "n_tokens"))):
            file = TokenFile(system, f"{folder}/{name}.ids.arrow")
            if (n := file.tokens()) != total:
                raise OSError(f"{name}: its masks count {n} ids, the manifest {total}")
            with system.open_input_file(f"{folder}/{name}.docs.arrow") as source:
                index = pa.ipc.open_file(source)
                for docs in map(index.get_batch, range(index.num_record_batches)):
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                        crc = 0
                        for part in file.pieces(start, start + n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        sums.append(crc)
                    start = pa.array(docs.column("start").to_numpy() + before)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, path: str, to: str, size: int = SIZE, rows: int = ROWS, end: int = END) -> DataFrame:
    """Files in the folder `to` and their manifest: shard, name, n_tokens, n_docs, before (ids of all shards before it)."""
    plain = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "_row"]
    dealt = plain.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = "shard long, name string, n_tokens long, n_docs long"
    manifest = saved(dealt.mapInArrow(partial(_write, path=path, to=to, size=size, rows=rows, end=end), kind))
    return running(manifest, ["shard"], {"n_tokens": "before"})


def read_token_files(manifest: DataFrame, to: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of all documents of the manifest's files; a shard is read by one task."""
    shards = manifest.select("shard", "name", "before", "n_tokens")
    return shards.repartition(max(1, shards.count()), "shard").mapInArrow(partial(_read, to=to), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read_token_files(saved(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), to)), to)
