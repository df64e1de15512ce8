"""Token files, clusters and spelling variants against brute force, on small tables with odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfsight.llm import op11_token_files as tf
from shelfsight.llm import op12_clusters as cl
from shelfsight.llm import op13_spelling as sp
from shelfsight.llm.shared import saved

rng = np.random.default_rng(3)
DOCS = "doc_id long, text string, shard long, name string, n int, key string"
X = (1, "x", 1, "k")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *X) for i, t in rows], DOCS).repartition(3)


# token files

TEXTS = [
    "Hello world", None, "", " ", "\n", "a\n\nb", "a \n b\t\tc  d", " lead", "trail ", "x y 　 z", "don't we'll it's", "<|endoftext|> as text", "a<|endoftext|>b", "\x1c\x1d 1 2", "Ünïcödé žluťoučký 漢字 и", "‘q’ — 99%\r\n\r\nnext", "word " * 3000, "z" * 5000,
    "tab\tand\r\nend\n", "\n\n\n", "a\u0085b", " ​ x", "éa", "👍🏽 ok",
]


def wanted(rows, path):
    """start is that of each row in ascending doc_id order; rows of one id in any order."""
    t = Tokenizer.from_file(path)
    out = defaultdict(list)
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out[i].append((len(ids), zlib.crc32(ids.tobytes())))
    return out


def held(got, want):
    at = 0
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.start, r.n_tokens, r.ids_crc32))
    assert set(by) == set(want)
    for i in sorted(want, key=lambda x: (x is not None, x)):
        assert sorted(x[1:] for x in by[i]) == sorted(want[i])
        for start, n, _ in sorted(by[i]):
            assert start == at
            at += n


@pytest.mark.parametrize("size, rows", [(8, 2), (2048, 64)])
def test_token_files(spark, tmp_path, size, rows):
    path = tf.vocabulary_path()
    table = [(i * 3 % 50, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, "no id"), (None, None), (3, "again"), (3, "again"), (-7, "first")]
    table += [(9, "same row")] * 40
    to = f"{tmp_path}/files"
    manifest = saved(tf.write_token_files(docs_of(spark, table), path, to, size, rows))
    held(tf.read_token_files(manifest, to).collect(), wanted(table, path))
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(table)
    for r in manifest.collect():  # any sequence by its place, as views, with the padding said by the mask
        file = tf.TokenFile(fs.LocalFileSystem(), f"{to}/{r.name}.ids.arrow")
        ids, masks = zip(*[file[i] for i in range(len(file))])
        assert {len(x) for x in ids} == {size} == {len(m) for m in masks} and len(file) == -(-r.n_tokens // size)
        assert not any(x.flags.owndata for x in ids)
        flags = np.concatenate([np.asarray(m.to_pylist()) for m in masks])
        assert flags.sum() == r.n_tokens and flags[: r.n_tokens].all() and not np.concatenate(ids)[r.n_tokens :].any()
        with pytest.raises(IndexError):
            file[len(file)]


def test_token_files_of_nothing(spark, tmp_path):
    manifest = saved(tf.write_token_files(docs_of(spark, []), tf.vocabulary_path(), str(tmp_path)))
    assert tf.read_token_files(manifest, str(tmp_path)).collect() == []


def test_a_lost_attempt_leaves_files_that_nobody_reads(spark, tmp_path):
    to = f"{tmp_path}/files"
    manifest = saved(tf.write_token_files(docs_of(spark, [(1, "one"), (2, "two")]), tf.vocabulary_path(), to))
    fs.LocalFileSystem().create_dir(to, recursive=True)
    (tmp_path / "files" / "00000000-dead.ids.arrow").write_bytes(b"half")
    assert {r.doc_id for r in tf.read_token_files(manifest, to).collect()} == {1, 2}


def test_files_are_held_against_the_manifest(spark, tmp_path):
    to = f"{tmp_path}/files"
    manifest = saved(tf.write_token_files(docs_of(spark, [(1, "one two three")]), tf.vocabulary_path(), to))
    with pytest.raises(Exception, match="masks count"):
        tf.read_token_files(manifest.withColumn("n_tokens", F.lit(99).cast("long")), to).collect()


def test_chunks_give_the_ids_of_whole_texts():
    tokens, whole = tf.ByteTokens(tf.vocabulary_path()), Tokenizer.from_file(tf.vocabulary_path())
    alphabet = ["a", "B", "é", "漢", "1", " ", " ", "\n", "\t", "\r", "'", "s", ".", " ", "　", "<|", "\x0b", "\x1f", "́", "ж"]
    texts = ["".join(rng.choice(alphabet, size=rng.integers(0, 14))) for _ in range(4000)]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        assert [np.frombuffer(x, tokens.kind).tolist() for x in tokens.ids([t.encode() for t in some])] == [whole.encode(t, add_special_tokens=False).ids for t in some]


# clusters


def brute_clusters(rows, k, rounds, dim, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, p), c) for c, p in enumerate(points)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for c in range(len(points)):
            mine = [v for (_, v), (_, of) in zip(kept, found) if of == c]
            if mine:
                points[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return Counter((i, c, min(d, cl.MOST)) for (i, _), (d, c) in zip(kept, assign())), points


def vectors(n, dim):
    return [(i, [float(x) for x in rng.normal(size=dim) + (i % 3) * 2]) for i in range(n)]


@pytest.mark.parametrize("k, dim, n_pivots", [(4, 6, 3), (16, 64, 8), (5, 1, 1)])
def test_clusters(spark, k, dim, n_pivots):
    rows = vectors(150, dim)
    rows += [rows[0], rows[0], (7, [0.5] * dim), (None, [0.25] * dim), (900, None), (901, []), (902, [1.0] * (dim + 1)), (903, [None] * dim), (904, [float("nan")] * dim), (905, [float("inf")] * dim), (906, [-0.0] * dim), (907, [0.0] * dim)]
    rows += [(1000 + i, [1.0] * dim) for i in range(80)]  # one vector very often, and ties
    table = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string").repartition(4)
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, points = brute_clusters(rounded, k, 3, dim, 64)
    found, last, shares = cl.clusters(table, k, 3, dim, 64, 1, n_pivots)
    assert Counter(map(tuple, found.collect())) == want
    assert last.tolist() == points and all(0 < s <= 1 for s in shares)


def test_clusters_of_huge_numbers(spark):
    rows = vectors(30, 4) + [(100, [3e38, -3e38, 0.0, 1.0]), (101, [1e7, 1.0, 2.0, 3.0]), (102, [-1e7, 1.0, 2.0, 3.0]), (103, [1.7e308, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found, last, _ = cl.clusters(table, 4, 3, 4)
    want, points = brute_clusters([r for r in rows if r[0] != 103], 4, 3, 4, 64)  # 103 isn't finite once it is scaled
    assert Counter(map(tuple, found.collect())) == want and last.tolist() == points


def test_clusters_of_few_or_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cl.clusters(none)[0].collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 5.0]), (None, [5.0, 4.5])], "vec_id long, embedding array<double>")
    assert Counter(map(tuple, cl.clusters(two, 16, 3, 2)[0].collect())) == brute_clusters([(1, [1.0, 2.0]), (2, [5.0, 5.0]), (None, [5.0, 4.5])], 16, 3, 2, 64)[0]


def test_bounds_save_distances_where_vectors_have_structure():
    points = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]], np.int64)
    rows = np.concatenate([points + i for i in range(20)])
    table = np.sqrt(np.stack([cl.squared(rows, p) for p in points], axis=1).astype(float))
    best, apart, measured = cl.nearest(rows, table, points, points)
    every = np.stack([cl.squared(rows, p) for p in points], axis=1)
    assert (best == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all() and measured < 1.2 * len(rows)


# spelling


def brute_words(rows):
    total = Counter()
    for i, text in rows:
        run = ""
        for c in [*(text or ""), "\n"]:
            if "a" <= c.lower() <= "z" and c.isascii() or "\xc0" <= c <= "\xff":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
            run = ""
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words):
    out, form = {}, {}
    for w, n in words.items():
        of = [v for v in words if near(w, v)]
        best = min(of, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(of), form[w], words[form[w]] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def spelled():
    base = ["Lingua", "straße", "Überall", "colour", "motor", "aaaaa", "abcabc", "ÀÖ×÷ÿàb", "parallel", "x" * 300]
    rows = []
    for i in range(60):
        some = []
        for w in base:
            w = list(w)
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(0, len(w))
                w[at : at + rng.integers(0, 2)] = rng.choice(list("aeiouÀé"), size=rng.integers(0, 2)).tolist()
            some += ["".join(w)] * int(rng.integers(1, 5))
        rows.append((i, " ".join(some) + "; it's re-done"))
    rows += [(None, "motor motors motor's"), (None, None), (70, ""), (71, "abcdeŁabcde ŁŁŁŁŁŁ"), (72, "motor " * 2000), rows[0], rows[0]]
    return rows + [(200 + i, " ".join(f"lat{''.join(rng.choice(list('abc'), 3))}en" for _ in range(40))) for i in range(20)]


@pytest.mark.parametrize("tile", [4096, 5])
def test_spelling(spark, tile):
    rows = spelled()
    words = saved(sp.word_counts(docs_of(spark, rows)))
    want = brute_words(rows)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 60
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in sp.forms(words, tile).collect()}
    assert got == brute_forms(want)
    assert any(v[4] not in (k, v[2]) for k, v in got.items())  # a chain of two forms


def test_spelling_blocks_stay_small(spark):
    words = spark.createDataFrame([("".join(rng.choice(list("ab"), 12)), 3) for _ in range(1500)], "word string, n long").distinct()
    dealt = sp.blocks(words, 32)
    sizes = dealt.groupBy("length", "head", "tail", "key").count().where(F.col("length") - F.col("head") - F.col("tail") > 1)
    assert sizes.agg(F.max("count")).first()[0] <= 32
    every = [r.word for r in words.collect()]
    want = {(a, b) for a in every for b in every if near(a, b)}
    assert {(r.word, r.near) for r in sp.links(words, 32).collect()} == want


def test_spelling_of_nothing(spark):
    words = sp.word_counts(docs_of(spark, [(1, None), (2, "a b c")]))
    assert sp.forms(words).collect() == []


# SQL of the same results


def as_sql(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, pa.Table.from_pylist(table) if isinstance(table, list) else table)
    return con.execute(sql).fetchall()


def test_clusters_in_sql(spark, tmp_path):
    rows = [{"vec_id": i, "embedding": [float(x) for x in rng.normal(size=64)]} for i in range(60)] + [{"vec_id": 99, "embedding": None}, {"vec_id": 98, "embedding": [1.0]}]
    table = pa.table({"vec_id": [r["vec_id"] for r in rows], "embedding": pa.array([r["embedding"] for r in rows], pa.list_(pa.float32()))})
    import pyarrow.parquet as pq

    pq.write_table(table, tmp_path / "embeddings.parquet")
    assert sorted(map(tuple, cl.op12_clusters(spark, str(tmp_path)).collect())) == sorted(as_sql(cl.OP12_SQL, embeddings=table))


def test_spelling_in_sql(spark, tmp_path):
    rows = spelled()
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    import pyarrow.parquet as pq

    pq.write_table(table, tmp_path / "documents.parquet")
    assert set(map(tuple, sp.op13_spelling(spark, str(tmp_path)).collect())) == set(as_sql(sp.OP13_SQL, documents=table))
