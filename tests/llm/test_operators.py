"""Each operator against brute force on small tables with odd rows."""

import re
import zlib
from collections import Counter, defaultdict
from functools import reduce
from operator import add

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfsight.llm import op1_topk, op2_html, op3_substring_dedup, op4_near_dedup, op5_token_counts, op6_mixing, op7_packing, op8_quality, op9_neighbours, op10_pii
from shelfsight.llm.shared import components
from shelfsight.llm.words import ngram_hashes, words_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, id string, rank int, band string, key string"
rng = np.random.default_rng(5)


def prose(n, of=40):
    return " ".join(f"w{i}" for i in rng.integers(0, of, size=n))


PASSAGE = " ".join(f"p{i}" for i in range(60))
LONG = prose(9000, 4000)


def table():
    base = prose(120, 400)
    texts = [base, base, base.replace("w1 ", "w2 ", 1), base.upper(), None, "", " \t\n ", "one", "one two three", "One two\tthree", PASSAGE, f"{prose(50)} {PASSAGE} {prose(20)}", "a " * 300, LONG, LONG + " tail", "Ünïcödé   x", prose(35), prose(34)]
    for i in range(40):
        w = base.split()
        for k in rng.integers(0, len(w), size=i % 9):
            w[k] = f"n{rng.integers(0, 9999)}"
        texts.append(" ".join(w))
    texts += [f"{prose(15, 5000)} {PASSAGE}" for _ in range(80)]
    rows = [(i, t, None if i % 7 == 3 else f"s{i % 5}", "x", 1, "b", "k") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[11], (None, "no id here", "s1", "x", 1, "b", "k")]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORDS.findall(text or "")


def test_words_are_found_in_the_buffer():
    texts = ["a b  c", None, "", "dd", "e\x0bf ", "é x\xa0y", "\n", "z"]
    w = words_of(pa.array(texts))
    found = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert found == [x for t in texts for x in words(t)]
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    sliced = words_of(pa.array(texts).slice(3, 3))
    assert sliced.counts.tolist() == [1, 2, 2]
    h = words_of(pa.array(["q a b c", "a b c"])).hashes()
    assert ngram_hashes(h, 3)[1] == ngram_hashes(h, 3)[4]


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(5, 90), (90, 7), (1, 1), (None, 3)] + [(200, x) for x in range(201, 260)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {5: 5, 7: 5, 90: 5} | {x: 200 for x in range(200, 260)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 and 9


def vectors(spark, extra=()):
    base = rng.normal(size=(230, 8))
    base[40:90] = base[3]
    rows = [(i, [float(x) for x in v], "clash", 1.0) for i, v in enumerate(base)]
    return rows, spark.createDataFrame([*rows, (500, None, "", 0.0), (600, [1.0, None], "", 0.0), (700, [float("nan")] * 8, "", 0.0), (800, [], "", 0.0), (None, [1.0] * 8, "", 0.0), *extra], "vec_id long, vector array<double>, query_id string, score double")


@pytest.mark.parametrize("k", [5, 400])
def test_top_k_is_exact(spark, k):
    rows, table = vectors(spark)
    usable = table.where(F.col("vec_id").isNotNull() & op1_topk.usable(F.col("vector")))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in op1_topk.top_k(usable, usable.where("vec_id % 50 = 0"), k).collect()}
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v, *_ in rows}
    want = {}
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ c), i) for i, c in ints.items() if i != q)[:k]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, vector array<double>")
    assert op1_topk.top_k(empty, empty, 5).collect() == []
    assert op9_neighbours.nearest(empty, empty, 5).collect() == []


def test_large_products_stay_exact():
    q = np.array([[2.0**40, 3.0], [1.0, 1.0]])
    assert op1_topk.scores(q, q).tolist() == [[2**80 % 2**64 + 9, 2**40 + 3], [2**40 + 3, 2]]


@pytest.mark.parametrize("fine, shard_bytes, most_queries", [(op9_neighbours.FINE, op9_neighbours.SHARD_BYTES, op9_neighbours.QUERIES), (2, 2048, 4), (op9_neighbours.FINE, 640, 7)])
def test_neighbours(spark, fine, shard_bytes, most_queries):
    rows, table = vectors(spark, [(900, [0.0] * 8, "", 0.0)])
    usable = table.where(F.col("vec_id").isNotNull() & op9_neighbours.usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    got = defaultdict(list)
    for r in sorted(op9_neighbours.nearest(usable, usable.where("vec_id % 20 = 0"), 20, fine=fine, shard_bytes=shard_bytes, most_queries=most_queries).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    v = {i: np.array(x) for i, x, *_ in rows}
    hits = 0
    for q in (i for i in v if i % 20 == 0):
        best = [i for _, i in sorted((-float((v[q] * c).sum()), i) for i, c in v.items() if i != q)[:20]]
        assert len(got[q]) == 20 and all(s == reduce(add, (v[q] * v[i]).tolist()) for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits += len(set(best) & {i for i, _ in got[q]})
    assert hits >= 0.9 * 20 * 12
    assert sorted({i for q in got for i, _ in got[q]} - set(v)) == []
    few = usable.where("vec_id < 9")
    assert op9_neighbours.nearest(few, few.where("vec_id = 0"), 20).count() == 8


@pytest.mark.parametrize("n", [300, 6000])
def test_recall_of_neighbours(spark, n):
    """Against brute force, on vectors without much structure, with a third of all rows being one vector."""
    v = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    v[n // 3 : 2 * n // 3] = v[0]
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vector array<double>").repartition(4)
    found = defaultdict(dict)
    for r in op9_neighbours.nearest(table, table.where("vec_id % 100 = 0"), 20).collect():
        found[r.query_id][r.vec_id] = r.score
    hits = 0
    for q in range(0, n, 100):
        s = v.astype(float) @ v[q].astype(float)
        s[q] = -9
        kth = np.sort(s)[-20]
        assert len(found[q]) == 20
        hits += sum(x >= kth - 1e-12 for x in found[q].values())
    assert hits >= 0.9 * 20 * len(range(0, n, 100))


# 2


def page(body, main="article"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_html(spark):
    rows, want = [], {}
    for i in range(30):
        paragraphs = "".join(f"<p>Text {i} of&nbsp;{k} &amp; more<br>here" for k in range(3))
        body = f'<nav><ul><li><a href="/a{i}">menu {i}</a></li></ul></nav><div class="ad-box">buy {i}</div><article><h1>Title {i}</h1>{paragraphs}<p>Read our rules.</p><div class="comments"><p>reader {i}</p></div></article><aside>side {i}</aside><footer>foot {i}</footer>'
        rows.append((i, f"https://h.example/{i}", page(body), "x", 1))
        want[i] = "\n\n".join([f"Title {i}", *[f"Text {i} of {k} & more here" for k in range(3)]])
    for i in range(30, 50):
        body = f'<div id="top"><a href="/">home</a></div><div class="post"><h2>Head {i}</h2><p>Body {i} <b>bold</b> x</p></div><form><p>sign {i}</p></form><div class="cookie-notice">ok {i}</div>'
        rows.append((i, f"http://other.example/{i}?q=1", page(body), "x", 1))
        want[i] = f"Head {i}\n\nBody {i} bold x"
    rows += [(100, "http://h.example", None, "x", 1), (101, None, "", "x", 1), (102, None, "<p>only <i>this</i> &lt;b&gt;<p", "x", 1), (103, "z", "<div>" * 3000 + "deep", "x", 1), (0, *rows[0][1:])]
    want |= {100: "", 101: "", 102: "only this <b>", 103: "deep"}
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, slot int").repartition(3)
    got = op2_html.extract(table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.page_id, r.text, r.n_chars) == (r.page_id, want[r.page_id], len(want[r.page_id]))
    assert op2_html.extract(table.limit(0)).collect() == []


def neutral_pages():
    """Pages without article elements and with names that say nothing; want by page."""
    rows, want = [], {}

    def add(i, host, body, parts):
        rows.append((i, f"https://{host}/{i}", page(body)))
        want[i] = "\n\n".join(parts)

    for i in range(12):  # content beside a menu, a varying box and a constant box
        parts = [f"Head {i}", *[f"{prose(30, 900)} {i}." for _ in range(1 + i % 4)]]
        menu = "".join(f'<li><a href="/{k}">{prose(2, 900)}</a></li>' for k in range(6))
        add(i, "a.example", f'<div class="xa"><ul>{menu}</ul></div><div class="xb"><p>{prose(4, 900)}</p></div><div class="xc"><h2>{parts[0]}</h2>{"".join(f"<p>{x}</p>" for x in parts[1:])}<p>Always said here.</p></div><div class="xd">constant {"word " * 30}</div>', parts)
    for i in range(20, 23):  # a host of three pages: what all of them say goes
        parts = [f"{prose(25, 900)} {i}.", f"{prose(25, 900)}!"]
        add(i, "b.example", f'<div id="qa">{prose(3, 900)}</div><div id="qb"><p>{parts[0]}</p><p>We say this on every page.</p><p>{parts[1]}</p></div>', parts)
    for i in range(30, 42):  # two layouts of one host, each with a template of its own
        parts = [f"{prose(25, 900)} {i}.", f"{prose(25, 900)}?"]
        inner = f"<p>{parts[0]}</p><p>{parts[1]}</p>"
        body = f'<div class="ka"><div class="kb">{inner}<p>Left layout.</p></div></div><div class="kc">{prose(3, 900)}</div>' if i % 2 else f'<section class="ma"><div class="mb">{inner}<p>Right layout.</p></div></section><div class="mc">{prose(3, 900)}</div>'
        add(i, "c.example", body, parts)
    parts = [f"{prose(40, 900)}.", f'{prose(30, 900)} "quoted".']
    add(50, "d.example", f'<div class="za"><a href="/">{prose(3, 900)}</a></div><div class="zb"><p>{parts[0]}</p><p>{parts[1]}</p></div><div class="zc">{prose(4, 900)}</div>', parts)
    return rows, want


def test_html_by_structure_alone(spark):
    rows, want = neutral_pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for names in (True, False):
        assert {r.page_id: r.text for r in op2_html.extract(table, names=names).collect()} == want
    alone = {r.page_id: r.text for r in op2_html.extract(table, wrapper=False).collect()}
    changed = {i for i in want if alone[i] != want[i]}
    assert changed == set(want) - {50}  # what stands constant is only seen over the pages of a host


def test_region():
    tree = "(html(body(div.a;div.b(h1;p;div.c(p;))div.d;)))"
    place = {label: i for i, (label, _) in enumerate(op2_html._read_tree(tree))}
    weigh = lambda **n: {place[k.replace("_", ".")]: v for k, v in n.items()}
    region = lambda good, every=None: op2_html._read_tree(tree)[op2_html.find_region(tree, good, every or good)][0]
    assert region(weigh(div_a=5, h1=2, div_b=0) | {6: 90}) == "div.b"
    assert region(weigh(div_a=50, h1=2) | {6: 40}) == "body"
    assert region({}, weigh(div_a=5) | {8: 90}) == "div.c"
    assert op2_html.find_region("", {}, {}) == 0


def test_tree_matching_keeps_order():
    assert op2_html.match_trees("body(div;p;)", "body(nav;div;p;)") == (0, 2, 3)
    assert op2_html.match_trees("a;", "b;") == (-1,)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(200)], "a long, b long")
    nodes = {i * 7919 % 1009 for i in range(201)}
    assert {(r.node, r.root) for r in components(edges).collect()} == {(n, min(nodes)) for n in nodes}


# 3


def brute_repeats(rows, size):
    count = Counter(tuple(w[k : k + size]) for w in map(words, (r[1] for r in rows)) for k in range(len(w) - size + 1))
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2, op3_substring_dedup.HOT])
def test_repeats(docs, rows, hot):
    got = op3_substring_dedup.remove_repeats(docs, hot=hot, shard=20)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, 35)


def test_repeats_of_nothing(none):
    assert op3_substring_dedup.remove_repeats(none).collect() == []


def test_repeats_of_many_equal_rows(spark):
    """Copies with one id, or none, ask for each run once and hold each span once."""
    text = prose(400, 5000)
    rows = [(None, text)] * 2000 + [(7, text)] * 2000 + [(8, f"{text} tail"), (9, prose(100, 5000))]
    got = op3_substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed").collect())) == {(None, 400, 400): 2000, (7, 400, 400): 2000, (8, 401, 400): 1, (9, 100, 0): 1}


def test_suffix_automaton_counts_places():
    text = list("abcabcabx")
    automaton = op3_substring_dedup.SuffixAutomaton()
    automaton.add_text(text, 1, -1)
    automaton.count()
    for size in (1, 2, 3, 5):
        grams = Counter(tuple(text[i : i + size]) for i in range(len(text) - size + 1))
        assert automaton.repeated(text, size) == [i for i in range(len(text) - size + 1) if grams[tuple(text[i : i + size])] > 1]


# 4


def brute_near(rows, n, percent=80):
    sets = defaultdict(list)
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        if r[0] is not None:
            sets[r[0]].append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = [(i, s) for i, v in sets.items() for s in v if s]
    for a, (i, x) in enumerate(every):
        for j, y in every[:a]:
            if 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(v[0]), find(i)) for i, v in sets.items()}


@pytest.mark.parametrize("chunk", [7, 96])
def test_near_duplicates(docs, rows, chunk):
    got = op4_near_dedup.near_duplicates(docs, shingle=4, chunk=chunk).collect()
    assert len(got) == len(rows)
    want = brute_near(rows, 4)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_of_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e"), (1, "p q r s t"), (2, "a b c d e"), (3, "p q r s t"), (4, "")]
    got = {r.doc_id: r.component_id for r in op4_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_near_duplicates_keep_columns(docs, none, rows):
    kept = op4_near_dedup.keep_one_of_each(docs, shingle=4)
    assert kept.columns == docs.columns
    want = brute_near(rows, 4)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and want[r[0]][1] == r[0])
    assert op4_near_dedup.near_duplicates(none).collect() == []


def test_near_duplicates_without_copies(spark):
    text = prose(60, 3000)
    others = [prose(60, 3000) for _ in range(6)]
    rows = [(5, others[0], 1)] * 3 + [(5, others[1], 1), (None, text, 1), (None, text, 2), (None, f"{text} tail", 3), (None, others[0], 1), (None, others[2], 1), (None, None, 1), (None, None, 1), (7, None, 1), (7, None, 2), (1 << 40, others[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    kept = op4_near_dedup.keep_one_of_each(docs, copies=False)
    assert kept.schema == docs.schema
    got = Counter((r.doc_id, r.text and r.text.removesuffix(" tail")) for r in kept.collect())
    assert got == {(5, others[0]): 1, (5, others[1]): 1, (None, text): 1, (None, others[2]): 1, (None, None): 2, (7, None): 1, (1 << 40, others[3]): 1}
    assert op4_near_dedup.keep_one_of_each(docs.limit(0), copies=False).collect() == []
    far = spark.createDataFrame([((1 << 63) - 1, text), (None, text), (None, others[0])], "doc_id long, text string")
    assert sorted(r.text for r in op4_near_dedup.keep_one_of_each(far).collect()) == sorted([text, others[0]])


def test_sketch_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    cells = op4_near_dedup.sketch(np.repeat([0, 1], 1000), np.concatenate([a, b]), 2, 512)
    assert abs((cells[0] == cells[1]).mean() - 800 / 1200) < 0.08
    tiny = op4_near_dedup.sketch(np.array([0]), np.array([9], dtype=np.uint64), 2, 64)
    assert (tiny[0] != op4_near_dedup._EMPTY).all() and (tiny[1] == op4_near_dedup._EMPTY).all()


# 5


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_follow_the_library(docs, none, rows, fallback):
    from tokenizers import Tokenizer, models

    path = op5_token_counts.vocabulary_path()
    library = Tokenizer(models.Unigram(op5_token_counts.vocabulary(path), unk_id=0, byte_fallback=fallback))
    got = sorted(map(tuple, op5_token_counts.token_counts(docs, path, fallback).collect()), key=repr)
    tokens = lambda t: len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
    assert got == sorted(((r[0], len(words(r[1])), tokens(r[1])) for r in rows), key=repr)
    assert op5_token_counts.token_counts(none, path).collect() == []


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_of_whole_texts(spark, fallback):
    from tokenizers import Tokenizer, models

    path = op5_token_counts.vocabulary_path()
    library = Tokenizer(models.Unigram(op5_token_counts.vocabulary(path), unk_id=0, byte_fallback=fallback))
    texts = ["hello\nworld", "a\n\n b", "  two  spaces ", " ", "\n", "\t\tif x:\r\n\t  y\r\n", "a" + " " * 23 + "b" + " " * 5, "mark \u2581 \u2581x\u2581", "\u4e00\U0001f9ff\n\U0001f9ff x", "a\x0bb\x0cc\u00a0d\x85", LONG]
    texts += ["".join(rng.choice(list("ab the.\n\n\t  \r\u2581\u00e9\U0001f9ff"), size=60)) for _ in range(200)]
    got = op5_token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, fallback).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode("\u2581" + t.replace(" ", "\u2581")).ids) for i, t in enumerate(texts)}
    counter = op5_token_counts.TokenCounter(op5_token_counts.vocabulary(path), fallback, op5_token_counts.silent(path))
    assert counter.total(b"<0x0A>")[1] > 2 and counter.total(b"") == (0, 0)  # said in the text, not a byte


def test_ties_go_to_the_longer_last_piece():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -2.0)]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    counter = op5_token_counts.TokenCounter(pieces, False)
    for text in ("ab", "aba", "abab", "bbab", "abcab", "cc", "xaxx", "bababbab"):
        assert counter.count(text) == len(library.encode(text).ids), text


# 6


def test_mixing(docs, none, rows):
    got = op6_mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(taken[s] == round(target[s]) for s in names)
    again = op6_mixing.mixture(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert op6_mixing.mixture(none).collect() == []


def test_mixed_rows_hold_what_is_taken(spark):
    rows = [(i, f"a{i}\n b{i}  c{i} d{i}", f"s{i % 3}", 11) for i in range(60)] + [(99, None, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    want = {r.doc_id: r.taken for r in op6_mixing.mixture(docs).collect()}
    got = defaultdict(int)
    mixed = op6_mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == (11 if len(words(r.text)) == 4 else len(r.text)) and rows[r.doc_id][1].startswith(r.text)
    assert got == {i: n for i, n in want.items() if n}


def test_rows_that_share_an_id_or_have_none_are_mixed_each_for_itself(spark):
    rows = [(None if i % 3 == 0 else i % 4, " ".join(f"{i}w{k}" for k in range(1 + i * 7 % 23)), f"s{i % 3}") for i in range(50)]
    rows += [(8, "same text of one id", "s0")] * 5 + [(None, "same text of none", "s1")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op6_mixing.mixed_documents(docs).collect()
    target = {r.source: int(r.target + 0.5) for r in op6_mixing.mixture(docs).collect()}
    taken = Counter()
    for r in got:
        taken[r.source] += len(words(r.text))
    assert taken == target
    whole = {r[1] for r in rows}
    assert sum(r.text not in whole for r in got) <= len(target)  # the boundary documents
    again = op6_mixing.mixed_documents(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


# 7


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    path = op7_packing.vocabulary_path()
    library = Tokenizer.from_file(path)
    got = op7_packing.pack(docs, path, size=256, bucket=10).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    copies = Counter(r[0] for r in rows)
    for doc, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = sorted(pieces[doc], key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) * copies[doc]
        for r in mine:
            assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    padding = 0
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        padding += 256 - at
    assert padding / (256 * len(sequences)) < 0.06
    assert op7_packing.pack(none, path).collect() == []


def test_patterns_hold_the_demand():
    sizes, demand = np.array([3, 5, 8, 13, 21, 34]), np.array([100, 70, 55, 41, 33, 20])
    found = op7_packing.patterns(sizes, demand, 40)
    assert (sum(c * n for c, n in found) >= demand).all() and all((c @ sizes) <= 40 for c, _ in found)
    assert sum(n for _, n in found) <= np.ceil((sizes @ demand) / 40) * 1.1
    assert op7_packing.patterns(sizes[:0], demand[:0], 40) == []


def test_packing_of_marks_that_compose_with_small_letters_only(spark):
    from tokenizers import Tokenizer

    path = op7_packing.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    tokens = op7_packing.WordTokens(path)
    for word in ("J\u030c", "T\u0308", "H\u0331", "W\u030a", "Y\u030a", "j\u030c", "PLAIN", "Plain", "\u00c9T\u0308a"):
        assert np.frombuffer(tokens.ids([word.encode()])[0], "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids, word


ODD = [
    "plain", "Plain's", "'sfoo", "x'S", "-'s", "a'b'll'd", "don't", "1st2nd", "12.5%", "\u00bd\u00b2x", "\u0130stanbul", "stra\u00dfe\u00aa", "\u041f\u0440\u0438\u0432\u0435\u0442,\u043c\u0438\u0440", "\u0482\u0483", "\u039f\u0394\u039f\u03a3", "\u4e2d\u6587\u3002",
    "e\u0301te\u0301", "J\u030c", "\u00c9T\u0308a", "\u201cquoted\u201d\u2014", "a\u00a0b\u2003c\x85d", "\x1c\x1d", "\x00\x7f", "<|endoftext|>", "a<|startoftext|>b", "<|", "|>endoftext<|", "\U0001f600\U0001f1e9", "\u212b\u2126", "\u0345\u00b4", "\ufb01", "\u01c5\u0149", "_a_b__", "x" * 3000, "'", "''s", "\u00d7\u00f7",
]


@pytest.mark.parametrize("joined", [1, 3, 4096])
def test_packing_gives_the_ids_of_whole_texts(monkeypatch, joined):
    from tokenizers import Tokenizer

    path = op7_packing.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    monkeypatch.setattr(op7_packing, "JOINED", joined)
    tokens = op7_packing.WordTokens(path)
    some = np.random.default_rng(3)
    texts = ["", " ", *ODD, *[" \n".join(some.choice(ODD, 6)) + "\t" for _ in range(30)], *["".join(some.choice(ODD[:29], 3)) for _ in range(200)]]
    for text, ids in zip(texts, tokens.ids([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_kept_words_are_bounded_by_their_bytes(monkeypatch):
    tokens = op7_packing.WordTokens(op7_packing.vocabulary_path())
    monkeypatch.setattr(op7_packing, "CACHE_BYTES", 10_000)
    for i in range(20):
        tokens.ids([f"{'long' * 500}{i}".encode()])
        assert tokens.held <= 20_000 and sum(map(len, tokens.known)) <= 20_000


# 8


def test_marginals_equal_enumeration():
    from itertools import product

    node, edge = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    first = np.array([0, 3, 3, 5])
    p, pairs = op8_quality.marginals(node, edge, first)
    want, joint = np.zeros((5, 2)), np.zeros((2, 2))
    for a, b in ((0, 3), (3, 5)):
        paths = list(product((0, 1), repeat=b - a))
        weight = np.exp([sum(node[a + i, s] for i, s in enumerate(x)) + sum(edge[x[i], x[i + 1]] for i in range(len(x) - 1)) for x in paths])
        for x, w in zip(paths, weight / weight.sum()):
            for i, s in enumerate(x):
                want[a + i, s] += w
            for i in range(len(x) - 1):
                joint[x[i], x[i + 1]] += w
    assert np.allclose(p, want) and np.allclose(pairs, joint)


def test_quality_on_held_out_documents(spark):
    good = ["\n".join(f"{prose(12, 300).capitalize()}." for _ in range(4)) for _ in range(150)]
    bad = ["\n".join(" ".join(f"{w}%%%" for w in prose(12, 300).split()) for _ in range(3)) + "\nA clean line." for _ in range(60)]
    rows = [(i, t, "s", 1) for i, t in enumerate(good + bad)] + [(None, good[0], "s", 1), (998, None, "s", 1), (999, "", "s", 1), (0, good[0], "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, held_out int")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = op8_quality.fitted(docs, labels)
    got = op8_quality.quality(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 210:
            assert r.predicted == int(r.doc_id < 150)
    assert {r.score for r in got if r.doc_id in (998, 999)} == {model.prior}
    assert sorted(r.doc_id for r in op8_quality.good_documents(docs, model).where("doc_id < 210").collect()) == sorted([*range(150), 0])
    for empty in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.score == pytest.approx(1.0, abs=1e-6) for r in op8_quality.quality(docs, op8_quality.fitted(docs, empty)).collect())
    assert op8_quality.quality(docs.limit(0), op8_quality.fitted(docs.limit(0), labels)).collect() == []


def test_lines_that_repeat_are_found_at_every_place():
    plain = [f"{prose(9, 300)}.\n{prose(5, 300)}" for _ in range(40)]
    text = "same line here\nother one\nsame line here\nline same here\nsame line here"
    copies = lambda lines: np.round(lines.features[:, -2] * 5).astype(int) + 1
    assert set(copies(op8_quality.lines_of(pa.array(["one and the same\n" * 50])))) == {6}
    bad = [f"{prose(9, 300)} %%\n" * 3 for _ in range(40)]
    model = op8_quality.fit(op8_quality.lines_of(pa.array(plain + bad)), np.array([1] * 40 + [0] * 40))
    alone = model.scores(op8_quality.lines_of(pa.array([text])))[0]
    for before in range(0, 40, 3):
        column = pa.array([*plain[:before], text, None, *bad[: before // 2], text])
        lines = op8_quality.lines_of(column)
        for at in (before, len(column) - 1):
            assert copies(lines)[lines.first[at] : lines.first[at + 1]].tolist() == [3, 1, 3, 1, 3]
        scores = model.scores(lines)
        assert scores[before] == scores[-1] == alone


# 10


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    text, out = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = [
    None,
    "",
    "write a.b+c@x-y.example.co and a@b.c_d@e.f, x@y no@dot. q@r..s t@u.v.",
    "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5.6.7.8.9 0000000000001.2.3.4 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 12- 34 1 2 3 4242424242424242424242 1",
    "call +1 (499) 555-6503 or +44 20 7946 0958. +123 +1234567890123456 ++49 30 1234567-",
    "é😀 mail é@x.de z@é.de 😀k@l.mn IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and GB82WEST12345698765431",
    "9" * 5000 + " a@" + "b." * 3000 + "c " + "1 " * 4000 + "x" * 5000 + "@",
]


def test_pii(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(PII)] + [(None, PII[2], "x", 7), (2, PII[2], "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string, n_chars int")
    found = op10_pii.find_spans(docs.drop("pii")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [f"{x.kind}:{x.start}:{x.end}" for x in r.pii if x.kind not in op10_pii.ADDED] == brute_pii(r.text)
    assert sum(x.kind == "iban" for r in found for x in r.pii) == 2
    masked = op10_pii.masked(docs)
    assert masked.schema == docs.schema
    by = {r.doc_id: r for r in masked.collect()}
    assert by[0].text is None and by[1].text == ""
    assert by[5].text.startswith("call [PHONE] or [PHONE]. +123") and by[5].n_chars == len(by[5].text)
    assert op10_pii.find_spans(docs.drop("pii").limit(0)).collect() == []




def iban(country, bban):
    turned = "".join(str(int(c, 36)) for c in f"{bban}{country}00")
    return f"{country}{98 - int(turned) % 97:02d}{bban}"


def test_an_iban_ends_where_its_country_says(spark):
    other = iban("ZZ", "12345678901234")
    texts = {
        "ES9121000418450200051332 EUR": 1, "BE68 5390 0754 7034 BANK": 1, f"{iban('PL', '109010140000071219812874')} PLN X": 1, "NO9386011117947 NOK": 1, "BE68 5390 0754 7035 BANK": 0,
        "BE6853900754703": 0, "BE68539007547034A": 0, f"{iban('AT', '1904300234573201')} AND SE4550000000058398257466 SEK": 2, other: 0, f"account {other}": 1,
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.text: [x for x in r.pii if x.kind == "iban"] for r in op10_pii.find_spans(docs).collect()}
    assert {t: len(x) for t, x in found.items()} == texts
    assert found["BE68 5390 0754 7034 BANK"][0][1:] == (0, 19, 70) and found[f"account {other}"][0].score == 80
    assert {r.doc_id: r.text for r in op10_pii.masked(docs).collect()}[1] == "[IBAN] BANK"


KEY = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
CONTEXTS = {  # kinds whose context decides
    f'token = "{KEY}"': 1, f'API {KEY.upper()}': 1, f"see {KEY}": 0, f"commit {KEY}": 0, f"token of commit {KEY}": 0, f"token{' ' * 60}{KEY}": 0, f"key {'1' * 40}": 0, f"key {'a' * 40}": 0, f"key {KEY}_": 0, f"\u00e9 key \u00e9{KEY[:32]}": 1, f"key {KEY[:31]}": 0,
    "BE68 5390 0754 7034": 1, "serial BE68 5390 0754 7034": 0, "serial of the account BE68 5390 0754 7034": 1, "_BE68539007547034": 0, "DE89 3704 0044 ES9121000418450200051332": 1,
}


def test_context_decides(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CONTEXTS)], "doc_id long, text string")
    assert {r.text: len(r.pii) for r in op10_pii.find_spans(docs).collect()} == CONTEXTS
    assert [r.text for r in op10_pii.masked(docs).collect()][0] == 'token = "[SECRET]"'


def test_pii_in_sql(spark, tmp_path):
    texts = [*PII[:-1], *CONTEXTS, f"{iban('AT', '1904300234573201')} AND SE4550000000058398257466 SEK, konto {iban('ZZ', '12345678901234')}", "ip 1.2.3.4 version 1.2.3.4 call +1 (499) 555-6503"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_pii.op10_pii(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(op10_pii.OP10_SQL)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "n_secret", "scores"]
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_working_columns_give_way(spark):
    names = "doc_id long, text string, source string, n_chars long, _mask_spans int, _MASK_text int, _pii string, __pii_email_m int, _mix_hash int, _mix_row string, _of int, _size int, _taken int, _time int, _left int, _near_id int, _row int, _id int, _hash int, `_text` int"
    rows = [(i, f"word{i} a{i}@b.example c d e f g", f"s{i % 2}", 9, *[1] * 2, "x", 2, 3, "y", *[4] * 10) for i in range(30)]
    docs = spark.createDataFrame(rows, names)
    masked = op10_pii.masked(docs)
    assert masked.schema == docs.schema and masked.first().text == "word0 [EMAIL] c d e f g" and masked.first()[4:] == rows[0][4:]
    mixed = op6_mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema and {tuple(r)[4:] for r in mixed.collect()} == {rows[0][4:]}
    kept = op4_near_dedup.keep_one_of_each(docs, copies=False)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == sorted(rows)
