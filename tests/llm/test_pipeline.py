"""The pipeline's stages on a small table, each against what it must have kept."""

import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from shelfsight.llm.op6_mixing import mixture
from shelfsight.llm.shared import saved

rng = np.random.default_rng(11)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n):
    return " ".join(f"w{i}" for i in rng.integers(0, 3000, size=n))


def test_stages(spark, tmp_path):
    good = [f"{prose(60)}.\n{prose(40)}." for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(good)]
    rows += [(100 + i, good[i] + (" tail" if i % 2 else ""), "en", f"s{i % 4}", len(good[i])) for i in range(10)]
    rows += [(200 + i, " ".join(f"{w}%%%" for w in prose(50).split()), "en", "s1", 300) for i in range(30)]
    rows += [(300, f"{prose(50)} write to some.body@mail.example.com or call +1 (499) 555-6503", "en", "s2", 1), (301, None, None, "s3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(not 200 <= r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int")
    at = str(tmp_path)
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")

    out, now = {}, spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = out[name] = saved(stage(spark, now, at))
        if name != "packing":
            assert now.columns == docs.columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in out.items()}
    assert ids["quality"] == {r[0] for r in rows if not 200 <= r[0] < 300}
    assert ids["near_dedup"] == {*range(60), 300, 301} == ids["pii"]
    text = out["pii"].where("doc_id = 300").first().text
    assert text.endswith("write to [EMAIL] or call [PHONE]")
    taken = {r.doc_id: r.taken for r in mixture(out["pii"]).collect() if r.taken}
    mixed = defaultdict(int)
    for r in out["mixing"].collect():
        mixed[r.doc_id] += len(WORDS.findall(r.text))
    assert mixed == taken
    pieces = out["packing"].collect()
    sequences = Counter()
    for r in pieces:
        sequences[r.sequence_id] += r.length
    assert {r.doc_id for r in pieces} == set(mixed) and max(sequences.values()) <= 2048
    again = corpus_pipeline.run(spark, at).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, again)) == sorted(map(key, pieces))
