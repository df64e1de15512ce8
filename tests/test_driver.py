"""What is sent to the driver and from there to all tasks: little, by what rows take in memory and not by their files."""

import re

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import promotion, saved, settling
from shelfsight.operators.matching import brand_lookup, ladder
from shelfsight.plans import lineage, listing, matching

from . import test_promotion, test_settling

SF = "/root/testdata/sf0.001"


#: A table that is sent to all tasks and keyed by a text (its hash is a number).
BY_TEXT = re.compile(r"HashedRelationBroadcastMode\(List\((coalesce\()?input\[\d+, string")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def climbed(spark):
    axes = "map<string,string>"
    listings = spark.createDataFrame(
        [(1, "g1", "A", "A", "resolved", None, "x", "A x", {"size": "1"}, "c", []), (2, None, "A", "A", "resolved", "p1", None, None, {}, "c", []), (3, None, None, None, "none_given", None, None, None, {}, None, []), (4, None, "A", "A", "resolved", None, "y", "z", {}, "d", [])],
        f"offer_id long, gtin string, brand string, brand_raw string, brand_state string, mpn string, model string, title string, axes {axes}, category string, excused array<string>",
    )
    entries = spark.createDataFrame([(10, "A", "c", "x", {"size": "1"}), (11, "A", "c", "y", {})], f"variant_id long, brand string, category string, model string, axes {axes}")
    gtins = spark.createDataFrame([("g1", 10, False)], "gtin string, variant_id long, learned boolean")
    mpns = spark.createDataFrame([("A", "p1", 11)], "brand string, mpn string, variant_id long")
    return ladder(listings, entries, gtins, mpns, spark.createDataFrame([("c", ["size"], False)], "category string, required array<string>, strict boolean"), ["size"])


OUTCOMES = {(1, "gtin", 10, None), (2, "brand_mpn", 11, None), (3, None, None, "no_signals"), (4, "brand_model", 11, None)}


def test_no_table_keyed_by_text_is_sent_to_all_tasks(spark):
    got = climbed(spark)
    plan = _plan(got)
    assert "HashedRelationBroadcastMode" in plan and not BY_TEXT.search(plan)
    assert {(r.offer_id, r.method, r.found, r.reason) for r in got.collect()} == OUTCOMES


def test_what_is_too_large_to_be_sent_meets_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(saved, "SENT", -1)
    got = climbed(spark)
    assert "BroadcastHashJoin" not in _plan(got)
    assert {(r.offer_id, r.method, r.found, r.reason) for r in got.collect()} == OUTCOMES
    rows = spark.createDataFrame([(1, "Acme", "x", None), (2, None, "Acme phone", "m"), (3, "", "", "the Acme")], "offer_id long, brand_raw string, title string, model string")
    looked = brand_lookup(rows, spark.createDataFrame([("acme", "Acme")], "alias string, brand string"))
    assert "BroadcastHashJoin" not in _plan(looked)
    assert {(r.offer_id, r.brand, r.brand_state) for r in looked.collect()} == {(1, "Acme", "resolved"), (2, "Acme", "resolved_title"), (3, None, "none_given")}


def test_rows_and_not_files_decide_what_is_sent(spark):
    long = saved.saved(spark.range(700).select("id", F.repeat(F.lit("x"), 50_000).alias("text")))  # 35 MB in small files
    few = saved.saved(spark.range(700).select("id", F.lit("x").alias("text")))
    assert "SortMergeJoin" in _plan(spark.range(9).join(saved.to_join(long), "id"))
    assert "BroadcastHashJoin" in _plan(spark.range(9).join(saved.to_join(few), "id"))


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id long, text string")
    answers = saved.saved(spark.createDataFrame([("a", 10), ("b", 20)], "_on string, n long"))
    monkeypatch.setattr(saved.F, "xxhash64", lambda *_: F.lit(3).cast("long"))
    assert {(r.id, r.text, r.n) for r in saved.met(rows, F.col("text"), "id", answers).collect()} == {(1, "a", 10), (2, "b", 20), (3, None, None), (4, "c", None)}


@pytest.mark.parametrize("query", [matching.queue_upsert, matching.learned_gtins, lineage.offer_trace])
def test_tables_that_grow_are_not_sent(spark, query):
    assert "BroadcastHashJoin" not in _plan(query(spark, SF))


def test_entries_that_are_many_are_not_sent(spark, monkeypatch):
    matching._decided(spark, SF)
    monkeypatch.setattr(saved, "SENT", -1)
    assert "BroadcastHashJoin" not in _plan(matching.axes_compared(spark, SF))


def test_the_list_of_listings_sends_no_table_keyed_by_text(spark):
    assert not BY_TEXT.search(_plan(listing._made(spark, SF)))


def _plans_of(monkeypatch, module) -> list[str]:
    plans, save = [], module.saved
    monkeypatch.setattr(module, "saved", lambda df: plans.append(_plan(df)) or save(df))
    return plans


def test_promotion_sends_no_table_keyed_by_text(spark, monkeypatch):
    plans = _plans_of(monkeypatch, promotion)
    rows = [(i, None, "Acme", f"P-{i}", "Chair", "sml"[i % 3], "red", True) for i in range(1, 5)]
    categories = spark.createDataFrame([("c", ["size", "colour"], False)], "category string, required array<string>, strict boolean")
    promotion.promote(test_promotion.listings(spark, rows), *test_promotion.catalogue(spark), categories, test_promotion.AXES, 1000)
    assert len(plans) > 4 and not any(BY_TEXT.search(p) for p in plans)


def test_a_rebuild_sends_no_table_keyed_by_text(spark, monkeypatch):
    t = test_settling
    state = {k: settling.saved(v) for k, v in t.state_of(spark, [(i, *x) for i, x in t.ENTRIES.items()], t.PLACED).items()}
    listings, kinds = settling.saved(t.listings_of(spark, t.LISTED)), settling.saved(t.kinds(spark))
    plans = _plans_of(monkeypatch, settling)
    settling.rebuild(state, listings, kinds, t.AXES)
    assert len(plans) > 4 and not any(BY_TEXT.search(p) for p in plans)
