"""As-of reading and change events against brute force, and each query's shape on the smallest tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shelfsight.operators import rules as R
from shelfsight.operators.matching import axes, brand_lookup, ladder
from shelfsight.operators.rewrite import absent_only, merged, updated, upserted
from shelfsight.operators.asof import as_of_days, bands, changes, exact_median
from shelfsight.plans.catalogue import closure
from shelfsight.streaming.ingest import ingested

SMALL = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1)


def test_changes_come_back(spark):
    """A, B, A are three events; a null price is one too."""
    rows = spark.createDataFrame([(1, i, i, v) for i, v in enumerate([5, 5, 7, 5, None, None, 5])], "k long, at long, id long, v long")
    assert [r.id for r in changes(rows, "k", "at", "id", "v").orderBy("id").collect()] == [0, 2, 3, 4, 6]
    assert changes(rows.limit(0), "k", "at", "id", "v").collect() == []


def test_as_of_equals_brute_force(spark):
    events = [(k, DAY + dt.timedelta(hours=h * (k + 3)), n, None if n % 5 == 0 else n) for k in range(3) for n, h in enumerate(range(0, 30))]
    days = [(k, (DAY + dt.timedelta(days=d)).date()) for k in range(3) for d in range(6)]
    got = as_of_days(spark.createDataFrame(events, "k long, at timestamp, id long, v long"), spark.createDataFrame(days, "k long, day date"), "k", "at", "id", {"v": F.col("v")})
    want = {}
    for k, day in days:
        end = dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1)
        past = [(a, i, v) for key, a, i, v in events if key == k and a < end]
        want[k, day] = max(past, key=lambda x: x[:2])[2] if past else None
    assert {(r.k, r.day): r.v for r in got.collect()} == want


@pytest.mark.parametrize("values, middle", [([1, 2], 2), ([2, 3], 2), ([76400, 76401], 76400), ([76401, 76402], 76402), ([9], 9), ([3, 1, 2], 2)])
def test_median_rounds_half_to_even(spark, values, middle):
    assert spark.range(1).select(exact_median(F.array(*[F.lit(v).cast("long") for v in values]))).first()[0] == middle


def test_bands_equal_medians_of_arrays(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") * F.col("id") % 41 - 5).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(8, 3), (9, 76401), (9, 76402)], "k long, v long"))
    want = rows.groupBy("k").agg(F.min("v"), exact_median(F.collect_list("v")), F.max("v"), F.count("*"))
    assert sorted(map(tuple, bands(rows, "k", "v").collect())) == sorted(map(tuple, want.collect()))
    assert bands(rows.limit(0), "k", "v").collect() == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_a_day_is_not_gathered_in_one_array(spark):
    plan = __spark_entry__.queries()["price_series_band"](spark, SMALL)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "_upto" in plan


def test_closure(spark):
    tree = spark.createDataFrame([("a", None, True), ("b", "a", True), ("c", "b", False)], "id string, parent string, visible boolean")
    assert {(r.id, r.above, r.depth) for r in closure(tree).collect()} == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}


def test_replayed_stream_gives_each_event_once(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    events.limit(50).write.mode("append").parquet(source)
    got = ingested(spark, source, events.schema, str(tmp_path / "out"), str(tmp_path / "state"))
    assert got.count() == events.count() == got.select("event_id").distinct().count()
    assert ingested(spark, source, events.schema, str(tmp_path / "out"), str(tmp_path / "state")).count() == events.count()


def test_entry_and_names():
    named = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(named)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["day", "low", "median", "high", "listings"]


def test_deep_trees_and_cycles(spark):
    deep = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, i != 7) for i in range(41)], "id string, parent string, visible boolean")
    found = {(r.id, r.above): r.depth for r in closure(deep).collect()}
    assert len(found) == 41 * 42 // 2 and found["n40", "n0"] == 40 and found["n40", "n39"] == 1
    with pytest.raises(ValueError):
        closure(spark.createDataFrame([("a", "b", True), ("b", "a", True)], "id string, parent string, visible boolean"))
    assert closure(deep.limit(0)).collect() == []


def test_late_rows_are_taken_in(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, day)
    schema = "event_id long, ts timestamp, v int"
    for n, rows in enumerate([[(1, at(20), 1), (2, at(21), 1)], [(3, at(1), 1), (1, at(20), 1)], [(3, at(1), 1), (4, at(30), 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = ingested(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4]


def test_rewrites(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(updated(table, new, ["k"])) == [(1, "a", 1), (2, "c", 2)]
    full = new.withColumn("n", F.lit(9))
    assert rows(upserted(table, full, ["k"])) == [(1, "a", 1), (2, "c", 9), (3, "d", 9)] and rows(absent_only(table, full, ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "d", 9)]
    assert rows(merged(table, spark.createDataFrame([(1, 2)], "`from` int, into int"), "k")) == [(2, "a", 1), (2, "b", 2)]


def test_rules_run_in_layers_and_rounds(spark):
    rules = R.Rules((
        R.Rule("b", R.CATEGORY, {"category": "x"}, lambda f: {"model": F.lit("from b"), "brand": F.lit("acme")}),
        R.Rule("a", R.CATEGORY, {"category": "x"}, lambda f: {"model": F.lit("from a"), "colour": F.lit("")}),
        R.Rule("acme", R.BRAND, {"brand": "acme"}, lambda f: {"line": F.lit("l")}, "why"),
        R.Rule("l", R.PRODUCT, {"line": "l"}, lambda f: {"model": F.lit("never: the line comes too late")}),
        R.Rule("end", R.FINISH, {}, lambda f: {"model": F.concat(F.regexp_replace(f["model"], "!$", ""), F.lit("!"))}),
    ))
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, category string")
    got = R.read_listings(rows, {"model": F.lit("m"), "brand": F.lit(None), "line": F.lit(None), "colour": F.lit("red")}, rules, trace=True).orderBy("id").collect()
    assert (got[0].model, got[0].brand, got[0].line, got[0].colour, got[0].version) == ("from b!", "acme", "l", "red", "generic-3+a,b+++acme+")
    assert [(t.rule, t.round, t.changed) for t in got[0].trace] == [("a", 1, ["model"]), ("b", 1, ["model", "brand"]), ("end", 1, ["model"]), ("acme", 2, ["line"])]
    assert (got[1].model, got[1].version) == ("m!", "generic-3+++++")
    with pytest.raises(ValueError):
        R.Rules((rules.rules[0], rules.rules[0]))


def test_ladder_by_hand(spark):
    e = [(1, "Acme", "c", "Lamp", "s", "red"), (2, "Acme", "c", "Lamp", "s", "blue"), (3, "Acme", "c", "Lamp", None, None), (4, "Beta", "c", "Desk", "m", None), (5, "Beta", "c", "Beta Sofa", None, "red")]
    entries = spark.createDataFrame(e, "variant_id long, brand string, category string, model string, size string, colour string").withColumn("axes", axes(size=F.col("size"), colour=F.col("colour")))
    gtins = spark.createDataFrame([("g1", 1, False), ("g2", 1, False), ("g2", 4, False), ("g3", 2, True)], "gtin string, variant_id long, learned boolean")
    mpns = spark.createDataFrame([("Acme", "P-1", 2), ("Beta", "P-1", 4), ("Acme", "P-2", 1), ("Acme", "P-2", 3)], "brand string, mpn string, variant_id long")
    categories = spark.createDataFrame([("c", ["size", "colour"], False), ("strict", ["size", "colour"], True)], "category string, required array<string>, strict boolean")
    aliases = spark.createDataFrame([("acme", "Acme"), ("beta", "Beta"), ("two", "Acme"), ("two", "Beta")], "alias string, brand string")
    cases = {  # gtin, brand_raw, title, mpn, model, size, colour: method, found, reason, state
        ("g1", None, None, None, None, None, "blue"): ("gtin", 1, None, "none_given"), ("g2", "acme", None, None, None, None, None): (None, None, "ambiguous", "resolved"),
        ("g3", "acme", None, None, None, "s", "red"): (None, None, "signals_unmatched", "resolved"), ("g3", "acme", None, None, "lamp", "s", "red"): ("brand_model", 1, None, "resolved"), ("g3", "acme", None, None, None, None, None): ("gtin", 2, None, "resolved"),
        (None, " ACME ", None, "p1", None, None, None): ("brand_mpn", 2, None, "resolved"), (None, "acme", None, "p1", None, None, "green"): (None, None, "signals_unmatched", "resolved"), (None, "acme", None, "P2", None, "s", None): (None, None, "ambiguous", "resolved"),
        (None, None, "Beta Desk", None, "desk", "m", None): ("brand_model", 4, None, "resolved_title"), (None, "acme", None, None, "lamp", "s", None): (None, None, "axis_unpublished", "resolved"), (None, "acme", None, None, "Acme Lamp", "s", "blue"): ("brand_model", 2, None, "resolved"),
        (None, "beta", None, None, "sofa", None, "red"): ("brand_model", 5, None, "resolved"), (None, "beta", None, None, "desk", None, "red"): (None, None, "low_confidence", "resolved"), (None, "two", None, None, "lamp", None, None): (None, None, "brand_ambiguous", "ambiguous"),
        (None, "nobody", "a lamp of (beta)", None, None, None, None): (None, None, "signals_unmatched", "resolved_title"), (None, "nobody", "acme2 beta2", None, "x", None, None): (None, None, "brand_unknown", "unknown"), (None, "--", None, None, None, None, None): (None, None, "brand_unknown", "unreadable"),
        (None, None, None, None, None, "s", None): (None, None, "no_signals", "none_given"),
    }
    rows = [(i, *c) for i, c in enumerate(cases)]
    listings = spark.createDataFrame(rows, "offer_id long, gtin string, brand_raw string, title string, mpn string, model string, size string, colour string").withColumn("axes", axes(size=F.col("size"), colour=F.col("colour")))
    listings = brand_lookup(listings, aliases).withColumn("category", F.lit("c")).withColumn("excused", F.array().cast("array<string>"))
    got = {r.offer_id: (r.method, r.found, r.reason, r.brand_state) for r in ladder(listings, entries, gtins, mpns, categories, ["size", "colour"]).collect()}
    assert {rows[i][1:]: x for i, x in got.items()} == cases
