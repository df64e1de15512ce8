"""What must not grow faster than its input: shuffles of whole rows, work for each row, tasks."""

from pyspark.sql import functions as F

from shelfsight.operators import rules
from shelfsight.operators.matching import ladder
from shelfsight.operators.unresolved import cases
from shelfsight.plans import connectors, laptops, reading

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_listings_meet_their_answers_without_a_shuffle(spark):
    axes = "map<string,string>"
    listings = spark.createDataFrame(
        [(1, "g1", "A", "A", "resolved", None, "x", "A x", {"size": "1"}, "c", []), (2, None, "A", "A", "resolved", "p1", None, None, {}, "c", []), (3, None, None, None, "none_given", None, None, None, {}, "c", [])],
        f"offer_id long, gtin string, brand string, brand_raw string, brand_state string, mpn string, model string, title string, axes {axes}, category string, excused array<string>",
    )
    entries = spark.createDataFrame([(10, "A", "c", "x", {"size": "1"}), (11, "A", "c", "y", {})], f"variant_id long, brand string, category string, model string, axes {axes}")
    gtins = spark.createDataFrame([("g1", 10, False)], "gtin string, variant_id long, learned boolean")
    mpns = spark.createDataFrame([("A", "p1", 11)], "brand string, mpn string, variant_id long")
    got = ladder(listings, entries, gtins, mpns, spark.createDataFrame([("c", ["size"], False)], "category string, required array<string>, strict boolean"), ["size"])
    assert "Exchange hashpartitioning" not in _plan(got)
    assert {(r.offer_id, r.method, r.found, r.reason) for r in got.collect()} == {(1, "gtin", 10, None), (2, "brand_mpn", 11, None), (3, None, None, "no_signals")}


def test_much_work_on_each_row_is_dealt_to_all_tasks(spark):
    for query in (connectors.decoded_encoded, connectors.decoded_coded, laptops.laptop_read, reading.title_names):
        assert "RoundRobinPartitioning" in _plan(query(spark, SF)), query.__name__


def test_a_barcode_is_looked_at_once(spark):
    assert _plan(reading.gtin_picks(spark, SF)).count("regexp_replace") <= 2


def test_each_content_is_read_once(spark, monkeypatch):
    kept, save = [], rules.saved

    def seen(df):
        kept.append(save(df))
        return kept[-1]

    monkeypatch.setattr(rules, "saved", seen)
    rows = spark.createDataFrame([(i, (None, "a", "b")[i % 3]) for i in range(30)], "offer_id long, said string")
    made = rules.Rules((rules.Rule("x", rules.FINISH, {}, lambda f: {"title": F.concat(f["title"], F.lit("!"))}),))
    got = rules.read_each_once(rows, "offer_id", {"title": F.col("said")}, made)
    assert kept[0].count() == 3
    assert {(r.offer_id, r.title) for r in got.collect()} == {(i, (None, "a!!", "b!!")[i % 3]) for i in range(30)}


def test_listings_of_a_common_value_are_not_brought_together(spark):
    stated = spark.createDataFrame([(i, "colour", "Black" if i else "black/blue") for i in range(9)], "offer_id long, field string, written string")
    got = cases(stated, spark.createDataFrame([("black", "black"), ("blue", "blue")], "spelling string, canonical string"))
    assert "hashpartitioning(key" not in _plan(got)
    assert {(r.offer_id, r.reason, r.resolves_to) for r in got.collect()} == {(0, "pair", "black-blue")} | {(i, "resolves_now", "black") for i in range(1, 9)}
