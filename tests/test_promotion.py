"""Promotion with matching anew, against one listing after the other."""

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import promotion
from shelfsight.operators.matching import axes, ladder
from shelfsight.operators.promotion import promote

AXES = ["size", "colour"]
LISTING = "offer_id long, gtin string, brand string, mpn string, model string, size string, colour string, trusted boolean, title string, brand_raw string, brand_state string, category string"


def with_axes(df):
    return df.withColumn("axes", axes(size=F.col("size"), colour=F.col("colour"))).drop("size", "colour")


def catalogue(spark):
    entries = with_axes(spark.createDataFrame([(1, "Acme", "c", "Lamp", "s", "red")], "variant_id long, brand string, category string, model string, size string, colour string"))
    return entries, spark.createDataFrame([("g0", 1, False)], "gtin string, variant_id long, learned boolean"), spark.createDataFrame([("Acme", "P-0", 1)], "brand string, mpn string, variant_id long")


def listings(spark, rows):
    full = [(*r, "t", r[2], "resolved", "c") for r in rows]
    return with_axes(spark.createDataFrame(full, LISTING)).withColumn("excused", F.array().cast("array<string>"))


def one_by_one(spark, rows, categories, first_id):
    """Each listing on its own, against the catalogue that the ones before it left."""
    entries, gtins, mpns = catalogue(spark)
    identities, out = {("Acme", "lamp", "s", "red")}, {}
    for r in sorted(rows):
        one = listings(spark, [r])
        got = ladder(one.drop("trusted"), entries, gtins, mpns, categories, AXES).first()
        i, gtin, brand, mpn, model, size, colour, trusted = r
        if got.method:
            out[i] = ("joined", got.found)
        elif not trusted:
            out[i] = ("source_not_trusted", None)
        elif gtin is None and (size is None or colour is None):
            out[i] = ("no_barcode", None)
        elif brand is None:
            out[i] = ("brand_unresolved", None)
        elif not model:
            out[i] = ("no_model", None)
        elif (identity := (brand, model.lower().replace(" ", ""), size, colour)) in identities:
            out[i] = ("conflict", None)
        else:
            identities.add(identity)
            out[i] = ("created", first_id + i)
            entries = entries.unionByName(with_axes(spark.createDataFrame([(first_id + i, brand, "c", model, size, colour)], "variant_id long, brand string, category string, model string, size string, colour string")))
            if gtin:
                gtins = gtins.unionByName(spark.createDataFrame([(gtin, first_id + i, False)], gtins.schema))
            if mpn:
                mpns = mpns.unionByName(spark.createDataFrame([(brand, mpn, first_id + i)], mpns.schema))
    return out


def test_promotion_in_order(spark):
    rows = [  # offer_id, gtin, brand, mpn, model, size, colour, trusted
        (1, "g1", "Acme", "P-1", "Desk", "s", None, True), (2, "g1", "Acme", None, "Desk 2", "m", None, True), (3, None, "Acme", "p1", "other", "s", "red", True), (4, None, "Acme", None, "Desk", "m", "red", True), (5, None, "Acme", None, "desk", "m", "red", True), (6, "g6", "Acme", None, "Desk", "s", None, True),
        (7, None, "Acme", None, "Desk", None, None, True), (8, "g8", None, None, "x", None, None, True), (9, "g9", "Acme", None, None, None, None, True), (10, "g9", "Acme", None, "Nine", None, None, False), (11, "g9", "Acme", None, "Nine", None, None, True), (12, "g1", "Beta", None, "Desk", "l", "blue", True),
    ]
    categories = spark.createDataFrame([("c", ["size", "colour"], False)], "category string, required array<string>, strict boolean")
    got = promote(listings(spark, rows), *catalogue(spark), categories, AXES, 1000)
    found = {r.offer_id: (r.outcome, r.variant_id) for r in got.outcomes.collect()}
    assert found == one_by_one(spark, rows, categories, 1000)
    assert {x for x, _ in found.values()} >= {"created", "joined", "no_barcode", "brand_unresolved", "no_model", "source_not_trusted"}
    made = {v for x, v in found.values() if x == "created"}
    assert {r.variant_id for r in got.entries.collect()} == made | {1}


def test_a_popular_model_takes_a_round_for_each_entry_that_it_makes(spark):
    rows = [(i, None, "Acme", None, "Chair", "sml"[i % 3], "red", True) for i in range(1, 61)]
    categories = spark.createDataFrame([("c", ["size", "colour"], False)], "category string, required array<string>, strict boolean")
    got = promote(listings(spark, rows), *catalogue(spark), categories, AXES, 1000)
    out = got.outcomes.collect()
    assert {r.offer_id: r.variant_id for r in out} == {i: 1000 + (i % 3 or 3) for i in range(1, 61)} and max(r.round for r in out) <= 4


def test_nothing_waits(spark):
    categories = spark.createDataFrame([("c", ["size"], False)], "category string, required array<string>, strict boolean")
    assert promote(listings(spark, [(1, "g", "a", None, "m", None, None, True)]).limit(0), *catalogue(spark), categories, AXES, 9).outcomes.collect() == []


def test_a_round_costs_two_writes_and_asks_the_catalogue_no_more(spark, monkeypatch):
    written, save = [], promotion.saved

    def kept(df):
        written.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(df)

    monkeypatch.setattr(promotion, "saved", kept)
    rows = [(i, None, "Acme", f"P-{i}", "Chair", "sml"[i % 3], "red", True) for i in range(1, 10)]
    categories = spark.createDataFrame([("c", ["size", "colour"], False)], "category string, required array<string>, strict boolean")
    got = promotion.promote(listings(spark, rows), *catalogue(spark), categories, AXES, 1000)
    out = got.outcomes.collect()
    rounds = max(r.round for r in out)
    assert {r.offer_id: (r.outcome, r.variant_id) for r in out} == {i: ("created" if i < 4 else "joined", 1000 + (i % 3 or 3)) for i in range(1, 10)}
    assert rounds == 4 and len(written) <= 4 + 2 * rounds
    assert not any("model" in plan or "mpn" in plan for plan in written[4:])  # what the catalogue holds was read before the first round
