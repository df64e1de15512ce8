"""Scalar rules against known values."""

import pytest
from pyspark.sql import functions as F

from shelfsight.functions import columns as C
from shelfsight.functions import unicode as U


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given, valid",
    [("5902983617747", True), ("036000291452", True), ("4006381333931", True), ("590-2983-617747", True), ("EAN 4006381333931", True), ("590298361774", False), ("401234500000", False), ("4006381333930", False), ("1226772", False), ("Y00001210299", False), ("", False)],
)
def test_barcodes(spark, given, valid):
    assert one(spark, C.gtin_valid(F.col("x")), x=given) is valid


def test_more_barcodes(spark):
    assert one(spark, C.gtin_canonical(F.col("x")), x="614141007349") == "00614141007349"
    assert one(spark, C.gtin_generic(F.col("x")), x="401234-500000") == "00401234500000"
    for odd in ("n/a", "-", "", "12345", "0" * 20):
        assert one(spark, C.gtin_generic(F.col("x")), x=odd) is None
    assert one(spark, C.gtin_restricted(F.col("x")), x="2001234567893") is True
    assert one(spark, C.gtin_restricted(F.col("x")), x="5902983617747") is False


def test_prices(spark):
    assert str(one(spark, C.price(F.col("x")), x="1 179,00")) == "1179.00"
    assert str(one(spark, C.price(F.col("x")), x="1179.00 EUR")) == "1179.00"
    assert one(spark, C.price(F.col("x")), x="1.179,00") is None
    assert one(spark, C.price(F.col("x")), x="-5") is None
    assert one(spark, C.currency(F.col("a"), F.col("b")), a="eur", b="") == "EUR"
    assert one(spark, C.currency(F.col("a"), F.col("b")), a=None, b="1179.00 EUR") == "EUR"


@pytest.mark.parametrize("value, unit, shown", [(131072, "mb", "128 GB"), (1048576, "mb", "1 TB"), (2097152, "mb", "2 TB"), (129024, "mb", "126 GB"), (64, "mb", "64 MB"), (1536, "mb", "1.5 GB"), (6.780, "inch", '6.78"'), (5, "none", "5")])
def test_display(spark, value, unit, shown):
    assert one(spark, C.display_number(F.lit(value).cast("decimal(20,6)"), F.lit(unit))) == shown


def test_titles_and_bags(spark):
    assert one(spark, C.compose_title(F.lit("Norvik"), F.lit(" "), F.lit(None).cast("string"), F.lit("128 GB"))) == "Norvik 128 GB"
    assert len({one(spark, C.word_bag(F.lit(x))) for x in ("16 Plus", "Plus 16", "16 PLUS", "16+")}) == 1
    assert one(spark, C.near_value(F.lit(1048576), F.lit(1024000))) and not one(spark, C.near_value(F.lit(1048576), F.lit(524288)))


def test_identity_key(spark):
    key = lambda category, axes, wanted=("a", "b"): one(spark, C.identity_key(F.lit("x"), F.lit(category), F.lit("m"), F.create_map(*[F.lit(x) for x in axes]), F.array(*[F.lit(x) for x in wanted])))
    assert key("2", ["a", "1", "b", "2"]) == key("2", ["b", "2", "a", "1"]) != key("3", ["a", "1", "b", "2"])
    assert key("2", ["a", "1"]) is None


def test_model_forms():
    assert len({U.model_form(x) for x in ("KX12B-77", "kx12b77", "KX 12 B77")}) == 1
    assert U.model_form("Orbit Q7+") != U.model_form("Orbit Q7")
    assert len({U.model_form(x) for x in ("Orbit Q5+", "Orbit Q5 Plus", "ORBIT Q5 PLUS", "Orbit Q5 +")}) == 1
    assert U.model_words("Orbit  Q7+ / LE") == "orbit q7+ le" and U.model_words("+ +") == ""


@pytest.mark.parametrize(
    "given, form",
    [("Norvik®", "norvik"), ("Keller GmbH", "keller"), ("Zaļā Puse SIA", "zaļā puse"), ("Põder OÜ", "põder"), ("Lumen Works Co., Ltd.", "lumen works"), ("AG Motoren", "ag motoren"), ("Pragas", "pragas"), ("Naab", "naab"), ("AG", "ag"), ("--", ""), ("Keller GmbH & Co. KG", "keller"), ("a Ltd Ltd", "a ltd"), ("Vela,Inc.", "vela")],
)
def test_brand_forms(given, form):
    assert U.brand_form(given) == form


def test_text_columns(spark):
    rows = spark.createDataFrame([("Rīgas Elektronika",), (None,), ("!!",)], "x string")
    assert [r[0] for r in rows.select(U.slugify(F.col("x"))).collect()] == ["rigas-elektronika", None, None]
    assert U.content_hash('{"b": 1, "a": {"d": 2, "c": 3}}') == U.content_hash('{"a":{"c":3,"d":2},"b":1}')
    assert U.category_form(" Straße  X ") == "strasse x"


def test_barcode_picks(spark):
    pick = lambda *xs: one(spark, C.gtin_pick(F.array(*[F.lit(x).cast("string") for x in xs])))
    assert pick("590298361774", "5902983617747", "036000291452") == "05902983617747"
    assert pick("036000291452", None, "x") == "00036000291452" and pick("2001234567893", "bad") is None and pick(None) is None
    assert one(spark, C.gtin_restricted(F.col("x")), x="0412345678903") is True and one(spark, C.gtin_restricted(F.col("x")), x="0036000291452") is False


def test_feeds(spark):
    fields = C.lowered(F.create_map(*[F.lit(x) for x in ("Title", "", "NAME", "  a   lamp ", "EAN", "1")]))
    assert one(spark, C.first_text(fields, C.TITLE_KEYS, 80)) == "a lamp" and one(spark, C.first_text(fields, C.MPN_KEYS, 80)) is None
    assert [one(spark, C.mapped(F.lit(x), C.AVAILABILITY, "unknown")) for x in ("In Stock", "pre-order", "soon")] == ["in_stock", "preorder", "unknown"]
    assert one(spark, C.category_path(F.array(F.lit(" Home  "), F.lit(" "), F.lit("Lamps")))) == "Home / Lamps"
    assert [one(spark, C.attribute_name(F.col("x")), x=x) for x in ("Memory, (RAM):", 'Screen size, "', "::", "Krāsa:")] == ["memory (ram)", "screen size", None, "krāsa"]
    assert one(spark, C.redacted(F.create_map(F.lit("Token"), F.lit("x"), F.lit("b"), F.lit("y")))) == {"Token": "[redacted]", "b": "y"}


@pytest.mark.parametrize("given, mb", [("12GB/512GB", 524288), ("128/4 GB", 131072), ("12/1 TB", 1048576), ("RAM 12 GB", None), ("8 GB RAM 0,5 TB", 524288), ("64MB", 64), ("none", None)])
def test_megabytes(spark, given, mb):
    assert one(spark, C.megabytes(F.col("x")), x=given) == mb


def test_storage_needs_agreement(spark):
    agreed = lambda stated, titled: one(spark, C.agreed_storage(F.array(*[F.lit(x).cast("long") for x in stated]), F.lit(titled).cast("long")))
    assert [agreed([1], None), agreed([1, 2], None), agreed([], 2), agreed([2], 2), agreed([1], 2), agreed([1, 2], 2)] == [1, None, 2, 2, None, 2]


def test_names_and_editions(spark):
    assert [one(spark, C.without_brand(F.lit(a), F.lit(b))) for a, b in (("Norvik Lamp", "norvik"), ("Norvikson Lamp", "Norvik"), ("Norvik", "Norvik"), ("Norvik - Lamp", "Norvik"))] == ["Lamp", "Norvikson Lamp", "Norvik", "Lamp"]
    assert [one(spark, C.size_as_name(F.col("x")), x=x) for x in ("14,5", '13"', "16", "x 14")] == [True, True, False, False]
    assert one(spark, C.edition(F.lit("Pad 5 EE DS"), F.lit("Pad 5"), F.lit(None).cast("string"))) == "enterprise" and one(spark, C.edition(F.lit("three"), F.lit("x"), F.lit("x"))) == "standard"
    assert [one(spark, C.without_edition(F.col("x")), x=x) for x in ("Pad 5 Enterprise Edition", "Pad EE 5", "Enterprise")] == ["Pad 5", "Pad 5", "Enterprise"]


def test_colours(spark):
    table = F.create_map(*[F.lit(x) for x in ("black", "black", "melna", "black", "sky blue", "blue", "red", "red", "two", "black-red")])
    assert [one(spark, C.colour_of(F.col("x"), table), x=x) for x in ("Midnight Black (new)", "icy sky blue", "silver shadow", "“Melna”", "")] == ["black", "blue", None, "black", None]
    pair = lambda *xs: one(spark, C.colour_pair(F.array(*[F.lit(x) for x in xs]), table))
    assert [pair("melna", "red"), pair("red", "melna"), pair("red"), pair("red", "mauve")] == ["black-red", None, "red", None]
    assert [one(spark, C.colour_in_title(F.col("x"), table), x=x) for x in ("Case 256GB red,", "red and black", "redder", "a sky blue one")] == ["red", None, None, "blue"]


def test_models(spark):
    names = F.create_map(*[F.lit(x) for x in ("orbit q7", "Q7", "orbit q7 ultra", "Q7U", "orbit q7+", "Q7P", "orbit", "O", "watch 5", "W5")])
    found = lambda x: one(spark, C.model_in_title(F.lit(x), names))
    assert [found(x) for x in ("Acme Orbit Q7 5G", "Orbit Q7 Ultra 5G", "Orbit Q7+ Plus", "Orbit Q7 Max", "Orbit Q7 + Watch 5", "Orbit Q7, watch 5", "none", "")] == ["Q7", "Q7U", "Q7P", None, None, None, None, None]


def test_identity_key_holds_kind_and_units(spark):
    key = lambda kind, n: one(spark, C.identity_key(F.lit("x"), F.lit("c"), F.lit("m"), F.create_map(F.lit("a"), F.lit("1")), F.array(F.lit("a")), F.lit(kind), F.lit(n)))
    assert len({key("single", 1), key("multipack", 1), key("multipack", 2)}) == 3
