"""Payloads with odd fields, and snapshots read again."""

import json

import pytest

from shelfsight.sources.payloads import coded, configurable, encoded, exported, faceted
from shelfsight.sources.snapshots import cheap, pages, reparse_stream, reparsed


def rows(spark, decode, *payloads, **more):
    table = spark.createDataFrame(list(enumerate(payloads)), "page_id long, payload string")
    return sorted(decode(table, **more).collect(), key=lambda r: (r.page_id, str(r.external_id)))


@pytest.mark.parametrize("decode", [faceted, encoded, configurable, coded, lambda p: exported(p, "x")])
def test_pages_that_hold_nothing(spark, decode):
    got = rows(spark, decode, None, "", "{", "[]", '{"items": null}', "<a>")
    assert [(r.page_id, r.failed) for r in got] == [(i, "not_decoded") for i in range(6)]
    assert rows(spark, decode) == []


def test_facets(spark):
    item = {"id": 5, "title": None, "item_price": "1.005", "attribute_string_1": ["a", " b "], "attribute_number_2": 7, "attribute_x": None}
    got = rows(spark, faceted, json.dumps({"items": [item, {"title": "no id"}, {"id": " "}], "_facet_names": {"attribute_number_2": "Two", "attribute_string_1": "Two"}}), json.dumps({"items": []}))
    assert len(got) == 1 and got[0].attributes == {"Two": "7"} and got[0].title is None and str(got[0].price) == "1.01" and got[0].codes == []
    got = rows(spark, faceted, json.dumps({"items": [item | {"item_price": "soon"}]}))
    assert got[0].price is None and got[0].attributes == {"attribute_string_1": "a; b", "attribute_number_2": "7"}


def test_names_in_base64(spark):
    item = {"id": "k", "title_lv": ["T"], "attributes": None, "attributes_lv_str_S3LEgXNh": "zila", "attributes_lv_num_w7w": 3, "attributes_lv_str_!!": "x", "attributes_ru_str_TW9kZWxpcw": "other tongue"}
    got = rows(spark, encoded, json.dumps({"items": [item]}))
    assert got[0].attributes == {"Krāsa": "zila", "ü": "3"} and got[0].title == "T" and got[0].codes == []


def test_families(spark):
    price = lambda x: {"minimum_price": {"final_price": {"value": x, "currency": "USD"}}}
    family = {"name": " F ", "variants": [{"product": {"sku": " s1 ", "price_range": price(2389.005)}, "attributes": [{"code": "c", "label": None}, {"code": None, "label": "x"}]}, {"product": None}]}
    got = rows(spark, configurable, json.dumps({"data": {"products": {"items": [family, {"name": "lone", "sku": "s2", "variants": []}]}}}))
    assert [(r.external_id, r.model, str(r.price), r.currency, r.attributes) for r in got] == [("s1", "F", "2389.01", "USD", {}), ("s2", "lone", "None", "EUR", {})]


def test_snapshots(spark, tmp_path):
    one = json.dumps({"items": [{"id": 1, "title": "A", "item_price": 5, "in_stock": True}]})
    two = "<e><item><name>B</name><link>x/7</link><category_full>Phones / M</category_full><price>3</price></item></e>"
    for source, name, body in [("facets", "p1.json", one), ("facets", "p2.json", "{"), ("export", "all.xml", two), ("new", "q", "?")]:
        (tmp_path / "in" / f"source={source}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"source={source}" / name).write_text(body)
    decoders = {"facets": faceted, "export": lambda p: exported(p, "Phones")}
    key = lambda df: sorted((r.source, r.page_id, str(r.external_id), str(r.price), str(r.failed)) for r in df.collect())
    want = [("export", "all.xml", "7", "3.00", "None"), ("facets", "p1.json", "1", "5.00", "None"), ("facets", "p2.json", "None", "None", "not_decoded"), ("new", "q", "None", "None", "no_decoder")]
    stored = pages(spark, str(tmp_path / "in"))
    assert key(reparsed(stored, decoders)) == want
    assert key(reparse_stream(spark, str(tmp_path / "in"), decoders, str(tmp_path / "out"), str(tmp_path / "state"), 40)) == want
    assert sorted(map(tuple, cheap(reparsed(stored, decoders)).select("source", "external_id").collect())) == [("export", "7"), ("facets", "1")]
    assert "PartitionFilters: [isnotnull(source" in pages(spark, str(tmp_path / "in"), "facets")._jdf.queryExecution().toString()


def test_unresolved_values(spark):
    from shelfsight.operators.unresolved import unresolved

    registry = spark.createDataFrame([("Black", "black"), ("blue", "blue")], "spelling string, canonical string")
    stated = [(1, "c", "Zilgans"), (2, "c", "Black, Blue"), (3, "a", "black"), (3, "b", "Blue "), (4, "c", "BLACK"), (5, "c", " "), (6, "c", None), (7, "c", "gone")] + [(i, "c", f"{'zilgans'[: i % 7]}{'zilgans'[i % 7 :].upper()}") for i in range(10, 40)]
    rows = spark.createDataFrame(stated, "offer_id long, field string, written string")
    got = unresolved(rows, registry, spark.createDataFrame([("GONE",)], "value string"))
    found = {(r.value, r.reason): (r.resolves_to, r.listings, r.spellings, [tuple(e) for e in r.examples]) for r in got.collect()}
    assert found["zilgans", "unknown"] == (None, 31, ["Zilgans", "zilGANS", "zilgANS", "zilgaNS", "zilganS"], [(1, "c", "Zilgans"), (10, "c", "zilGANS"), (11, "c", "zilgANS")])
    assert found["black, blue", "pair"][:2] == ("black-blue", 1) and found["blue", "conflict"][:2] == ("blue", 1) and found["black", "conflict"][1] == 1 and found["black", "resolves_now"][:2] == ("black", 1) and len(found) == 5
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    assert unresolved(rows.limit(0), registry, spark.createDataFrame([], "value string")).collect() == []
