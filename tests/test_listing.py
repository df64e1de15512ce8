"""Every filter of the list of listings, alone and together, against plain Python; and what reaches the scan."""

import datetime as dt
from dataclasses import fields
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfsight.operators.listing import ORDERS, Filters, filtered, page
from shelfsight.operators.matching import pending

SCHEMA = (
    "offer_id long, external_id string, seller_id long, shop_id long, shop string, market string, category string, title string, gtin string, model string, price decimal(12,2), condition string, availability string, listed boolean, last_seen_at timestamp, first_seen_at timestamp, "
    "method string, reason string, state string, variant_id long, brand string, product string, missing string, sources array<int>"
)
BARCODE = "04006381333931"


def _rows():
    pick = lambda n, values: values[n % len(values)]
    at = dt.datetime(2024, 1, 1)
    return [
        (i, f"ext-{i}", i % 4, i % 5, pick(i, ["b", "a", None]), pick(i, ["LV", "EE"]), pick(i, ["c", "d", None]), pick(i, ["Red 100% lamp", "blue Lamp", None, "re_d"]), pick(i, [None, BARCODE, "1"]), pick(i, ["m", "", None]), pick(i, [None, Decimal("9.99"), Decimal("10.00"), Decimal("20.50")]),
         pick(i, ["new", "used", None]), pick(i, ["in_stock", None, "out_of_stock"]), pick(i, [True, False, None]), at + dt.timedelta(days=i % 7), at, pick(i, ["gtin", None, "brand_mpn"]), pick(i, [None, "ambiguous", None]), pick(i, ["placed", "queued", "placed", None]),
         pick(i, [1, None, 2]), pick(i, ["A", None, "B"]), pick(i, ["A|m", None, "B|n"]), pick(i, ["", "/size/", "/size/colour/", None]), pick(i, [[1], [1, 2], [3], None, []]))
        for i in range(60)
    ]


CASES = {
    "seller": (2, lambda r: r.seller_id == 2), "market": ("lv", lambda r: r.market == "LV"), "shops": ((1, 3), lambda r: r.shop_id in (1, 3)), "variants": ((2,), lambda r: r.variant_id == 2), "products": (("A|m",), lambda r: r["product"] == "A|m"), "condition": ("used", lambda r: r.condition == "used"), "listed": (True, lambda r: r.listed is True),
    "states": (("queued",), lambda r: r.state == "queued"), "reasons": (("ambiguous", "x"), lambda r: r.reason == "ambiguous"), "methods": (("gtin",), lambda r: r.method == "gtin"), "availabilities": (("in_stock",), lambda r: r.availability == "in_stock"), "brands": (("A", "B"), lambda r: r.brand in ("A", "B")),
    "categories": (("c",), lambda r: r.category == "c"), "price_min": ("10", lambda r: r.price is not None and r.price >= 10), "price_max": ("10.00", lambda r: r.price is not None and r.price <= 10), "search": (" LAMP ", lambda r: "lamp" in (r.title or "").lower()), "sources": ((2, 3), lambda r: bool({2, 3} & set(r.sources or []))),
    "has_gtin": (True, lambda r: r.gtin is not None), "has_model": (True, lambda r: bool(r.model)), "has_all_axes": (True, lambda r: r.missing == ""), "missing_axis": ("size", lambda r: "/size/" in (r.missing or "")),
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


def test_each_filter_alone_and_turned_round(table):
    assert list(CASES) == [f.name for f in fields(Filters)] and len(CASES) == 21
    asked = {n: (Filters(**{n: v}), holds) for n, (v, holds) in CASES.items()} | {f"{n}:not": (Filters(**{n: False}), lambda r, holds=holds: not holds(r)) for n, (v, holds) in CASES.items() if v is True}
    asked |= {"percent": (Filters(search="100%"), lambda r: "100%" in (r.title or "")), "line": (Filters(search="e_"), lambda r: "e_" in (r.title or "")), "id": (Filters(search="EXT-1"), lambda r: "ext-1" in r.external_id), "code": (Filters(search="4006381333931"), lambda r: r.gtin == BARCODE), "blank": (Filters(search="  "), lambda r: True)}
    assert all(len(list(f.conditions())) == (n != "blank") for n, (f, _) in asked.items()) and not list(Filters().conditions())
    every = table.collect()
    # rows by the filters that hold, from one pass
    marked = table.select("offer_id", *[F.coalesce(next(f.conditions(), F.lit(True)), F.lit(False)).alias(n) for n, (f, _) in asked.items()]).collect()
    for name, (_, holds) in asked.items():
        assert {r.offer_id for r in marked if r[name]} == {r.offer_id for r in every if holds(r)}, name
        assert name == "blank" or 0 < sum(r[name] for r in marked) < 60, name


def test_filters_together_and_pages(table):
    every = table.collect()
    f = Filters(market="ee", has_model=True, price_min="9", search="lamp")
    want = [r for r in every if r.market == "EE" and r.model and r.price is not None and r.price >= 9 and "lamp" in (r.title or "").lower()]
    assert {r.offer_id for r in filtered(table, f).collect()} == {r.offer_id for r in want} and want
    for by, column in ORDERS.items():
        for down in (False, True):
            known = sorted((r for r in every if r[column] is not None), key=lambda r: (r[column], r.offer_id), reverse=down)
            rest = sorted((r for r in every if r[column] is None), key=lambda r: r.offer_id, reverse=down)
            rows, total = page(table, Filters(), by, down, offset=35, size=20)
            assert [r.offer_id for r in rows] == [r.offer_id for r in (known + rest)[35:55]] and total == 60, (by, down)
    assert page(table, Filters(seller=99)) == ([], 0) and page(table, Filters(seller=1), offset=70) == ([], 15) and page(table.limit(0), f) == ([], 0)
    for bad in ({"size": 0}, {"size": 501}, {"offset": -1}, {"by": "colour"}):
        with pytest.raises(ValueError):
            page(table, Filters(), **bad)


def test_filters_reach_the_scan(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for name, (value, _) in CASES.items():
        plan = filtered(stored, Filters(**{name: value})).select("offer_id")._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert bool(pushed) == (name not in ("search", "sources")), (name, pushed)
        assert plan.split("ReadSchema: ")[1].count(":") <= 5, name


def test_a_pass_tries_the_least_recently_tried(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    listings = spark.createDataFrame([(i, "used" if i == 6 else None if i == 7 else "new") for i in range(1, 9)], "offer_id long, condition string")
    matches = spark.createDataFrame([(1, True), (1, False), (2, False)], "offer_id long, active boolean")
    queue = spark.createDataFrame([(2, at(3)), (3, at(1)), (4, None), (8, at(1))], "offer_id long, last_attempt_at timestamp")
    assert [r.offer_id for r in pending(listings, matches, queue, 9).collect()] == [4, 5, 3, 8, 2]
    assert [r.offer_id for r in pending(listings, matches, queue, 3).collect()] == [4, 5, 3] and pending(listings, matches.limit(0), queue.limit(0), 1).first().offer_id == 1
    assert "TakeOrderedAndProject" in pending(listings, matches, queue, 3)._jdf.queryExecution().executedPlan().toString()
