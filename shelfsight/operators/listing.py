"""A page of listings under any of 21 filters, with the total that they find.

Filters become conditions on plain columns of one wide table, so that all but the text search reach its scan; a
filter that isn't given makes none. The total is counted while the page is sorted out: one scan gives both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import gtin_canonical, gtin_valid

#: What a page can be sorted by.
ORDERS = {"id": "offer_id", "price": "price", "last_seen_at": "last_seen_at", "first_seen_at": "first_seen_at", "shop": "shop", "title": "title"}
LARGEST_PAGE = 500


@dataclass(frozen=True)
class Filters:
    """None and an empty tuple ask for nothing. All that are given must hold; of a tuple one value."""

    seller: int | None = None
    market: str | None = None
    shops: tuple[int, ...] = ()
    variants: tuple[int, ...] = ()
    products: tuple[str, ...] = ()
    condition: str | None = None
    listed: bool | None = None
    states: tuple[str, ...] = ()
    reasons: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()
    availabilities: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    price_min: str | None = None
    price_max: str | None = None
    search: str | None = None
    sources: tuple[int, ...] = ()
    has_gtin: bool | None = None
    has_model: bool | None = None
    has_all_axes: bool | None = None
    missing_axis: str | None = None

    def conditions(self) -> Iterator[Column]:
        """One for each filter that is given, in the order of the fields."""
        c = F.col
        among = lambda column, values: [c(column).isin(*values)] if values else []
        equal = lambda column, value: [c(column) == value] if value is not None else []
        # a question of yes or no: rows of which it can't be said count as no
        asked = lambda holds, wanted: [holds if wanted else ~holds] if wanted is not None else []
        yield from equal("seller_id", self.seller)
        yield from equal("market", None if self.market is None else self.market.upper())
        yield from among("shop_id", self.shops)
        yield from among("variant_id", self.variants)
        yield from among("product", self.products)
        yield from equal("condition", self.condition)
        yield from asked(c("listed") & c("listed").isNotNull(), self.listed)
        yield from among("state", self.states)
        yield from among("reason", self.reasons)
        yield from among("method", self.methods)
        yield from among("availability", self.availabilities)
        yield from among("brand", self.brands)
        yield from among("category", self.categories)
        if self.price_min is not None:
            yield c("price") >= F.lit(self.price_min).cast("decimal(12,2)")
        if self.price_max is not None:
            yield c("price") <= F.lit(self.price_max).cast("decimal(12,2)")
        if self.search and self.search.strip():
            yield searched(self.search.strip())
        if self.sources:
            yield reduce(or_, [F.array_contains("sources", s) for s in self.sources])
        yield from asked(c("gtin").isNotNull(), self.has_gtin)
        yield from asked(c("model").isNotNull() & (c("model") != ""), self.has_model)
        yield from asked(c("missing").isNotNull() & (c("missing") == ""), self.has_all_axes)
        if self.missing_axis is not None:
            yield F.contains(c("missing"), F.lit(f"/{self.missing_axis}/"))


def searched(text: str) -> Column:
    """The text anywhere in title or outer id, whatever its case (`%` and `_` being themselves), or the barcode that it is."""
    inside = lambda column: F.contains(F.lower(column), F.lower(F.lit(text)))
    barcode = F.coalesce(gtin_valid(F.lit(text)), F.lit(False)) & (F.col("gtin") == gtin_canonical(F.lit(text)))
    return F.coalesce(inside("title"), F.lit(False)) | F.coalesce(inside("external_id"), F.lit(False)) | F.coalesce(barcode, F.lit(False))


def filtered(rows: DataFrame, filters: Filters) -> DataFrame:
    """rows (with the columns that Filters names) of which all filters hold.

    `missing` holds a category's axes that a listing lacks, each between slashes (`/size/colour/`), and is empty if
    it lacks none; null where the category is unknown, which lacks no named axis and hasn't all. `sources` is an array.
    """
    return rows.where(reduce(and_, filters.conditions(), F.lit(True)))


def ordered(rows: DataFrame, by: str = "id", descending: bool = False) -> DataFrame:
    """rows by one of ORDERS, nulls last either way, ids breaking ties in the same direction."""
    if by not in ORDERS:
        raise ValueError(f"no order {by!r}: {', '.join(ORDERS)}")
    column = F.col(ORDERS[by])
    return rows.orderBy(column.desc_nulls_last(), F.desc("offer_id")) if descending else rows.orderBy(column.asc_nulls_last(), F.asc("offer_id"))


def page(rows: DataFrame, filters: Filters, by: str = "id", descending: bool = False, offset: int = 0, size: int = 50) -> tuple[list, int]:
    """A page of at most LARGEST_PAGE rows, and how many rows the filters find, from one scan."""
    if not 0 < size <= LARGEST_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {LARGEST_PAGE} rows and begins at 0 or later")
    seen = Observation()
    found = filtered(rows, filters).observe(seen, F.count(F.lit(1)).alias("total"))
    out = ordered(found, by, descending).offset(offset).limit(size).collect()
    return out, seen.get["total"]
