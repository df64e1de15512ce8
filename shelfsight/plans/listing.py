"""The list of listings: one wide table, made once, and its filters."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listing import Filters, filtered, ordered
from ..operators.saved import met, saved, saved_once, to_join
from ..sources.tables import read
from .matching import _LADDER, _decided, _found, categories

#: A value for each filter, all in one: each is asked alone as well.
ASKED = Filters(
    seller=7, market="n3", shops=(7, 11, 23), variants=(100, 101, 102), products=("Brand#1|red rod", "Brand#2|old gear"), condition="new", listed=True, states=("queued",), reasons=("ambiguous", "brand_unknown"), methods=("gtin",), availabilities=("in_stock",), brands=("Brand#1", "Волна"),
    categories=("ECONOMY", "PROMO"), price_min="20000.50", price_max="40000", search="RED r", sources=(1, 4), has_gtin=True, has_model=False, has_all_axes=True, missing_axis="colour",
)
#: What is asked together.
SHOWN = Filters(condition="new", availabilities=("in_stock",), price_min="10000", has_model=True, states=("placed",))
NAMES = [f.name for f in fields(Filters)]


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = to_join(saved(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("shop"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("market"))))
    held = _found(spark, sf_dir).select(F.col("variant_id").alias("found"), F.col("variant_id"), F.col("brand").alias("entry_brand"), F.concat_ws("|", "brand", "model").alias("product"))
    required = saved(categories(spark, sf_dir).select(F.col("category").alias("_on"), "required"))
    rows = _decided(spark, sf_dir).where("offer_id is not null").join(shops, "seller_id", "left").join(held, "found", "left")
    rows = met(rows, F.col("category"), "offer_id", required)
    lacks = F.filter("required", lambda a: F.col("axes")[a].isNull())
    missing = F.when(F.size(lacks) > 0, F.concat(F.lit("/"), F.array_join(lacks, "/"), F.lit("/"))).when(F.col("required").isNotNull(), "")
    sources = F.when(F.col("offer_id") % 3 == 0, F.array(F.col("channel"), F.col("channel") + 1)).otherwise(F.array("channel"))
    return rows.select(
        "offer_id", F.concat(F.lit("x"), F.col("offer_id").cast("string")).alias("external_id"), "seller_id", F.col("seller_id").alias("shop_id"), "shop", "market", "category", "title", "gtin", "model", "price", F.when(F.col("is_new"), "new").otherwise("used").alias("condition"),
        F.when(F.col("line") == "O", "in_stock").otherwise("out_of_stock").alias("availability"), (F.col("line") == "O").alias("listed"), F.col("seen_at").alias("last_seen_at"), "first_seen_at", "method", "reason", F.when(F.col("method").isNotNull(), "placed").when(F.col("reason").isNotNull(), "queued").alias("state"),
        "variant_id", F.col("entry_brand").alias("brand"), "product", missing.alias("missing"), sources.alias("sources"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing with its match, entry and shop as one row of a written table, so that a list is one scan without a join."""
    return saved_once(spark, ("listings", sf_dir), lambda: _made(spark, sf_dir))


def offers_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of what several filters find together, dearest first, with the total."""
    found = filtered(listings(spark, sf_dir), SHOWN)
    return ordered(found, "price", True).offset(100).limit(50).crossJoin(found.agg(F.count("*").alias("total"))).select("offer_id", "price", "product", "total")


def offer_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings each filter finds by itself, and what it would find turned round where it asks yes or no: one scan."""
    flips = {f"{n}:not": Filters(**{n: not getattr(ASKED, n)}) for n in NAMES if isinstance(getattr(ASKED, n), bool)}
    asked = {n: Filters(**{n: getattr(ASKED, n)}) for n in NAMES} | flips
    counts = listings(spark, sf_dir).agg(*[F.count_if(next(f.conditions())).alias(n) for n, f in asked.items()])
    each = F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"`{n}`").alias("listings")) for n in asked])
    return counts.select(F.explode(each).alias("x")).select("x.*")


QUERIES = {f.__name__: f for f in (offers_filtered, offer_filter_counts)}

_TABLE = f"""{_LADDER}, lines AS (SELECT l_orderkey * 10 + l_linenumber AS offer_id, CAST(max(l_extendedprice) AS DECIMAL(12,2)) AS price, max(l_linestatus) = 'O' AS listed FROM lineitem GROUP BY ALL),
t AS (SELECT f.offer_id, f.seller_id, s_nationkey, f.category, f.title, f.gtin, f.model, f.channel, price, listed, f.is_new, method, reason, e.variant_id, e.brand, e.model AS entry_model, wants_size AND f.size IS NULL AS no_size, wants_colour AND f.colour IS NULL AS no_colour
  FROM listing_facts f JOIN lines USING (offer_id) LEFT JOIN supplier ON s_suppkey = f.seller_id LEFT JOIN decided d ON d.offer_id = f.offer_id LEFT JOIN entry e ON e.variant_id = d.found LEFT JOIN category c ON c.category = f.category)"""
_FINDS = {
    "seller": "seller_id = 7", "market": "s_nationkey = 3", "shops": "seller_id IN (7, 11, 23)", "variants": "variant_id IN (100, 101, 102)", "products": "brand = 'Brand#1' AND entry_model = 'red rod' OR brand = 'Brand#2' AND entry_model = 'old gear'", "condition": "is_new", "listed": "listed", "listed:not": "NOT listed",
    "states": "method IS NULL AND reason IS NOT NULL", "reasons": "reason IN ('ambiguous', 'brand_unknown')", "methods": "method = 'gtin'", "availabilities": "listed", "brands": "brand IN ('Brand#1', 'Волна')", "categories": "category IN ('ECONOMY', 'PROMO')", "price_min": "price >= 20000.50", "price_max": "price <= 40000",
    "search": "title ILIKE '%red r%'", "sources": "channel IN (1, 4) OR offer_id % 3 = 0 AND channel IN (0, 3)", "has_gtin": "gtin IS NOT NULL", "has_gtin:not": "gtin IS NULL", "has_model": "coalesce(model, '') = ''", "has_model:not": "model <> ''",
    "has_all_axes": "NOT no_size AND NOT no_colour", "has_all_axes:not": "no_size OR no_colour", "missing_axis": "no_colour",
}
ORACLES = {
    "offers_filtered": f"""WITH {_TABLE}, s AS (SELECT * FROM t WHERE is_new AND listed AND price >= 10000 AND model <> '' AND method IS NOT NULL)
SELECT offer_id, price, brand || '|' || entry_model AS product, (SELECT count(*) FROM s) AS total FROM s ORDER BY price DESC NULLS LAST, offer_id DESC LIMIT 50 OFFSET 100""",
    "offer_filter_counts": f"WITH {_TABLE} " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER (WHERE {sql}) AS listings FROM t" for n, sql in _FINDS.items()),
}
