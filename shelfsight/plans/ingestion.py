"""A batch of listings taken in: refused and accepted items, coverage, sellers, offers, and what each observation sets.

An item that is refused never stops the others: each carries its error, and counters say how many there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unicode import payload_hash
from ..operators.rewrite import upserted
from ..sources.tables import OBSERVATIONS, observations, read
from .matching import LISTING_FACTS, _facts

FIELDS = ("title", "brand_raw", "gtin", "mpn", "model", "price")
_ITEMS = f"""SELECT *, offer_id % 7 AS batch, CASE WHEN offer_id % 19 <> 0 THEN CAST(offer_id % 5000 AS STRING) END AS external_id, channel % 2 = 0 AS marketplace, CASE WHEN offer_id % 23 <> 0 THEN seller_id * 10 + offer_id % 3 END AS said_seller,
  CASE WHEN offer_id % 29 = 0 THEN -1 WHEN offer_id % 37 = 0 THEN NULL ELSE offer_id % 1000 END AS price FROM ({LISTING_FACTS}) f"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the seller that is theirs and the first thing wrong with them."""
    error = (
        F.when(F.col("external_id").isNull(), "external_id_required").when(F.col("marketplace") & F.col("said_seller").isNull(), "seller_required").when(F.col("price") < 0, "price_negative")
    )
    seller = F.when(F.col("marketplace"), F.concat(F.lit("m"), F.col("said_seller").cast("string"))).otherwise(F.concat(F.lit("s"), F.col("channel").cast("string")))
    return _facts(spark, sf_dir, _ITEMS).withColumn("error", error).withColumn("seller", seller)


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each batch by what became of them."""
    outcome = F.coalesce("error", F.lit("accepted"))
    return _items(spark, sf_dir).groupBy("batch", outcome.alias("outcome")).agg(F.count("*").alias("items"))


def batch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each batch's accepted items that say a field, to four digits."""
    rows = _items(spark, sf_dir).where("error is null").groupBy("batch").agg(F.count("*").alias("accepted"), *[F.count(f).alias(f"_{f}") for f in FIELDS])
    return rows.select("batch", "accepted", *[F.round(F.col(f"_{f}").cast("decimal(18,0)") / F.col("accepted"), 4).cast("decimal(10,4)").alias(f) for f in FIELDS])


def coverage_of_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches' shares, each counted by its accepted items."""
    rows = batch_coverage(spark, sf_dir)
    total = F.sum("accepted")
    return rows.agg(total.alias("accepted"), *[F.round(F.sum(F.col(f) * F.col("accepted")).cast("decimal(24,4)") / total, 4).cast("decimal(10,4)").alias(f) for f in FIELDS])


def sellers_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers of marketplaces that accepted items name and nobody knows yet (two of each supplier's are known)."""
    named = _items(spark, sf_dir).where("error is null and marketplace").groupBy("seller").agg(F.min("batch").alias("first_batch"), F.count("*").alias("items"))
    known = read(spark, sf_dir, "supplier").select(F.explode(F.array(F.col("s_suppkey") * 10, F.col("s_suppkey") * 10 + 1)).alias("number")).select(F.concat(F.lit("m"), F.col("number").cast("string")).alias("seller"))
    return named.join(known, "seller", "left_anti")


def offers_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers by seller and the seller's number after all batches: of several items the newest counts; those that no batch names stay."""
    rows = _items(spark, sf_dir).where("error is null")
    newest = rows.groupBy("seller", "external_id").agg(F.max_by(F.struct("offer_id", "price", "title"), F.struct("seen_at", "offer_id")).alias("x")).select("seller", "external_id", "x.*")
    held = rows.where("batch = 0").groupBy("seller", "external_id").agg(F.min("offer_id").alias("offer_id")).withColumn("price", F.lit(None).cast("int")).withColumn("title", F.lit("as it was"))
    return upserted(held, newest.where("offer_id % 2 = 0"), ["seller", "external_id"])


def readings_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing after its observations: price and state of the newest one, the rest of the newest that isn't quick (a click)."""
    seen = observations(spark, sf_dir)
    key = F.struct("obs_at", "event_id")
    full = F.when(F.col("event_type") != "click", key)
    k = F.get_json_object("props", "$.k")
    return seen.groupBy("offer_id").agg(F.max_by("cents", key).alias("cents"), F.max_by("state", key).alias("state"), F.max_by(k, full).alias("title"), F.max_by("event_id", full).alias("read_from"), F.max("obs_at").alias("last_seen"))


def content_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations whose content the listing has had are the same raw row: its first sight, its last, and how often."""
    seen = observations(spark, sf_dir).withColumn("content", payload_hash(F.col("props")))
    return seen.groupBy("offer_id", "content").agg(F.min_by("event_id", F.struct("obs_at", "event_id")).alias("event_id"), F.max("obs_at").alias("last_seen"), F.count("*").alias("seen"))


def maker_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that an entry of the maker holds, and those that wait under its name: each once."""
    rows = _facts(spark, sf_dir, LISTING_FACTS)
    placed = rows.where("gtin is not null and title like '%Brand#1%'").select("offer_id")
    waiting = rows.where("trim(brand_raw) = 'BRAND#1'").select("offer_id")
    return placed.union(waiting).distinct()


QUERIES = {f.__name__: f for f in (batch_report, batch_coverage, coverage_of_pass, sellers_created, offers_upserted, readings_applied, content_seen, maker_listings)}
_I = f"""items AS (SELECT *, CASE WHEN external_id IS NULL THEN 'external_id_required' WHEN marketplace AND said_seller IS NULL THEN 'seller_required' WHEN price < 0 THEN 'price_negative' END AS error,
  CASE WHEN marketplace THEN 'm' || said_seller ELSE 's' || channel END AS seller FROM ({_ITEMS}) i)"""
_SHARE = ", ".join(f"CAST(round(count({f}) / count(*), 4) AS DECIMAL(10,4)) AS {f}" for f in FIELDS)
ORACLES = {
    "batch_report": f"WITH {_I} SELECT batch, coalesce(error, 'accepted') AS outcome, count(*) AS items FROM items GROUP BY ALL",
    "batch_coverage": f"WITH {_I} SELECT batch, count(*) AS accepted, {_SHARE} FROM items WHERE error IS NULL GROUP BY batch",
    "coverage_of_pass": f"WITH {_I}, c AS (SELECT batch, count(*) AS accepted, {_SHARE} FROM items WHERE error IS NULL GROUP BY batch) SELECT CAST(sum(accepted) AS BIGINT) AS accepted, {', '.join(f'CAST(round(sum({f} * accepted) / sum(accepted), 4) AS DECIMAL(10,4)) AS {f}' for f in FIELDS)} FROM c",
    "sellers_created": f"WITH {_I} SELECT seller, min(batch) AS first_batch, count(*) AS items FROM items WHERE error IS NULL AND marketplace AND seller NOT IN (SELECT 'm' || (s_suppkey * 10 + k) FROM supplier, range(2) r(k)) GROUP BY seller",
    "offers_upserted": f"""WITH {_I}, n AS (SELECT seller, external_id, offer_id, price, title FROM (SELECT *, row_number() OVER (PARTITION BY seller, external_id ORDER BY seen_at DESC, offer_id DESC) AS k FROM items WHERE error IS NULL) WHERE k = 1 AND offer_id % 2 = 0)
SELECT * FROM n UNION ALL SELECT seller, external_id, min(offer_id), NULL, 'as it was' FROM items i WHERE error IS NULL AND batch = 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.seller = i.seller AND n.external_id = i.external_id) GROUP BY seller, external_id""",
    "readings_applied": f"""WITH {OBSERVATIONS}, l AS (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY obs_at DESC, event_id DESC) AS k FROM observations), f AS (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY obs_at DESC, event_id DESC) AS k FROM observations WHERE event_type <> 'click')
SELECT l.offer_id, l.cents, l.state, json_extract_string(f.props, '$.k') AS title, f.event_id AS read_from, l.obs_at AS last_seen FROM l LEFT JOIN f ON f.offer_id = l.offer_id AND f.k = 1 WHERE l.k = 1""",
    "content_seen": f"WITH {OBSERVATIONS} SELECT offer_id, sha256(regexp_replace(props, '\\s', '', 'g')) AS content, arg_min(event_id, (obs_at, event_id)) AS event_id, max(obs_at) AS last_seen, count(*) AS seen FROM observations GROUP BY ALL",
    "maker_listings": f"WITH f AS ({LISTING_FACTS}) SELECT offer_id FROM f WHERE gtin IS NOT NULL AND title LIKE '%Brand#1%' UNION SELECT offer_id FROM f WHERE trim(brand_raw) = 'BRAND#1'",
}
