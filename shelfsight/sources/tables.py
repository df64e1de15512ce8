"""The engine's tables over the driver's: which driver columns stand in for which concept.

offers    lineitem: one listing a line, its shop the supplier, its variant the part
readings  events: observations of a listing (user) in time, with price and state
runs      orders: a pass of a source (priority) with a status and a start
catalogue part (variant, brand, family = brand and type), supplier (shop), nation (market), region
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows over all tasks of the session: for much work on each row of a table whose file has few row groups, which alone would be as few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer_id"),
        F.col("l_orderkey").alias("run_id"),
        F.col("l_partkey").alias("variant_id"),
        F.col("l_suppkey").alias("shop_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.when(F.col("l_returnflag") == "N", "new").when(F.col("l_returnflag") == "R", "refurbished").otherwise("used").alias("condition"),
        F.when(F.col("l_linestatus") == "O", "in_stock").otherwise("out_of_stock").alias("availability"),
        F.col("l_shipdate").alias("seen_at"),
    )


OFFERS = """offers AS (SELECT l_orderkey * 10 + l_linenumber AS offer_id, l_orderkey AS run_id, l_partkey AS variant_id, l_suppkey AS shop_id,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CASE l_returnflag WHEN 'N' THEN 'new' WHEN 'R' THEN 'refurbished' ELSE 'used' END AS condition,
  CASE l_linestatus WHEN 'O' THEN 'in_stock' ELSE 'out_of_stock' END AS availability, l_shipdate AS seen_at FROM lineitem)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error is an observation without a price; purchases take a listing off sale, errors make it a preorder."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("offer_id"),
        F.col("ts").alias("obs_at"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100 + 0.5)).cast("long").alias("cents"),
        F.when(F.col("event_type") == "purchase", "out_of_stock").when(F.col("event_type") == "error", "preorder").otherwise("in_stock").alias("state"),
        "event_type",
        "props",
    )


OBSERVATIONS = """observations AS (SELECT event_id, user_id AS offer_id, ts AS obs_at,
  CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END AS cents,
  CASE event_type WHEN 'purchase' THEN 'out_of_stock' WHEN 'error' THEN 'preorder' ELSE 'in_stock' END AS state, event_type, props FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("rejected")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("source"), (F.col("o_custkey") % 20).alias("shop_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.floor(F.col("o_totalprice")).cast("long").alias("items_seen")
    )


RUNS = """runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS source, o_custkey % 20 AS shop_id,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'rejected' END AS status, o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS items_seen FROM orders)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.col("p_name").alias("title"), F.col("p_size").alias("size"), F.col("p_retailprice").cast(MONEY).alias("list_price"))


VARIANTS = "variants AS (SELECT p_partkey AS variant_id, p_brand AS brand, p_type AS model, p_name AS title, p_size AS size, CAST(p_retailprice AS DECIMAL(12,2)) AS list_price FROM part)"


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shop_id"), F.col("s_name").alias("shop"), F.col("s_nationkey").alias("market_id"))


SHOPS = "shops AS (SELECT s_suppkey AS shop_id, s_name AS shop, s_nationkey AS market_id FROM supplier)"
