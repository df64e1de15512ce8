"""Price and stock histories, daily series, coverage and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import as_of_days, bands, changes, newest
from ..sources.tables import OBSERVATIONS, observations

FIRST, LAST = "2024-01-01", "2024-01-30"


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(observations(spark, sf_dir), "offer_id", "obs_at", "event_id", "cents").select("event_id", "offer_id", "obs_at", "cents")


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(observations(spark, sf_dir), "offer_id", "obs_at", "event_id", "state").select("event_id", "offer_id", "obs_at", "state")


def _changed(column: str) -> str:
    return f"""WITH {OBSERVATIONS}, m AS (SELECT *, row_number() OVER w AS nth, lag({column}) OVER w AS was FROM observations WINDOW w AS (PARTITION BY offer_id ORDER BY obs_at, event_id))
SELECT event_id, offer_id, obs_at, {column} FROM m WHERE nth = 1 OR {column} IS DISTINCT FROM was"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offer_id, day, cents of listings that are on sale on a day."""
    seen = observations(spark, sf_dir)
    bounds = seen.groupBy("offer_id").agg(F.min("obs_at").alias("first"), F.max("obs_at").alias("last"))
    day = F.explode(F.sequence(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")))
    days = bounds.withColumn("day", day).where((F.col("first") < F.date_add("day", 1).cast("timestamp")) & (F.col("last") >= F.col("day").cast("timestamp"))).select("offer_id", "day")
    held = as_of_days(seen, days, "offer_id", "obs_at", "event_id", {"cents": F.col("cents"), "state": F.col("state")})
    return held.where(F.col("cents").isNotNull() & (F.coalesce("state", F.lit("unknown")) != "out_of_stock"))


_DAILY = f"""{OBSERVATIONS}, bounds AS (SELECT offer_id, min(obs_at) AS a, max(obs_at) AS b FROM observations GROUP BY offer_id),
days AS (SELECT offer_id, CAST(d AS DATE) AS day FROM bounds, generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY) t(d) WHERE a < d + INTERVAL 1 DAY AND b >= d),
ranked AS (SELECT d.offer_id, d.day, o.cents, o.state, row_number() OVER (PARTITION BY d.offer_id, d.day ORDER BY o.obs_at DESC, o.event_id DESC) AS nth
  FROM days d JOIN observations o ON o.offer_id = d.offer_id AND o.obs_at < d.day + INTERVAL 1 DAY),
daily AS (SELECT offer_id, day, cents FROM ranked WHERE nth = 1 AND cents IS NOT NULL AND state <> 'out_of_stock')"""


def price_series_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands(daily(spark, sf_dir), "day", "cents").withColumnRenamed("n", "listings")


def price_series_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shop's line is its cheapest listing of each day."""
    return daily(spark, sf_dir).groupBy("day", (F.col("offer_id") % 10).alias("shop_id")).agg(F.min("cents").alias("low"), F.count("*").alias("listings"))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the newest hundred changes of a closed time range."""
    rows = changes(observations(spark, sf_dir), "offer_id", "obs_at", "event_id", "cents")
    page = rows.where((F.col("obs_at") >= "2024-01-05") & (F.col("obs_at") <= "2024-01-20")).orderBy(F.desc("event_id")).limit(100)
    return page.select("event_id", "offer_id", "obs_at", "cents")


def availability_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after an id: what remains below it, newest first."""
    rows = changes(observations(spark, sf_dir), "offer_id", "obs_at", "event_id", "state").where("event_id < 8000")
    return rows.orderBy(F.desc("event_id")).limit(100).select("event_id", "offer_id", "obs_at", "state")


def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observations(spark, sf_dir)
    return newest(seen, ["offer_id"], F.desc("obs_at"), F.desc("event_id")).select("offer_id", "event_id", "obs_at", "cents", "state")


def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest observation of any kind, and the newest that isn't a quick one (a click)."""
    seen = observations(spark, sf_dir)
    key = F.struct("obs_at", "event_id")
    full = F.when(F.col("event_type") != "click", key)
    return seen.groupBy("offer_id").agg(F.max_by("cents", key).alias("cents"), F.max_by("event_id", full).alias("full_event_id"), F.max_by("state", full).alias("full_state"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of listings whose latest reading has each field, to four digits."""
    k = F.get_json_object("props", "$.k").cast("int")
    last = newest(observations(spark, sf_dir), ["offer_id"], F.desc("obs_at"), F.desc("event_id")).withColumn("k", k)
    gtin, mpn, brand = F.col("k") % 4 == 0, F.col("k") % 3 == 0, F.col("k") % 2 == 0
    out = last.agg(F.count("*").alias("listings"), F.count_if(gtin).alias("with_gtin"), F.count_if(~gtin & brand & mpn).alias("brand_and_part"), F.count_if(~gtin & brand & ~mpn).alias("brand_only"), F.count_if(F.coalesce(~gtin & ~brand, F.lit(True))).alias("nothing"))
    share = lambda n: F.coalesce(F.round(F.col(n).cast("decimal(18,0)") / F.col("listings"), 4), F.lit(0)).cast("decimal(10,4)")
    return out.withColumn("gtin_share", share("with_gtin")).withColumn("deterministic", F.coalesce(F.round((F.col("with_gtin") + F.col("brand_and_part")).cast("decimal(18,0)") / F.col("listings"), 4), F.lit(0)).cast("decimal(10,4)"))


def samples_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four listings of each state, newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy("state").orderBy(F.desc("obs_at"), F.desc("event_id"))
    return observations(spark, sf_dir).withColumn("nth", F.row_number().over(w)).where("nth <= 4").select("state", "nth", "event_id", "offer_id")


def attributes_of_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw payload's fields, as a sorted list of key=value."""
    fields = F.from_json("props", "map<string,string>")
    pairs = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return observations(spark, sf_dir).select("event_id", F.array_join(pairs, ";").alias("attributes"))


_LAST = f"{OBSERVATIONS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY obs_at DESC, event_id DESC) AS nth FROM observations) WHERE nth = 1)"

QUERIES = {f.__name__: f for f in (price_changes, state_changes, price_series_band, price_series_shops, price_history, availability_history, latest_observation, latest_price, coverage, samples_per_source, attributes_of_payload)}
ORACLES = {
    "price_changes": _changed("cents"),
    "state_changes": _changed("state"),
    "price_series_band": f"""WITH {_DAILY}, s AS (SELECT day, list_sort(list(cents)) AS v, count(*) AS listings FROM daily GROUP BY day), t AS (SELECT *, v[(listings + 1) // 2] + v[listings // 2 + 1] AS two FROM s)
SELECT day, v[1] AS low, CAST(CASE WHEN two % 2 = 1 THEN two // 2 + (two // 2) % 2 ELSE two // 2 END AS BIGINT) AS median, v[-1] AS high, listings FROM t""",
    "price_series_shops": f"WITH {_DAILY} SELECT day, offer_id % 10 AS shop_id, min(cents) AS low, count(*) AS listings FROM daily GROUP BY ALL",
    "price_history": f"SELECT * FROM ({_changed('cents')}) WHERE obs_at >= TIMESTAMP '2024-01-05' AND obs_at <= TIMESTAMP '2024-01-20' ORDER BY event_id DESC LIMIT 100",
    "availability_history": f"SELECT * FROM ({_changed('state')}) WHERE event_id < 8000 ORDER BY event_id DESC LIMIT 100",
    "latest_observation": f"WITH {_LAST} SELECT offer_id, event_id, obs_at, cents, state FROM last",
    "latest_price": f"""WITH {_LAST}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY obs_at DESC, event_id DESC) AS n FROM observations WHERE event_type <> 'click') WHERE n = 1)
SELECT l.offer_id, l.cents, f.event_id AS full_event_id, f.state AS full_state FROM last l LEFT JOIN f USING (offer_id)""",
    "coverage": f"""WITH {_LAST}, k AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM last), c AS (SELECT count(*) AS listings, count(*) FILTER (WHERE k % 4 = 0) AS with_gtin,
count(*) FILTER (WHERE k % 4 <> 0 AND k % 2 = 0 AND k % 3 = 0) AS brand_and_part, count(*) FILTER (WHERE k % 4 <> 0 AND k % 2 = 0 AND k % 3 <> 0) AS brand_only, count(*) FILTER (WHERE coalesce(k % 4 <> 0 AND k % 2 <> 0, true)) AS nothing FROM k)
SELECT *, CAST(round(with_gtin / listings, 4) AS DECIMAL(10,4)) AS gtin_share, CAST(round((with_gtin + brand_and_part) / listings, 4) AS DECIMAL(10,4)) AS deterministic FROM c""",
    "samples_per_source": f"WITH {OBSERVATIONS} SELECT state, CAST(nth AS INTEGER) AS nth, event_id, offer_id FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY obs_at DESC, event_id DESC) AS nth FROM observations) WHERE nth <= 4",
    "attributes_of_payload": "SELECT event_id, list_aggregate(list_sort(list_transform(json_keys(props), lambda k: k || '=' || json_extract_string(props, '$.' || k))), 'string_agg', ';') AS attributes FROM events",
}
