"""Passes of sources: health, contracts, what is still listed, and the collection funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import newest
from ..sources.tables import OFFERS, RUNS, SHOPS, VARIANTS, offers, runs, shops, variants

MIN_ITEMS, MAX_DROP = 5000, 50
NOW = "1999-01-01"


def _status(run: DataFrame, key: str, status: str | None = None) -> DataFrame:
    """Newest run of each key, of one status if one is given: one max_by over a struct, no sort."""
    rows = run.where(F.col("status") == status) if status else run
    order = F.struct("started_at", "run_id")
    return rows.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in ("run_id", "status", "started_at", "items_seen")])


def shop_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing if the newest run of any source is broken, never without an ok one, else ok."""
    last = newest(runs(spark, sf_dir), ["shop_id", "source"], F.desc("started_at"), F.desc("run_id"))
    bad, good = F.bool_or(F.col("status") != "ok"), F.bool_or(F.col("status") == "ok")
    return last.groupBy("shop_id").agg(F.count("*").alias("sources"), F.when(bad, "failing").when(~good, "never").otherwise("ok").alias("health"))


def source_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's newest run and its newest ok one."""
    r = runs(spark, sf_dir)
    last = _status(r, "source").select("source", F.col("run_id").alias("last_run"), F.col("status").alias("last_status"), F.col("items_seen").alias("last_seen"))
    good = _status(r, "source", "ok").select("source", F.col("run_id").alias("last_ok_run"), F.col("started_at").alias("last_ok_at"))
    return last.join(good, "source", "left")


def run_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against the last ok run of its source and shop: too few items, or too large a drop."""
    w = Window.partitionBy("source", "shop_id").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(F.col("status") == "ok", F.col("items_seen")), ignorenulls=True).over(w)
    r = runs(spark, sf_dir).withColumn("base", base)
    drop = F.greatest(F.lit(0), (F.col("base") - F.col("items_seen")) * 100)
    few, fell = F.col("items_seen") < MIN_ITEMS, F.coalesce((F.col("base") > 0) & (drop > MAX_DROP * F.col("base")), F.lit(False))
    return r.select("run_id", "base", few.alias("below_min_items"), fell.alias("dropped"), F.when(F.coalesce(F.col("base") <= 0, F.lit(True)), "no accepted run to compare against").alias("note"), (~few & ~fell).alias("accepted"))


def runs_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred longest runs; a run without an end lasts until now."""
    end = F.coalesce(F.when(F.col("status") != "failed", F.col("started_at") + F.make_dt_interval(F.lit(0), F.col("run_id") % 24)), F.lit(NOW).cast("timestamp"))
    seconds = F.unix_timestamp(end) - F.unix_timestamp("started_at")
    return runs(spark, sf_dir).select("run_id", "source", "status", seconds.alias("seconds")).orderBy(F.desc("seconds"), F.desc("run_id")).limit(100)


def runs_last_started(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return r.groupBy("source", "shop_id").agg(F.max("started_at").alias("last_started"), F.count_if(F.col("status") == "ok").alias("ok_runs"), F.countDistinct("status").alias("statuses"))


def listed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that no later ok run of their channel has missed: a maximum and an equi join instead of an anti join on times."""
    last = runs(spark, sf_dir).where("status = 'ok'").groupBy("shop_id").agg(F.max("started_at").alias("newest"))
    rows = offers(spark, sf_dir).withColumn("channel", F.col("shop_id") % 20)
    return rows.join(last.withColumnRenamed("shop_id", "channel"), "channel", "left").where(F.col("newest").isNull() | ~(F.col("newest") > F.col("seen_at"))).select("offer_id", "seen_at")


def funnel_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("started_at", "run_id")
    return runs(spark, sf_dir).groupBy("shop_id", "source").agg(F.max_by("status", order).alias("last_status"), F.max_by("run_id", order).alias("last_run"), F.max_by("items_seen", order).alias("items_seen"))


def funnel_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each listing: listed, read, placed, and the axes that it lacks."""
    o = offers(spark, sf_dir)
    last = newest(o, ["variant_id", "shop_id"], F.desc("seen_at"), F.desc("offer_id"))
    v = variants(spark, sf_dir)
    rows = last.join(v.select("variant_id", "brand", "model", "size"), "variant_id", "left")
    missing = F.concat_ws(",", F.when(F.col("size") % 5 == 0, "size"), F.when(F.col("model").endswith("COPPER"), "material"))
    placed = F.col("brand").isNotNull() & (missing == "")
    return rows.select("offer_id", (F.col("availability") == "in_stock").alias("listed"), F.col("brand").isNotNull().alias("read"), placed.alias("placed"), missing.alias("missing_axes"))


def funnel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = funnel_listings(spark, sf_dir)
    listed = F.col("listed")
    return rows.agg(F.count("*").alias("collected"), F.count_if(listed).alias("listed"), F.count_if(~listed).alias("delisted"), F.count_if(listed & F.col("read")).alias("read"), F.count_if(listed & F.col("placed")).alias("placed"), F.count_if(listed & (F.col("missing_axes") != "")).alias("queued"))


def funnel_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants and families that have a listing in stock."""
    seen = offers(spark, sf_dir).where("availability = 'in_stock'").select("variant_id").distinct()
    return variants(spark, sf_dir).join(seen, "variant_id", "left_semi").agg(F.count("*").alias("variants"), F.countDistinct("brand", "model").alias("families"))


def run_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each month's observations brought: listings seen, first seen that month, and changed in price."""
    w = Window.partitionBy("variant_id", "shop_id").orderBy("seen_at", "offer_id")
    o = offers(spark, sf_dir).withColumn("nth", F.row_number().over(w)).withColumn("was", F.lag("price").over(w))
    new = F.col("nth") == 1
    return o.groupBy(F.date_trunc("month", "seen_at").cast("date").alias("month")).agg(F.count("*").alias("seen"), F.count_if(new).alias("new"), F.count_if(~new & (F.col("was") != F.col("price"))).alias("changed"))


def markets_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s, v = offers(spark, sf_dir), shops(spark, sf_dir), variants(spark, sf_dir)
    rows = o.join(s, "shop_id").join(v.select("variant_id", "brand", "model"), "variant_id")
    on_sale = F.col("availability") == "in_stock"
    sold = rows.groupBy("market_id").agg(F.count_if(on_sale).alias("on_sale"), F.countDistinct(F.when(on_sale, F.struct("brand", "model"))).alias("families"))
    return s.groupBy("market_id").agg(F.count("*").alias("shops")).join(sold, "market_id", "left").select("market_id", "shops", F.coalesce("on_sale", F.lit(0)).alias("on_sale"), F.coalesce("families", F.lit(0)).alias("families"))


def sellers_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = offers(spark, sf_dir).groupBy("shop_id").agg(F.count_if(F.col("availability") == "in_stock").alias("on_sale"), F.countDistinct("variant_id").alias("variants"))
    return shops(spark, sf_dir).join(counts, "shop_id", "left").select("shop_id", "shop", F.coalesce("on_sale", F.lit(0)).alias("on_sale"), F.coalesce("variants", F.lit(0)).alias("variants"))


_FUNNEL = f"""{OFFERS}, {VARIANTS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant_id, shop_id ORDER BY seen_at DESC, offer_id DESC) AS n FROM offers) WHERE n = 1),
funnel AS (SELECT offer_id, availability = 'in_stock' AS listed, brand IS NOT NULL AS read, brand IS NOT NULL AND concat_ws(',', CASE WHEN size % 5 = 0 THEN 'size' END, CASE WHEN model LIKE '%COPPER' THEN 'material' END) = '' AS placed,
 concat_ws(',', CASE WHEN size % 5 = 0 THEN 'size' END, CASE WHEN model LIKE '%COPPER' THEN 'material' END) AS missing_axes FROM last LEFT JOIN variants USING (variant_id))"""

QUERIES = {f.__name__: f for f in (shop_health, source_last_run, run_contract, runs_by_duration, runs_last_started, listed_offers, funnel_channels, funnel_listings, funnel_summary, funnel_catalogue, run_flow, markets_list, sellers_list)}
ORACLES = {
    "shop_health": f"""WITH {RUNS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shop_id, source ORDER BY started_at DESC, run_id DESC) AS n FROM runs) WHERE n = 1)
SELECT shop_id, count(*) AS sources, CASE WHEN bool_or(status <> 'ok') THEN 'failing' WHEN NOT bool_or(status = 'ok') THEN 'never' ELSE 'ok' END AS health FROM l GROUP BY shop_id""",
    "source_last_run": f"""WITH {RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS n FROM runs),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS n FROM runs WHERE status = 'ok')
SELECT l.source, l.run_id AS last_run, l.status AS last_status, l.items_seen AS last_seen, g.run_id AS last_ok_run, g.started_at AS last_ok_at FROM l LEFT JOIN g ON l.source = g.source AND g.n = 1 WHERE l.n = 1""",
    "run_contract": f"""WITH {RUNS}, b AS (SELECT *, last_value(CASE WHEN status = 'ok' THEN items_seen END IGNORE NULLS) OVER (PARTITION BY source, shop_id ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM runs),
c AS (SELECT run_id, base, items_seen < {MIN_ITEMS} AS below_min_items, coalesce(base > 0 AND greatest(0, (base - items_seen) * 100) > {MAX_DROP} * base, false) AS dropped FROM b)
SELECT *, CASE WHEN coalesce(base <= 0, true) THEN 'no accepted run to compare against' END AS note, NOT below_min_items AND NOT dropped AS accepted FROM c""",
    "runs_by_duration": f"""WITH {RUNS} SELECT run_id, source, status, CAST(epoch(coalesce(CASE WHEN status <> 'failed' THEN started_at + to_hours(CAST(run_id % 24 AS INTEGER)) END, TIMESTAMP '{NOW}')) - epoch(started_at) AS BIGINT) AS seconds FROM runs ORDER BY seconds DESC, run_id DESC LIMIT 100""",
    "runs_last_started": f"WITH {RUNS} SELECT source, shop_id, max(started_at) AS last_started, count(*) FILTER (WHERE status = 'ok') AS ok_runs, count(DISTINCT status) AS statuses FROM runs GROUP BY ALL",
    "listed_offers": f"WITH {OFFERS}, {RUNS} SELECT offer_id, seen_at FROM offers o WHERE NOT EXISTS (SELECT 1 FROM (SELECT shop_id, max(started_at) AS m FROM runs WHERE status = 'ok' GROUP BY shop_id) r WHERE r.shop_id = o.shop_id % 20 AND r.m > o.seen_at)",
    "funnel_channels": f"WITH {RUNS} SELECT shop_id, source, status AS last_status, run_id AS last_run, items_seen FROM (SELECT *, row_number() OVER (PARTITION BY shop_id, source ORDER BY started_at DESC, run_id DESC) AS n FROM runs) WHERE n = 1",
    "funnel_listings": f"WITH {_FUNNEL} SELECT * FROM funnel",
    "funnel_summary": f"WITH {_FUNNEL} SELECT count(*) AS collected, count(*) FILTER (WHERE listed) AS listed, count(*) FILTER (WHERE NOT listed) AS delisted, count(*) FILTER (WHERE listed AND read) AS read, count(*) FILTER (WHERE listed AND placed) AS placed, count(*) FILTER (WHERE listed AND missing_axes <> '') AS queued FROM funnel",
    "funnel_catalogue": f"WITH {OFFERS}, {VARIANTS} SELECT count(*) AS variants, count(DISTINCT (brand, model)) AS families FROM variants WHERE variant_id IN (SELECT variant_id FROM offers WHERE availability = 'in_stock')",
    "run_flow": f"""WITH {OFFERS}, m AS (SELECT *, row_number() OVER w AS nth, lag(price) OVER w AS was FROM offers WINDOW w AS (PARTITION BY variant_id, shop_id ORDER BY seen_at, offer_id))
SELECT CAST(date_trunc('month', seen_at) AS DATE) AS month, count(*) AS seen, count(*) FILTER (WHERE nth = 1) AS new, count(*) FILTER (WHERE nth > 1 AND was <> price) AS changed FROM m GROUP BY ALL""",
    "markets_list": f"""WITH {OFFERS}, {SHOPS}, {VARIANTS}, s AS (SELECT market_id, count(*) FILTER (WHERE availability = 'in_stock') AS on_sale, count(DISTINCT brand || '|' || model) FILTER (WHERE availability = 'in_stock') AS families
FROM offers JOIN shops USING (shop_id) JOIN variants USING (variant_id) GROUP BY market_id)
SELECT market_id, count(*) AS shops, coalesce(any_value(on_sale), 0) AS on_sale, coalesce(any_value(families), 0) AS families FROM shops LEFT JOIN s USING (market_id) GROUP BY market_id""",
    "sellers_list": f"""WITH {OFFERS}, {SHOPS}, c AS (SELECT shop_id, count(*) FILTER (WHERE availability = 'in_stock') AS on_sale, count(DISTINCT variant_id) AS variants FROM offers GROUP BY shop_id)
SELECT shop_id, shop, coalesce(on_sale, 0) AS on_sale, coalesce(variants, 0) AS variants FROM shops LEFT JOIN c USING (shop_id)""",
}
