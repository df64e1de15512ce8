"""The collection funnel day by day, kept once a day."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.daily import keep_days, standing
from ..operators.saved import saved, shared_dir
from ..sources.tables import OFFERS, offers, read

FIRST, LAST = dt.date(2001, 9, 1), dt.date(2001, 10, 31)
MIDDLE = dt.date(2001, 10, 10)
STAGES = ("collected", "listed", "placed", "queued")


def _days(spark: SparkSession, sf_dir: str, first: dt.date, last: dt.date) -> DataFrame:
    kinds = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_id"), F.col("p_type").alias("category"), F.col("p_size").alias("size"))
    rows = offers(spark, sf_dir).join(kinds, "variant_id")
    on = F.col("availability") == "in_stock"
    complete = F.col("size") % 5 != 0
    flags = {"collected": F.lit(True), "listed": on, "placed": on & complete, "queued": on & ~complete}
    return standing(rows, ["variant_id", "shop_id"], "seen_at", ["offer_id", "availability"], F.array(F.lit("all"), "category"), flags, first, last)


def funnel_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's funnel for everything and for each category: the first days are kept, then all days once more (those kept stay), then the last ones anew."""
    folder = f"{shared_dir(spark).rstrip('/')}/funnel-{uuid.uuid4().hex}"
    every = saved(_days(spark, sf_dir, FIRST, LAST))  # a day's numbers don't depend on later days
    keep_days(every.where(F.col("day") <= F.lit(MIDDLE)), folder)
    keep_days(every, folder)
    keep_days(every.where(F.col("day") > F.lit(MIDDLE)), folder, replace=True)
    return spark.read.schema(every.schema).parquet(folder).select("day", "scope", *STAGES)


QUERIES = {"funnel_history": funnel_history}
ORACLES = {
    "funnel_history": f"""WITH {OFFERS}, d AS (SELECT CAST(unnest(range(DATE '{FIRST}', DATE '{LAST + dt.timedelta(days=1)}', INTERVAL 1 DAY)) AS DATE) AS day), o AS (SELECT o.*, p_type AS category, p_size % 5 <> 0 AS complete FROM offers o JOIN part ON variant_id = p_partkey),
l AS (SELECT * FROM (SELECT day, category, complete, availability = 'in_stock' AS listed, row_number() OVER (PARTITION BY day, variant_id, shop_id ORDER BY seen_at DESC, offer_id DESC, availability DESC) AS n FROM d JOIN o ON CAST(seen_at AS DATE) <= day) WHERE n = 1)
SELECT day, coalesce(category, 'all') AS scope, count(*) AS collected, count(*) FILTER (WHERE listed) AS listed, count(*) FILTER (WHERE listed AND complete) AS placed, count(*) FILTER (WHERE listed AND NOT complete) AS queued FROM l GROUP BY GROUPING SETS ((day), (day, category))""",
}
