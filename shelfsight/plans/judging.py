"""Verdicts of an outside judge, its use and its calibration; labels of documents stand in for verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import newest
from ..sources.tables import OBSERVATIONS, observations, read

ACCEPT, DOUBT, BUCKETS = 85, 10, 10


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score in hundredths, said by the judge, and what was right."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.pmod(F.col("doc_id") * 37 + F.col("n_chars"), F.lit(101)).alias("score"))
    return d.join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "lang", "score", "quality", "toxic")


_VERDICTS = "verdicts AS (SELECT doc_id, source, lang, (doc_id * 37 + n_chars) % 101 AS score, quality, toxic FROM documents JOIN labels USING (doc_id))"


def verdict_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir)
    outcome = F.when(F.col("toxic") == 1, "doubt").when(F.col("quality") == 0, "no_match").when(F.col("score") >= ACCEPT, "accepted").when(F.col("score") <= DOUBT, "doubt").otherwise("below_threshold")
    return v.select("doc_id", outcome.alias("outcome"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right answers by tenth of the score; every tenth is there, empty ones too."""
    bucket = F.least(F.floor(F.col("score") * BUCKETS / 100), F.lit(BUCKETS - 1)).cast("long").alias("bucket")
    found = _verdicts(spark, sf_dir).groupBy(bucket).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("right"))
    every = spark.range(BUCKETS).withColumnRenamed("id", "bucket")
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("right", F.lit(0)).alias("right"))


def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers found in the store, by day and kind: two counts, united and counted once more."""
    o = observations(spark, sf_dir)
    day = F.to_date("obs_at").alias("day")
    asked = o.where("event_type <> 'click'").groupBy(day, F.col("event_type").alias("kind")).agg(F.count("*").alias("asked"), F.coalesce(F.sum("cents"), F.lit(0)).alias("tokens"), F.lit(0).cast("long").alias("hits"))
    hits = o.where("event_type = 'click'").groupBy(day, F.lit("view").alias("kind")).agg(F.lit(0).cast("long").alias("asked"), F.lit(0).cast("long").alias("tokens"), F.count("*").alias("hits"))
    return asked.unionByName(hits).groupBy("day", "kind").agg(*[F.sum(c).alias(c) for c in ("asked", "tokens", "hits")])


def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day, the last seven and all."""
    o = observations(spark, sf_dir)
    since = lambda day: F.count_if(F.col("obs_at") >= F.lit(day).cast("timestamp"))
    return o.groupBy("event_type").agg(since("2024-01-29").alias("day"), since("2024-01-23").alias("week"), F.count("*").alias("all"))


def pending_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different question that has no verdict yet, by the hash of its text, with how often it is asked."""
    d = read(spark, sf_dir, "documents").withColumn("question", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = d.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("question").distinct()
    return d.join(known, "question", "left_anti").groupBy("question").agg(F.count("*").alias("asked"), F.min("doc_id").alias("first"))


def match_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose newest verdict among those of one source and language is a low one."""
    v = _verdicts(spark, sf_dir)
    last = newest(v, ["source", "lang"], F.desc("doc_id")).where(F.col("score") <= 60).select("source", "lang", F.col("score").alias("newest"))
    return v.join(last, ["source", "lang"]).select("doc_id", "newest")


def audit_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the newest entries before an id."""
    return observations(spark, sf_dir).where("event_id < 9000 and event_type in ('signup', 'purchase')").orderBy(F.desc("event_id")).limit(50).select("event_id", "event_type", "offer_id")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with the turn before it; turns without one are left out."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = read(spark, sf_dir, "conversations").withColumn("before", F.lag("turn").over(w)).withColumn("asked_by", F.lag("role").over(w))
    return rows.where("role = 'assistant' and before is not null").select("conv_id", "turn", "before", "asked_by", F.length("text").alias("n_chars"))


def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations whose payload the listing has had before are the same content: the first of each hash, and its last sight."""
    from ..functions.unicode import payload_hash

    o = observations(spark, sf_dir).withColumn("content", payload_hash(F.col("props")))
    return o.groupBy("offer_id", "content").agg(F.min(F.struct("obs_at", "event_id")).alias("f"), F.max("obs_at").alias("last_seen"), F.count("*").alias("seen")).select("offer_id", "content", F.col("f.event_id").alias("event_id"), "last_seen", "seen")


def brand_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup forms of shop names and their slugs."""
    from ..functions.unicode import normalize_brand, slugify

    s = read(spark, sf_dir, "supplier")
    name = F.concat("s_name", F.lit("  ®, Ltd."))
    return s.select("s_suppkey", normalize_brand(name).alias("brand"), F.concat_ws("-", slugify(F.col("s_name")), F.col("s_suppkey").cast("string")).alias("slug"))


QUERIES = {f.__name__: f for f in (verdict_outcomes, calibration, usage_by_day, usage_windows, pending_questions, match_doubts, audit_feed, conversation_turns, payload_hashes, brand_forms)}
ORACLES = {
    "verdict_outcomes": f"WITH {_VERDICTS} SELECT doc_id, CASE WHEN toxic = 1 THEN 'doubt' WHEN quality = 0 THEN 'no_match' WHEN score >= {ACCEPT} THEN 'accepted' WHEN score <= {DOUBT} THEN 'doubt' ELSE 'below_threshold' END AS outcome FROM verdicts",
    "calibration": f"""WITH {_VERDICTS}, c AS (SELECT least(score * {BUCKETS} // 100, {BUCKETS - 1}) AS bucket, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS ok FROM verdicts GROUP BY ALL)
SELECT CAST(b AS BIGINT) AS bucket, coalesce(n, 0) AS n, coalesce(ok, 0) AS "right" FROM range({BUCKETS}) r(b) LEFT JOIN c ON c.bucket = r.b""",
    "usage_by_day": f"""WITH {OBSERVATIONS}, u AS (SELECT CAST(obs_at AS DATE) AS day, CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS kind, event_type, cents FROM observations)
SELECT day, kind, count(*) FILTER (WHERE event_type <> 'click') AS asked, CAST(coalesce(sum(cents) FILTER (WHERE event_type <> 'click'), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_type = 'click') AS hits FROM u GROUP BY day, kind""",
    "usage_windows": """SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29') AS day, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23') AS week, count(*) AS "all" FROM events GROUP BY event_type""",
    "pending_questions": "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS question FROM documents) SELECT question, count(*) AS asked, min(doc_id) AS first FROM d WHERE question NOT IN (SELECT question FROM d WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY question",
    "match_doubts": f"""WITH {_VERDICTS}, l AS (SELECT * FROM (SELECT source, lang, score, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS n FROM verdicts) WHERE n = 1 AND score <= 60)
SELECT v.doc_id, l.score AS newest FROM verdicts v JOIN l ON v.source = l.source AND v.lang = l.lang""",
    "audit_feed": "SELECT event_id, event_type, user_id AS offer_id FROM events WHERE event_id < 9000 AND event_type IN ('signup', 'purchase') ORDER BY event_id DESC LIMIT 50",
    "conversation_turns": """WITH m AS (SELECT *, lag(turn) OVER w AS before, lag(role) OVER w AS asked_by FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, before, asked_by, CAST(len(text) AS INTEGER) AS n_chars FROM m WHERE role = 'assistant' AND before IS NOT NULL""",
    "brand_forms": "SELECT s_suppkey, lower(s_name) AS brand, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') || '-' || s_suppkey AS slug FROM supplier",
    # payloads of one field: keys are in order, so only white space goes
    "payload_hashes": f"WITH {OBSERVATIONS} SELECT offer_id, sha256(regexp_replace(props, '\\s', '', 'g')) AS content, arg_min(event_id, (obs_at, event_id)) AS event_id, max(obs_at) AS last_seen, count(*) AS seen FROM observations GROUP BY ALL",
}
