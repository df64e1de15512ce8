"""The match ladder over the tables, its queue, what a match teaches, and promotion.

Facts stand in for what shops say: every signal is missing, wrong, shared or learned on some
listings, so that every rung, state and reason occurs. They are written once, in SQL that
both engines read; the rules are not. A listing is a line of an order, whatever its repeats.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.unicode import LEGAL_FORMS
from ..operators.matching import CONFIDENCE, agreement, axes, brand_lookup, ladder, pending, unpublished_axes
from ..operators.rewrite import merged, upserted
from ..operators.saved import saved, saved_once, to_join
from ..sources.tables import read

AXES = ["size", "colour"]

# one maker in fifty entries writes itself and its models in Cyrillic
_MAKER = "CASE WHEN p_partkey % 50 = 7 THEN 'Волна' ELSE p_brand END"
_CALLED = "CASE WHEN p_partkey % 50 = 7 THEN 'Модель ' || p_name ELSE p_name END"
ENTRY_FACTS = f"""SELECT p_partkey AS variant_id, {_MAKER} AS brand, p_type AS category, CASE WHEN p_partkey % 40 = 0 THEN {_MAKER} || ' ' || p_name ELSE {_CALLED} END AS model,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size % 4 AS STRING) END AS size, CASE WHEN p_partkey % 5 <> 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'grey' END END AS colour,
  lpad(CAST(p_partkey % 1500 AS STRING), 14, '0') AS gtin, p_partkey % 6 = 0 AS learned, 'P-' || CAST(p_partkey % 300 AS STRING) AS mpn FROM part"""


def _listing_facts(more: str = "", of_lines: str = "") -> str:
    return f"""SELECT l_orderkey * 10 + l_linenumber AS offer_id, l_suppkey AS seller_id, l_suppkey % 20 AS channel, p_type AS category, l_shipdate AS seen_at, l_returnflag = 'N' AS is_new, p_partkey AS true_id,
  CASE WHEN n % 31 = 0 THEN '99999999999999' WHEN n % 5 = 0 THEN lpad(CAST(p_partkey % 1500 AS STRING), 14, '0') END AS gtin,
  CASE WHEN n % 14 = 0 THEN '' WHEN n % 7 = 0 THEN NULL WHEN n % 11 = 0 THEN 'Twin' WHEN n % 13 = 0 THEN 'Nobody' WHEN n % 97 = 0 THEN '--' WHEN n % 17 = 0 THEN maker || ' SIA' WHEN n % 19 = 0 THEN '«' || maker || '®» Ltd.' ELSE ' ' || upper(maker) END AS brand_raw,
  CASE n % 4 WHEN 0 THEN maker || ' ' || called WHEN 1 THEN called || ' (' || maker || ')' WHEN 2 THEN called ELSE called || ' Brand#1 ' || maker END AS title,
  CASE WHEN n % 6 = 0 THEN 'p' || CAST(p_partkey % 300 AS STRING) END AS mpn,
  CASE WHEN n % 9 = 0 THEN NULL WHEN n % 8 = 3 THEN maker || CASE n % 3 WHEN 0 THEN ', ' ELSE ' ' END || called ELSE called END AS model,
  CASE WHEN n % 4 <> 0 THEN CAST((p_size + CASE WHEN n % 17 = 0 THEN 1 ELSE 0 END) % 4 AS STRING) END AS size,
  CASE WHEN n % 3 <> 1 AND (l_suppkey % 5 <> 0 OR n % 29 = 0) THEN CASE p_partkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'grey' END END AS colour{more}
  FROM (SELECT *, l_orderkey * 7 + l_linenumber AS n, {_MAKER} AS maker, {_CALLED} AS called FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_shipdate) AS l_shipdate, max(l_returnflag) AS l_returnflag{of_lines}
    FROM lineitem GROUP BY l_orderkey, l_linenumber) x JOIN part ON l_partkey = p_partkey)"""


LISTING_FACTS = _listing_facts()
#: With what the list of listings shows of its lines, so that they aren't gathered twice.
_TOLD_FACTS = _listing_facts(", price, line, first_seen_at", ", CAST(max(l_extendedprice) AS DECIMAL(12,2)) AS price, max(l_linestatus) AS line, min(l_shipdate) AS first_seen_at")
ALIAS_FACTS = "SELECT DISTINCT p_brand AS alias, p_brand AS brand FROM part UNION ALL SELECT 'twin', 'Brand#1' UNION ALL SELECT 'twin', 'Brand#2' UNION ALL SELECT 'ВОЛНА', 'Волна'"
CATEGORY_FACTS = "SELECT DISTINCT p_type AS category, p_type NOT IN ('PROMO', 'STANDARD') AS wants_colour, p_type <> 'PROMO' AS wants_size, p_type IN ('ECONOMY', 'MEDIUM') AS strict FROM part"
VERDICT_FACTS = "SELECT offer_id, CASE WHEN offer_id % 3 = 0 THEN 'Brand#2' END AS choice FROM listing_facts WHERE brand_raw = 'Twin' AND offer_id % 2 = 0"


def _facts(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    named = re.compile(r"\b(FROM|JOIN) (part|lineitem)\b")
    tables = {m[2]: read(spark, sf_dir, m[2]) for m in named.finditer(sql)}
    if re.search(r"\bJOIN part\b", sql):  # it grows with the lines: never sent to all tasks, whatever its files take
        tables["part"] = tables["part"].hint("merge")
    plain = sql.replace("{", "{{").replace("}", "}}")  # braces are the text's own
    return spark.sql(named.sub(r"\1 {\2}", plain), **tables)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, ENTRY_FACTS).withColumn("axes", axes(size=F.col("size"), colour=F.col("colour")))


def said(spark: SparkSession, sf_dir: str, facts: str = LISTING_FACTS) -> DataFrame:
    return _facts(spark, sf_dir, facts).withColumn("axes", axes(size=F.col("size"), colour=F.col("colour")))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    wants = F.array_compact(F.array(F.when(F.col("wants_size"), F.lit("size")), F.when(F.col("wants_colour"), F.lit("colour"))))
    return _facts(spark, sf_dir, CATEGORY_FACTS).select("category", wants.alias("required"), "strict")


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, saved(said(spark, sf_dir)))  # the lookup reads it several times, as it would a stored table


def _looked_up(spark: SparkSession, sf_dir: str, listings: DataFrame) -> DataFrame:
    verdicts = listings.where("brand_raw = 'Twin' and offer_id % 2 = 0").select("offer_id", F.when(F.col("offer_id") % 3 == 0, "Brand#2").alias("choice"))
    return brand_lookup(listings, _facts(spark, sf_dir, ALIAS_FACTS), verdicts)


def brand_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing's maker and how it was found."""
    return _lookup(spark, sf_dir).select("offer_id", "brand", "brand_state")


def unpublished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes that a channel states on under a tenth of its listings, if these are fifty or more."""
    return unpublished_axes(said(spark, sf_dir), AXES)


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing's outcome, with what it said and price, line and first_seen_at of its lines."""
    known = entries(spark, sf_dir)
    told = saved(said(spark, sf_dir, _TOLD_FACTS))
    listings = _looked_up(spark, sf_dir, told)
    silent = saved(unpublished_axes(told, AXES).groupBy("channel").agg(F.array_sort(F.collect_set("axis")).alias("excused")))
    listings = listings.join(silent, "channel", "left").withColumn("excused", F.coalesce("excused", F.array().cast("array<string>")))
    listings = saved(listings.drop("size", "colour"))  # questions are made of them, and answered
    return ladder(listings, known, known.select("gtin", "variant_id", "learned"), known.select("brand", "mpn", "variant_id"), categories(spark, sf_dir), AXES)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes as a table, decided once: what reads them doesn't climb the ladder again."""
    return saved_once(spark, ("decided", sf_dir), lambda: _ladder(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a listing was placed on, written: where they are few, listings meet them without a shuffle."""
    placed = _decided(spark, sf_dir).select(F.col("found").alias("variant_id")).where("variant_id is not null").distinct()
    return to_join(saved(entries(spark, sf_dir).hint("merge").join(placed, "variant_id", "left_semi").select("variant_id", "brand", "model", "axes")))


def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing's match, or the reason for which it waits."""
    confidence = F.create_map(*[x for m, c in CONFIDENCE.items() for x in (F.lit(m), F.lit(c))])
    return _ladder(spark, sf_dir).select("offer_id", "method", "found", "complete", "reason", confidence[F.col("method")].cast("decimal(4,3)").alias("confidence"))


def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by outcome (the method of those placed, the reason of those that wait), and the share of all that are placed."""
    rows = _decided(spark, sf_dir).groupBy(F.coalesce("method", "reason").alias("outcome"), F.col("method").isNotNull().alias("placed")).agg(F.count("*").alias("listings"))
    total = rows.agg(F.sum("listings").alias("every"), F.sum(F.when(F.col("placed"), F.col("listings"))).alias("matched"))
    return rows.crossJoin(F.broadcast(total)).select("outcome", "listings", F.round(F.coalesce("matched", F.lit(0)).cast("decimal(18,0)") / F.col("every"), 4).cast("decimal(10,4)").alias("matched_share"))


def queue_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many waiting listings name the same maker and model; one that doesn't counts itself."""
    rows = _decided(spark, sf_dir).where("reason is not null").select("offer_id", "brand", "model")
    same = rows.where("brand is not null and model is not null").groupBy("brand", "model").agg(F.count("*").alias("n"))
    return rows.join(same, ["brand", "model"], "left").select("offer_id", F.coalesce("n", F.lit(1)).alias("siblings"))


def axes_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each axis of a placed listing beside its entry's: same, different, or said by one side only."""
    placed = _decided(spark, sf_dir).where("method is not null").select("offer_id", F.col("found").alias("variant_id"), F.col("axes").alias("stated"))
    rows = placed.join(_found(spark, sf_dir).select("variant_id", F.col("axes").alias("held")), "variant_id").withColumn("axis", F.explode(F.array(*[F.lit(a) for a in AXES])))
    a, b = F.col("stated")[F.col("axis")], F.col("held")[F.col("axis")]
    return rows.where(a.isNotNull() | b.isNotNull()).select("offer_id", "axis", a.alias("stated"), b.alias("held"), (a == b).alias("agrees"))


# what matches write; each is a keyed rewrite of a table, and nothing is written where only the plan is wanted


def queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after a pass over new listings: waiting ones try once more, placed ones leave, others stay as they were."""
    now = _decided(spark, sf_dir).where("is_new").select("offer_id", "reason", "brand")
    held = said(spark, sf_dir).where("offer_id % 3 = 0").select("offer_id", (F.col("offer_id") % 4 + 1).alias("attempts"), F.lit("signals_unmatched").alias("reason"), F.lit(None).cast("string").alias("brand"))
    again = now.where("reason is not null").hint("merge").join(held.select("offer_id", F.col("attempts").alias("was")), "offer_id", "left").select("offer_id", (F.coalesce("was", F.lit(0)) + 1).alias("attempts"), "reason", "brand")
    return upserted(held.hint("merge").join(now.where("reason is null").select("offer_id"), "offer_id", "left_anti"), again, ["offer_id"]).select("offer_id", "attempts", "reason", "brand")


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of matches after a pass: one that another entry replaces is superseded, one that is found again stays, new ones are appended."""
    old = said(spark, sf_dir).where("offer_id % 7 = 1").select("offer_id", F.col("true_id").alias("variant_id"))
    new = _decided(spark, sf_dir).where("method is not null").select("offer_id", F.col("found").alias("next"), "method")
    was = old.hint("merge").join(new.select("offer_id", "next"), "offer_id", "left").select("offer_id", "variant_id", F.coalesce(F.col("next") == F.col("variant_id"), F.lit(True)).alias("active"), F.lit("earlier").alias("method"))
    added = new.hint("merge").join(old.select("offer_id", F.col("variant_id").alias("held")), "offer_id", "left").where("held is null or held <> next").select("offer_id", F.col("next").alias("variant_id"), F.lit(True).alias("active"), "method")
    return was.unionByName(added)


def pending_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thousand listings that the next pass tries."""
    rows = said(spark, sf_dir).select("offer_id", "is_new")
    tried = F.when(F.col("offer_id") % 12 != 0, F.timestamp_add("DAY", (F.col("offer_id") % 400).cast("int"), F.lit("2001-01-01").cast("timestamp")))
    queue = rows.where("offer_id % 30 <> 7").select("offer_id", tried.alias("last_attempt_at"))
    return pending(rows.select("offer_id", F.when(F.col("is_new"), "new").alias("condition")), rows.where("offer_id % 7 < 2").select("offer_id", (F.col("offer_id") % 7 == 1).alias("active")), queue, 1000)


def reconciled_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes that entries lack and their listings say: any that a barcode placed, and others whose compared axes agreed. Of several values the newest listing's counts; none replaces what is there."""
    placed = _decided(spark, sf_dir).where("method is not null").select("offer_id", "seen_at", "method", F.col("found").alias("variant_id"), F.col("axes").alias("stated"))
    rows = placed.hint("merge").join(entries(spark, sf_dir).select("variant_id", F.col("axes").alias("held")), "variant_id")
    none = F.array().cast("array<string>")
    a = agreement(F.col("stated"), F.col("held"), none, none)
    teaches = (F.col("method") == "gtin") | (a.checked & a.agreed)
    gaps = rows.where(teaches).select("variant_id", "seen_at", "offer_id", "held", F.explode("stated").alias("axis", "value")).where(~F.map_contains_key("held", F.col("axis")))
    return gaps.groupBy("variant_id", "axis").agg(F.max_by("value", F.struct("seen_at", "offer_id")).alias("value"), F.count("*").alias("listings"))


def learned_gtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes of listings that another rung placed with all axes compared (in a strict category none excused), where no entry holds them."""
    rows = _decided(spark, sf_dir).where("complete and method in ('brand_mpn', 'brand_model') and gtin is not null and (method = 'brand_mpn' or not strict or size(excused) = 0)")
    return rows.select(F.col("found").alias("variant_id"), "gtin").distinct().hint("merge").join(entries(spark, sf_dir).select("gtin").distinct(), "gtin", "left_anti").select("variant_id", "gtin")


def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of new listings that no signal placed: one entry for each different identity, or why there is none."""
    rows = _decided(spark, sf_dir).where("is_new and reason = 'signals_unmatched'").join(categories(spark, sf_dir).drop("strict"), "category", "left")
    name = F.coalesce("model", "title")
    whole = (F.size("required") > 0) & (F.size(F.array_except("required", F.map_keys("axes"))) == 0)
    refused = (
        F.when(F.col("channel") % 4 == 3, "source_not_trusted").when(F.col("gtin").isNull() & ~whole, "no_barcode").when(F.col("brand").isNull(), "brand_unresolved").when(name.isNull(), "no_model")
    )
    identity = F.concat_ws("|", "brand", "category", F.lower(name), F.array_join(F.array_sort(F.transform(F.map_entries("axes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"))
    first = Window.partitionBy("identity").orderBy("offer_id")
    rows = rows.withColumn("refused", refused).withColumn("identity", F.when(F.col("refused").isNull(), identity))
    made = rows.where("refused is null").withColumn("nth", F.row_number().over(first)).select("offer_id", F.when(F.col("nth") == 1, "created").otherwise("joined").alias("outcome"), "identity")
    return made.unionByName(rows.where("refused is not null").select("offer_id", F.col("refused").alias("outcome"), "identity"))


def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one maker's part number: the one with more listings survives, the other goes into it unless an axis that both hold differs; chains end at the last."""
    e = entries(spark, sf_dir)
    sold = said(spark, sf_dir).groupBy(F.col("true_id").alias("variant_id")).agg(F.count("*").alias("live"))
    rows = e.join(sold, "variant_id", "left").select("variant_id", "brand", "mpn", "axes", F.coalesce("live", F.lit(0)).alias("live"))
    best = rows.groupBy("brand", "mpn").agg(F.max_by(F.struct("variant_id", "axes"), F.struct("live", -F.col("variant_id"))).alias("keep"), F.count("*").alias("n")).where("n > 1")
    pairs = rows.join(best, ["brand", "mpn"]).where(F.col("variant_id") != F.col("keep.variant_id"))
    differ = F.filter(F.array_intersect(F.map_keys("axes"), F.map_keys("keep.axes")), lambda k: F.col("axes")[k] != F.col("keep.axes")[k])
    return pairs.select("variant_id", F.col("keep.variant_id").alias("into"), F.array_join(F.array_sort(differ), ",").alias("differ"), (F.size(differ) == 0).alias("merged"))


def merged_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by entry after the merge: those of entries that went into another are counted there."""
    pairs = merge_pairs(spark, sf_dir).where("merged").select(F.col("variant_id").alias("from"), "into")
    offers = said(spark, sf_dir).select("offer_id", F.col("true_id").alias("variant_id"))
    return merged(offers, pairs, "variant_id").groupBy("variant_id").agg(F.count("*").alias("listings"))


QUERIES = {f.__name__: f for f in (brand_resolve, match_ladder, queue_summary, queue_siblings, axes_compared, queue_upsert, pending_selection, linked, reconciled_axes, learned_gtins, promotion, merge_pairs, merged_offers)}
QUERIES["unpublished_axes"] = unpublished

_KEY = lambda x: f"nullif(regexp_replace(replace(lower({x}), '+', 'plus'), '[^0-9a-zЀ-ӿ]', '', 'g'), '')"
# the brand's form, spelled out for names of the facts, which hold no compatibility characters
_EDGE = " \t\n\xa0.,;:!-–—_/\\|\"''`«»"
_COMPANY = "".join(
    f" WHEN ends_with(t, '{form}') AND right(left(t, len(t) - {len(form)}), 1) IN (' ', ',', '.', '-') AND trim(left(t, len(t) - {len(form)}), '{_EDGE}') <> '' THEN trim(left(t, len(t) - {len(form)}), '{_EDGE}')" for form in LEGAL_FORMS
)
_REST = "substr(trim({name}), len(brand) + 1)"
_WITHOUT = lambda name: f"CASE WHEN starts_with(lower(trim({name})), lower(brand)) AND regexp_matches({_REST.format(name=name)}, '^([\\s,./|-]|$)') AND trim({_REST.format(name=name)}, ' ,./|-') <> '' THEN trim({_REST.format(name=name)}, ' ,./|-') ELSE trim({name}) END"
_BASE = f"""entry AS ({ENTRY_FACTS}), listing_facts AS ({LISTING_FACTS}), alias AS ({ALIAS_FACTS}), category AS ({CATEGORY_FACTS}), verdict AS ({VERDICT_FACTS}),
w AS (SELECT *, nullif(brand_raw, '') AS field, string_split(title, ' ') AS tw, string_split(model, ' ') AS mw FROM listing_facts),
raw AS (SELECT alias AS raw FROM alias UNION SELECT field FROM w UNION SELECT tw[1] || ' ' || tw[2] FROM w UNION SELECT mw[1] || ' ' || mw[2] FROM w UNION SELECT mw[1] FROM w UNION SELECT unnest(tw) FROM w UNION SELECT trim(unnest(tw), '(),.:;/') FROM w),
formed AS (SELECT raw, nullif(CASE{_COMPANY} ELSE trim(t, '{_EDGE}') END, '') AS form FROM (SELECT raw, lower(trim(regexp_replace(regexp_replace(raw, '[®™©]', '', 'g'), '[\\s\xa0]+', ' ', 'g'))) AS t FROM raw WHERE raw <> '')),
maker AS (SELECT form, count(DISTINCT brand) AS n, min(brand) AS b FROM alias JOIN formed ON raw = alias GROUP BY form),
one AS (SELECT raw AS alias, f.form, n, b FROM formed f LEFT JOIN maker m ON m.form = f.form),
edge AS (SELECT w.*, f.n AS f_n, f.b AS f_b, field IS NOT NULL AND f.form IS NULL AS unreadable, coalesce(t2.b, t1.b, m2.b, m1.b) AS edge FROM w LEFT JOIN one f ON f.alias = field
  LEFT JOIN one t2 ON t2.n = 1 AND t2.alias = tw[1] || ' ' || tw[2] LEFT JOIN one t1 ON t1.n = 1 AND t1.alias = tw[1]
  LEFT JOIN one m2 ON m2.n = 1 AND m2.alias = mw[1] || ' ' || mw[2] LEFT JOIN one m1 ON m1.n = 1 AND m1.alias = mw[1]),
anywhere AS (SELECT offer_id, min(b) AS b FROM (SELECT offer_id, trim(unnest(tw), '(),.:;/') AS word FROM w) JOIN one ON one.alias = word AND one.n = 1 GROUP BY offer_id HAVING count(DISTINCT b) = 1),
looked AS (SELECT e.*, CASE WHEN unreadable THEN 'unreadable' WHEN f_n = 1 THEN 'resolved'
  WHEN f_n > 1 THEN CASE WHEN v.choice IS NOT NULL THEN 'resolved_judge' WHEN v.offer_id IS NOT NULL THEN 'judged_none' ELSE 'ambiguous' END
  WHEN coalesce(edge, a.b) IS NOT NULL THEN 'resolved_title' WHEN field IS NULL THEN 'none_given' ELSE 'unknown' END AS brand_state,
  CASE WHEN unreadable THEN NULL WHEN f_n = 1 THEN f_b WHEN f_n > 1 THEN v.choice ELSE coalesce(edge, a.b) END AS brand
  FROM edge e LEFT JOIN anywhere a USING (offer_id) LEFT JOIN verdict v USING (offer_id)),
silent AS (SELECT channel, axis, count(*) AS n, count(*) FILTER (WHERE CASE axis WHEN 'size' THEN size ELSE colour END IS NOT NULL) AS stated FROM listing_facts, (VALUES ('size'), ('colour')) x(axis)
  GROUP BY ALL HAVING count(*) >= 50 AND count(*) FILTER (WHERE CASE axis WHEN 'size' THEN size ELSE colour END IS NOT NULL) * 10 < count(*)),
l AS (SELECT k.*, coalesce(c.strict, false) AS strict, EXISTS (SELECT 1 FROM silent s WHERE s.channel = k.channel AND axis = 'size') AS no_size, EXISTS (SELECT 1 FROM silent s WHERE s.channel = k.channel AND axis = 'colour') AS no_colour FROM looked k LEFT JOIN category c USING (category))"""


def _checked(pairs: str, excuse: bool) -> str:
    """Agreement over two axes, spelled out."""
    shared = "(CASE WHEN a.size IS NOT NULL AND e.size IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN a.colour IS NOT NULL AND e.colour IS NOT NULL THEN 1 ELSE 0 END)"
    need = lambda x: f"(CASE WHEN c.wants_size OR c.wants_colour THEN c.wants_{x} ELSE a.{x} IS NOT NULL END{f' AND NOT (a.strict AND a.no_{x})' if excuse else ''})"
    both = lambda x: f"(a.{x} IS NOT NULL AND e.{x} IS NOT NULL)"
    equal = "coalesce(a.size = e.size, true) AND coalesce(a.colour = e.colour, true)"
    named = "(a.size IS NOT NULL OR a.colour IS NOT NULL)"
    return f"""SELECT a.offer_id, e.variant_id, e.learned, e.size AS e_size, e.colour AS e_colour, a.strict, {named} AS checked, (NOT {named}) OR ({shared} > 0 AND {equal}) AS agreed, {named} AND {shared} = 0 AS unverifiable,
  {named} AND {shared} > 0 AND {equal} AND (NOT {need('size')} OR {both('size')}) AND (NOT {need('colour')} OR {both('colour')}) AS complete{", nth" if excuse else ""} FROM {pairs} LEFT JOIN category c ON c.category = e.category"""


_LADDER = f"""{_BASE},
g AS (SELECT offer_id, count(*) AS n, min(variant_id) AS v, bool_or(complete) AS c FROM ({_checked("l a JOIN entry e ON e.gtin = a.gtin", False)}) WHERE NOT (learned AND checked AND NOT agreed) GROUP BY offer_id),
p AS (SELECT offer_id, count(*) AS n, min(variant_id) AS v, bool_or(complete) AS c FROM ({_checked(f"l a JOIN entry e ON e.brand = a.brand AND {_KEY('e.mpn')} = {_KEY('a.mpn')}", False)}) WHERE agreed OR unverifiable GROUP BY offer_id),
form AS (SELECT l.*, 0 AS nth, {_KEY("coalesce(model, title)")} AS key FROM l UNION ALL SELECT l.*, 1, {_KEY(_WITHOUT("coalesce(model, title)"))} FROM l
  UNION ALL SELECT l.*, 2, {_KEY("brand || ' ' || coalesce(model, title)")} FROM l),
m0 AS ({_checked(f"form a JOIN entry e ON e.brand = a.brand AND {_KEY('e.model')} = a.key", True)}),
m1 AS (SELECT *, agreed AND (NOT strict OR complete) AS taken FROM m0 WHERE nth = (SELECT min(nth) FROM m0 i WHERE i.offer_id = m0.offer_id)),
m AS (SELECT offer_id, count(*) FILTER (WHERE taken) AS n, min(variant_id) FILTER (WHERE taken) AS v, count(*) FILTER (WHERE taken AND complete) AS c_n, min(variant_id) FILTER (WHERE taken AND complete) AS c, count(*) FILTER (WHERE unverifiable AND NOT strict) AS u,
  count(DISTINCT e_size) FILTER (WHERE taken) AS sizes, count(DISTINCT e_colour) FILTER (WHERE taken) AS colours FROM m1 GROUP BY offer_id),
j AS (SELECT l.*, g.n AS g_n, g.v AS g, g.c AS g_c, p.n AS p_n, p.v AS p, p.c AS p_c, m.n AS m_n, CASE WHEN m.n = 1 THEN m.v WHEN m.c_n = 1 THEN m.c END AS sole, m.c_n, m.c AS m_c, u, sizes, colours FROM l LEFT JOIN g USING (offer_id) LEFT JOIN p USING (offer_id) LEFT JOIN m USING (offer_id)),
k AS (SELECT *, CASE WHEN g_n = 1 THEN 'gtin' WHEN g_n > 1 THEN NULL WHEN p_n = 1 THEN 'brand_mpn' WHEN p_n > 1 THEN NULL WHEN sole IS NOT NULL THEN 'brand_model' END AS method FROM j),
decided AS (SELECT *, CASE method WHEN 'gtin' THEN g WHEN 'brand_mpn' THEN p WHEN 'brand_model' THEN sole END AS found,
  coalesce(CASE method WHEN 'gtin' THEN g_c WHEN 'brand_mpn' THEN p_c WHEN 'brand_model' THEN c_n = 1 AND sole = m_c END, false) AS complete,
  CASE WHEN method IS NOT NULL THEN NULL WHEN g_n > 1 OR p_n > 1 THEN 'ambiguous' WHEN m_n > 1 THEN CASE WHEN (sizes > 1 AND size IS NULL) OR (colours > 1 AND colour IS NULL) THEN 'axis_unpublished' ELSE 'ambiguous' END WHEN u > 0 THEN 'low_confidence'
   WHEN gtin IS NULL AND mpn IS NULL AND model IS NULL AND field IS NULL THEN 'no_signals' WHEN gtin IS NOT NULL THEN 'signals_unmatched' WHEN brand_state = 'ambiguous' THEN 'brand_ambiguous' WHEN brand_state IN ('unknown', 'unreadable', 'judged_none') THEN 'brand_unknown' ELSE 'signals_unmatched' END AS reason FROM k)"""
_PLACED = f"{_LADDER}, placed AS (SELECT d.offer_id, d.seen_at, d.method, d.found AS variant_id, d.size, d.colour, e.size AS e_size, e.colour AS e_colour FROM decided d JOIN entry e ON e.variant_id = d.found WHERE method IS NOT NULL)"
_PAIRS = f"""{_BASE}, r AS (SELECT e.*, (SELECT count(*) FROM listing_facts f WHERE f.true_id = e.variant_id) AS live FROM entry e),
b AS (SELECT *, first_value(variant_id) OVER x AS into_id, first_value(size) OVER x AS k_size, first_value(colour) OVER x AS k_colour FROM r WINDOW x AS (PARTITION BY brand, mpn ORDER BY live DESC, variant_id)),
pairs AS (SELECT variant_id, into_id, concat_ws(',', CASE WHEN colour <> k_colour THEN 'colour' END, CASE WHEN size <> k_size THEN 'size' END) AS differ FROM b WHERE variant_id <> into_id)"""
ORACLES = {
    "brand_resolve": f"WITH {_BASE} SELECT offer_id, brand, brand_state FROM looked",
    "unpublished_axes": f"WITH {_BASE} SELECT channel, axis, n, stated FROM silent",
    "match_ladder": f"WITH {_LADDER} SELECT offer_id, method, found, complete, reason, CAST(CASE method WHEN 'gtin' THEN 1 WHEN 'brand_mpn' THEN 0.95 WHEN 'brand_model' THEN 0.8 END AS DECIMAL(4,3)) AS confidence FROM decided",
    "queue_summary": f"WITH {_LADDER} SELECT coalesce(method, reason) AS outcome, count(*) AS listings, CAST(round((SELECT count(method) / count(*) FROM decided), 4) AS DECIMAL(10,4)) AS matched_share FROM decided GROUP BY ALL",
    "queue_siblings": f"WITH {_LADDER} SELECT offer_id, CASE WHEN brand IS NULL OR model IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY brand, model) END AS siblings FROM decided WHERE reason IS NOT NULL",
    "axes_compared": f"WITH {_PLACED} SELECT offer_id, axis, stated, held, stated = held AS agrees FROM (SELECT offer_id, 'size' AS axis, size AS stated, e_size AS held FROM placed UNION ALL SELECT offer_id, 'colour', colour, e_colour FROM placed) WHERE stated IS NOT NULL OR held IS NOT NULL",
    "queue_upsert": f"""WITH {_LADDER}, held AS (SELECT offer_id, offer_id % 4 + 1 AS attempts, 'signals_unmatched' AS reason, CAST(NULL AS VARCHAR) AS brand FROM listing_facts WHERE offer_id % 3 = 0)
SELECT offer_id, coalesce(h.attempts, 0) + 1 AS attempts, d.reason, d.brand FROM decided d LEFT JOIN held h USING (offer_id) WHERE d.is_new AND d.reason IS NOT NULL
UNION ALL SELECT * FROM held WHERE offer_id NOT IN (SELECT offer_id FROM decided WHERE is_new)""",
    "pending_selection": f"""SELECT offer_id, last_attempt_at FROM (SELECT offer_id, CASE WHEN offer_id % 30 <> 7 AND offer_id % 12 <> 0 THEN TIMESTAMP '2001-01-01' + to_days(CAST(offer_id % 400 AS INTEGER)) END AS last_attempt_at FROM ({LISTING_FACTS}) WHERE is_new AND offer_id % 7 <> 1)
ORDER BY last_attempt_at NULLS FIRST, offer_id LIMIT 1000""",
    "linked": f"""WITH {_LADDER}, old AS (SELECT offer_id, true_id AS variant_id FROM listing_facts WHERE offer_id % 7 = 1)
SELECT o.offer_id, o.variant_id, d.method IS NULL OR d.found = o.variant_id AS active, 'earlier' AS method FROM old o JOIN decided d USING (offer_id)
UNION ALL SELECT offer_id, found, true, method FROM decided d WHERE method IS NOT NULL AND NOT EXISTS (SELECT 1 FROM old o WHERE o.offer_id = d.offer_id AND o.variant_id = d.found)""",
    "reconciled_axes": f"""WITH {_PLACED}, ok AS (SELECT * FROM placed WHERE method = 'gtin' OR ((size IS NOT NULL AND e_size IS NOT NULL OR colour IS NOT NULL AND e_colour IS NOT NULL) AND coalesce(size = e_size, true) AND coalesce(colour = e_colour, true))),
x AS (SELECT variant_id, 'size' AS axis, size AS value, seen_at, offer_id FROM ok WHERE size IS NOT NULL AND e_size IS NULL UNION ALL SELECT variant_id, 'colour', colour, seen_at, offer_id FROM ok WHERE colour IS NOT NULL AND e_colour IS NULL)
SELECT variant_id, axis, arg_max(value, (seen_at, offer_id)) AS value, count(*) AS listings FROM x GROUP BY ALL""",
    "learned_gtins": f"WITH {_LADDER} SELECT DISTINCT found AS variant_id, gtin FROM decided WHERE complete AND gtin IS NOT NULL AND (method = 'brand_mpn' OR method = 'brand_model' AND NOT (strict AND (no_size OR no_colour))) AND gtin NOT IN (SELECT gtin FROM entry)",
    "promotion": f"""WITH {_LADDER}, q AS (SELECT d.*, CASE WHEN channel % 4 = 3 THEN 'source_not_trusted' WHEN gtin IS NULL AND NOT ((wants_size OR wants_colour) AND (NOT wants_size OR size IS NOT NULL) AND (NOT wants_colour OR colour IS NOT NULL)) THEN 'no_barcode'
  WHEN brand IS NULL THEN 'brand_unresolved' WHEN coalesce(model, title) IS NULL THEN 'no_model' END AS refused,
  concat_ws('|', brand, category, lower(coalesce(model, title)), concat_ws(';', 'colour=' || colour, 'size=' || size)) AS id FROM decided d JOIN category c USING (category) WHERE is_new AND reason = 'signals_unmatched')
SELECT offer_id, CASE WHEN refused IS NOT NULL THEN refused WHEN row_number() OVER (PARTITION BY refused, id ORDER BY offer_id) = 1 THEN 'created' ELSE 'joined' END AS outcome, CASE WHEN refused IS NULL THEN id END AS identity FROM q""",
    "merge_pairs": f'WITH {_PAIRS} SELECT variant_id, into_id AS "into", differ, differ = \'\' AS merged FROM pairs',
    "merged_offers": f"WITH {_PAIRS} SELECT coalesce(p.into_id, f.true_id) AS variant_id, count(*) AS listings FROM listing_facts f LEFT JOIN pairs p ON p.variant_id = f.true_id AND p.differ = '' GROUP BY ALL",
}
