"""Catalogue lists, the category tree and repairs of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import gtin_canonical, gtin_valid, near_value, word_bag
from ..operators.asof import newest
from ..operators.saved import saved
from ..sources.tables import OFFERS, VARIANTS, offers, read, variants
from .matching import AXES, ENTRY_FACTS, LISTING_FACTS, entries, said


def products_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with counts and the least price; counts are made once and joined, not once a row."""
    o = offers(spark, sf_dir).where("availability = 'in_stock'")
    sold = o.groupBy("variant_id").agg(F.count("*").alias("n"), F.collect_set("shop_id").alias("s"), F.min("price").alias("p"))
    rows = variants(spark, sf_dir).join(sold, "variant_id", "left")
    out = rows.groupBy("brand", "model").agg(F.count("*").alias("variants"), F.coalesce(F.sum("n"), F.lit(0)).alias("offers"), F.min("p").alias("min_price"))
    shops = rows.select("brand", "model", F.explode("s").alias("shop")).groupBy("brand", "model").agg(F.countDistinct("shop").alias("shops"))
    return out.join(shops, ["brand", "model"], "left").select("brand", "model", "variants", "offers", F.coalesce("shops", F.lit(0)).alias("shops"), "min_price")


def variants_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant's axes as one sorted text, with its number of listings."""
    counts = offers(spark, sf_dir).groupBy("variant_id").agg(F.count("*").alias("n"))
    axes = F.concat_ws(";", F.concat(F.lit("brand="), F.col("brand")), F.concat(F.lit("size="), F.col("size").cast("string")))
    return variants(spark, sf_dir).join(counts, "variant_id", "left").select("variant_id", axes.alias("axes"), F.coalesce("n", F.lit(0)).alias("offers"))


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words anywhere in the title, or the id."""
    t = F.col("title")
    return variants(spark, sf_dir).where((t.ilike("%RED%") & t.ilike("%g%")) | (F.col("variant_id") == 77)).select("variant_id", "title")


def brands_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    v = variants(spark, sf_dir)
    own = v.groupBy("brand").agg(F.count("*").alias("variants"), F.countDistinct("model").alias("families"))
    sold = o.join(v.select("variant_id", "brand"), "variant_id").groupBy("brand").agg(F.count("*").alias("offers"), F.countDistinct("shop_id").alias("shops"))
    return own.join(sold, "brand", "left").select("brand", "variants", "families", F.coalesce("offers", F.lit(0)).alias("offers"), F.coalesce("shops", F.lit(0)).alias("shops"))


def offers_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of fifty listings by price, nulls last, ids breaking ties, with the total that the filters find."""
    rows = offers(spark, sf_dir).where("condition = 'new' and availability = 'in_stock'")
    page = rows.orderBy(F.col("price").desc_nulls_last(), "offer_id").offset(100).limit(50)
    return page.crossJoin(rows.agg(F.count("*").alias("total"))).select("offer_id", "price", "total")


def offers_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).where("offer_id > 5000").orderBy("offer_id").limit(100).select("offer_id", "condition")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent, own visibility: the regions, their nations, and the nations' suppliers."""
    r, n, s = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    out = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") != 3).alias("visible"))
    out = out.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), (F.col("n_nationkey") % 7 != 0).alias("visible")))
    return out.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.lit(True).alias("visible")))


_TREE = """tree AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_regionkey <> 3 AS visible FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 7 <> 0 FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, true FROM supplier)"""
_CLOSURE = f"""WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS above, parent, 0 AS depth, visible AS v FROM tree UNION ALL SELECT up.id, tree.id, tree.parent, up.depth + 1, tree.visible FROM up JOIN tree ON up.parent = tree.id)"""


def closure(tree: DataFrame) -> DataFrame:
    """id, above, depth, v for each node and each of its ancestors (itself at 0), however deep the tree.

    Paths double in length at each round, so there are as many rounds as the depth has binary digits;
    each round is written once. A cycle is an error.
    """
    reach = tree.select("id", F.col("id").alias("above"), F.lit(0).alias("depth"))
    step = saved(tree.where("parent is not null").join(tree.select(F.col("id").alias("parent")), "parent").select("id", F.col("parent").alias("above"), F.lit(1).alias("depth")))
    while not step.isEmpty():
        if not step.where("id = above").isEmpty():
            raise ValueError("the tree has a cycle")
        far = step.select(F.col("id").alias("above"), F.col("above").alias("to"), F.col("depth").alias("more"))
        reach = saved(reach.unionByName(reach.join(far, "above").select("id", F.col("to").alias("above"), (F.col("depth") + F.col("more")).alias("depth"))))
        step = saved(step.join(far, "above").select("id", F.col("to").alias("above"), (F.col("depth") + F.col("more")).alias("depth")))
    return reach.join(tree.select(F.col("id").alias("above"), F.col("visible").alias("v")), "above")


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(_tree(spark, sf_dir)).select("id", "above", "depth")


def effective_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node is visible if it and all above it are."""
    return closure(_tree(spark, sf_dir)).groupBy("id").agg(F.bool_and("v").alias("visible"))


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of each node's subtree."""
    own = offers(spark, sf_dir).groupBy(F.concat(F.lit("s"), "shop_id").alias("id")).agg(F.count("*").alias("own"))
    return closure(_tree(spark, sf_dir)).join(own, "id", "left").groupBy("above").agg(F.coalesce(F.sum("own"), F.lit(0)).alias("offers"), F.count("*").alias("nodes"))


# repairs


def suspects_part_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One maker's part number (without white space) on several entries that agree on every axis that they share: no axis has two values."""
    rows = entries(spark, sf_dir).where(~F.col("mpn").rlike(r"\s")).groupBy("brand", "mpn")
    found = rows.agg(F.count("*").alias("n"), F.min("variant_id").alias("first"), F.max("variant_id").alias("last"), *[F.countDistinct(a).alias(f"_{a}") for a in AXES])
    return found.where((F.col("n") > 1) & (F.col("_size") <= 1) & (F.col("_colour") <= 1)).select("brand", "mpn", "n", "first", "last")


def suspects_near_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different prices of one maker, model and size that lie within five in a hundred of each other, each pair once, with the first entry and the number of entries of both.

    Entries of one price are one class. A class is filed under the logarithm of its price, in bins a
    little wider than near prices can lie apart, and meets its own bin and the next one only.
    """
    same = ["brand", "model", "size"]
    classes = variants(spark, sf_dir).where("list_price > 0").groupBy(*same, "list_price").agg(F.min("variant_id").alias("first"), F.count("*").alias("n"))
    classes = classes.withColumn("bin", F.floor(F.log(F.col("list_price").cast("double")) / 0.0514).cast("long"))  # -ln 0.95 is 0.0513
    low = classes.select(*same, F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("list_price").alias("low"), F.col("first").alias("a"), F.col("n").alias("a_n"))
    high = classes.select(*same, "bin", F.col("list_price").alias("high"), F.col("first").alias("b"), F.col("n").alias("b_n"))
    return low.join(high, [*same, "bin"]).where((F.col("low") < F.col("high")) & near_value(F.col("low"), F.col("high"))).select("low", "high", "a", "b", "a_n", "b_n")


def suspects_word_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the same words in another order."""
    v = variants(spark, sf_dir).withColumn("bag", word_bag(F.col("model")))
    return v.groupBy("bag").agg(F.count("*").alias("entries"), F.countDistinct("model").alias("names"), F.min("model").alias("first")).where("entries > 1")


def barcode_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes that exactly two variants hold."""
    o = offers(spark, sf_dir).withColumn("gtin", F.col("offer_id") % 29989)
    last = newest(o, ["variant_id", "shop_id"], F.desc("seen_at"), F.desc("offer_id"))
    return last.groupBy("gtin").agg(F.min("variant_id").alias("a"), F.max("variant_id").alias("b"), F.countDistinct("variant_id").alias("n")).where("n = 2").select("gtin", "a", "b")


def stale_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose name no shop's newest listing reads, with the name that most read: by count, then the shorter, then the first in order."""
    last = newest(said(spark, sf_dir).where("model is not null"), ["true_id", "seller_id"], F.desc("seen_at"), F.desc("offer_id")).select(F.col("true_id").alias("variant_id"), F.col("model").alias("reads"))
    counts = last.groupBy("variant_id", "reads").agg(F.count("*").alias("n"))
    rows = counts.join(entries(spark, sf_dir).select("variant_id", "model"), "variant_id")
    kept = rows.where("reads = model").select("variant_id")
    best = newest(rows.join(kept, "variant_id", "left_anti"), ["variant_id"], F.desc("n"), F.length("reads"), F.col("reads"))
    return best.select("variant_id", "model", F.col("reads").alias("becomes"), "n")


def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without a colour all of whose listings state one, and not the same."""
    rows = said(spark, sf_dir).select(F.col("true_id").alias("variant_id"), F.when(F.col("channel") % 5 != 0, F.coalesce("colour", F.lit("plain"))).alias("colour"))
    found = rows.groupBy("variant_id").agg(F.bool_and(F.col("colour").isNotNull()).alias("all_state"), F.countDistinct("colour").alias("kinds")).where("all_state and kinds >= 2")
    return found.join(entries(spark, sf_dir).where("colour is null").select("variant_id"), "variant_id", "left_semi").select("variant_id", "kinds")


def misfiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose model isn't their family's (that of its first entry), whatever the case."""
    e = entries(spark, sf_dir).withColumn("family", F.concat_ws("|", "brand", "category", (F.col("variant_id") % 50).cast("string")))
    family = e.groupBy("family").agg(F.min_by("model", "variant_id").alias("family_model"))
    return e.join(family, "family").where(F.lower("model") != F.lower("family_model")).select("variant_id", "model", "family_model")


def miscased_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families all of whose entries have one model that differs from the family's name in case only."""
    e = entries(spark, sf_dir).withColumn("family", F.concat_ws("|", "brand", F.initcap("model")))
    found = e.groupBy("family", F.concat_ws(" ", "brand").alias("brand")).agg(F.countDistinct("model").alias("models"), F.min("model").alias("model"), F.count("*").alias("entries"))
    name = F.substring_index("family", "|", -1)
    return found.where((F.col("models") == 1) & (name != F.col("model")) & (F.lower(name) == F.lower("model"))).select("family", "model", "entries")


def deletable_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden families (suppliers with little on their account) without an entry, a mention in the log, or a merge: three anti joins."""
    s = read(spark, sf_dir, "supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").alias("family_id"), "s_name")
    sold = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("family_id"))
    told = read(spark, sf_dir, "events").where("event_type = 'signup' and value > 95").select(F.col("user_id").alias("family_id"))
    gone = read(spark, sf_dir, "part").where("p_partkey % 70 = 0").select(F.col("p_size").cast("long").alias("family_id"))
    for other in (sold, told, gone):
        s = s.join(other, "family_id", "left_anti")
    return s


def stale_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of entries that all their listings that state them read otherwise, or that the entry lacks: the one value that is read."""
    axis = F.explode(F.array(F.struct(F.lit("size").alias("axis"), F.col("size").alias("value")), F.struct(F.lit("colour").alias("axis"), F.col("colour").alias("value")))).alias("x")
    reads = said(spark, sf_dir).select(F.col("true_id").alias("variant_id"), axis).select("variant_id", "x.*").where("value is not null")
    reads = reads.groupBy("variant_id", "axis").agg(F.countDistinct("value").alias("kinds"), F.min("value").alias("reads"), F.count("*").alias("n")).where("kinds = 1")
    held = entries(spark, sf_dir).select("variant_id", axis).select("variant_id", F.col("x.axis").alias("axis"), F.col("x.value").alias("held"))
    return reads.join(held, ["variant_id", "axis"]).where(~F.col("reads").eqNullSafe(F.col("held"))).select("variant_id", "axis", "held", "reads", "n")


def suspects_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspects by kind: how many there are, and the first entry of the largest."""
    part = suspects_part_number(spark, sf_dir).select(F.lit("part_number").alias("kind"), F.col("first").alias("entry"), F.col("n").alias("size"))
    near = suspects_near_value(spark, sf_dir).select(F.lit("near_value").alias("kind"), F.col("a").alias("entry"), (F.col("a_n") + F.col("b_n")).alias("size"))
    every = part.unionByName(near)
    return every.groupBy("kind").agg(F.count("*").alias("total"), F.max_by("entry", F.struct("size", -F.col("entry"))).alias("entry"), F.max("size").alias("size"))


def empty_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants without a new listing above 60,000."""
    seen = offers(spark, sf_dir).where("condition = 'new' and price > 60000").select("variant_id").distinct()
    return variants(spark, sf_dir).join(seen, "variant_id", "left_anti").select("variant_id", "brand")


def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maker with which each word of a title stands most often, ties to the first name."""
    words = variants(spark, sf_dir).select("brand", "variant_id", F.explode(F.split(F.lower("title"), " ")).alias("word"))
    counts = words.groupBy("word", "brand").agg(F.countDistinct("variant_id").alias("entries")).where("entries >= 2")
    return newest(counts, ["word"], F.desc("entries"), F.col("brand")).select("word", "brand", "entries")


def dedupe_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of identifiers with one form, the one of a person stays, else the oldest."""
    o = offers(spark, sf_dir).withColumn("form", F.lpad((F.col("variant_id") % 300).cast("string"), 14, "0"))
    return newest(o, ["form"], (F.col("condition") != "new").cast("int"), F.col("seen_at"), F.col("offer_id")).select("form", "offer_id")


def barcodes_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form and the check digit's verdict for a number made of each listing's id."""
    raw = F.concat(F.lit("59029"), F.lpad((F.col("offer_id") % 100000000).cast("string"), 8, "0"))
    return offers(spark, sf_dir).select("offer_id", gtin_canonical(raw).alias("gtin"), gtin_valid(raw).alias("valid"))


_NEAR = f"""{VARIANTS}, c AS (SELECT brand, model, size, list_price, min(variant_id) AS first, count(*) AS n FROM variants WHERE list_price > 0 GROUP BY ALL),
near AS (SELECT x.list_price AS low, y.list_price AS high, x.first AS a, y.first AS b, x.n AS a_n, y.n AS b_n FROM c x JOIN c y ON x.brand = y.brand AND x.model = y.model AND x.size = y.size AND x.list_price < y.list_price AND (y.list_price - x.list_price) * 20 <= y.list_price)"""
QUERIES = {
    f.__name__: f
    for f in (
        products_list, variants_list, catalog_search, brands_list, offers_list, offers_keyset, ancestors, effective_visibility, category_rollup,
        suspects_part_number, suspects_near_value, suspects_word_order, barcode_duplicates, stale_names, split_candidates, empty_families, misfiled, miscased_families, deletable_families, stale_axes, suspects_report, alias_candidates, dedupe_identifiers, barcodes_checked,
    )
}
ORACLES = {
    "products_list": f"""WITH {OFFERS}, {VARIANTS}, s AS (SELECT brand, model, count(*) AS offers, count(DISTINCT shop_id) AS shops, min(price) AS min_price FROM offers JOIN variants USING (variant_id) WHERE availability = 'in_stock' GROUP BY ALL)
SELECT v.brand, v.model, count(*) AS variants, coalesce(any_value(offers), 0) AS offers, coalesce(any_value(shops), 0) AS shops, any_value(min_price) AS min_price FROM variants v LEFT JOIN s ON s.brand = v.brand AND s.model = v.model GROUP BY ALL""",
    "variants_list": f"WITH {OFFERS}, {VARIANTS} SELECT variant_id, 'brand=' || brand || ';size=' || size AS axes, (SELECT count(*) FROM offers o WHERE o.variant_id = v.variant_id) AS offers FROM variants v",
    "catalog_search": f"WITH {VARIANTS} SELECT variant_id, title FROM variants WHERE (title ILIKE '%RED%' AND title ILIKE '%g%') OR variant_id = 77",
    "brands_list": f"""WITH {OFFERS}, {VARIANTS}, s AS (SELECT brand, count(*) AS offers, count(DISTINCT shop_id) AS shops FROM offers JOIN variants USING (variant_id) GROUP BY brand)
SELECT v.brand, count(*) AS variants, count(DISTINCT model) AS families, coalesce(any_value(offers), 0) AS offers, coalesce(any_value(shops), 0) AS shops FROM variants v LEFT JOIN s USING (brand) GROUP BY v.brand""",
    "offers_list": f"WITH {OFFERS}, f AS (SELECT * FROM offers WHERE condition = 'new' AND availability = 'in_stock') SELECT offer_id, price, (SELECT count(*) FROM f) AS total FROM f ORDER BY price DESC NULLS LAST, offer_id LIMIT 50 OFFSET 100",
    "offers_keyset": f"WITH {OFFERS} SELECT offer_id, condition FROM offers WHERE offer_id > 5000 ORDER BY offer_id LIMIT 100",
    "ancestors": f"{_CLOSURE} SELECT id, above, depth FROM up",
    "effective_visibility": f"{_CLOSURE} SELECT id, bool_and(v) AS visible FROM up GROUP BY id",
    "category_rollup": f"{_CLOSURE}, own AS (SELECT 's' || l_suppkey AS id, count(*) AS own FROM lineitem GROUP BY ALL) SELECT above, CAST(coalesce(sum(own), 0) AS BIGINT) AS offers, count(*) AS nodes FROM up LEFT JOIN own USING (id) GROUP BY above",
    "suspects_word_order": f"""WITH {VARIANTS} SELECT list_aggregate(list_sort(regexp_extract_all(lower(replace(model, '+', ' plus ')), '[0-9a-z]+')), 'string_agg', ' ') AS bag, count(*) AS entries, count(DISTINCT model) AS names, min(model) AS first FROM variants GROUP BY ALL HAVING count(*) > 1""",
    "barcode_duplicates": f"""WITH {OFFERS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant_id, shop_id ORDER BY seen_at DESC, offer_id DESC) AS n FROM offers) WHERE n = 1)
SELECT offer_id % 29989 AS gtin, min(variant_id) AS a, max(variant_id) AS b FROM l GROUP BY ALL HAVING count(DISTINCT variant_id) = 2""",
    "empty_families": f"WITH {VARIANTS} SELECT variant_id, brand FROM variants WHERE variant_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_extendedprice > 60000)",
    "alias_candidates": f"""WITH {VARIANTS}, w AS (SELECT brand, variant_id, unnest(string_split(lower(title), ' ')) AS word FROM variants), c AS (SELECT word, brand, count(DISTINCT variant_id) AS entries FROM w GROUP BY ALL HAVING count(DISTINCT variant_id) >= 2)
SELECT word, brand, entries FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY entries DESC, brand) AS n FROM c) WHERE n = 1""",
    "dedupe_identifiers": f"""WITH {OFFERS} SELECT form, offer_id FROM (SELECT lpad(CAST(variant_id % 300 AS VARCHAR), 14, '0') AS form, offer_id, row_number() OVER (PARTITION BY variant_id % 300 ORDER BY CASE WHEN condition = 'new' THEN 0 ELSE 1 END, seen_at, offer_id) AS n FROM offers) WHERE n = 1""",
    "barcodes_checked": f"""WITH {OFFERS}, r AS (SELECT offer_id, '59029' || lpad(CAST(offer_id % 100000000 AS VARCHAR), 8, '0') AS d FROM offers)
SELECT offer_id, lpad(d, 14, '0') AS gtin, list_sum(list_transform(range(0, 13), lambda i: CAST(substr(d, 13 - i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10 = 0 AS valid FROM r""",
    "suspects_part_number": f"WITH e AS ({ENTRY_FACTS}) SELECT brand, mpn, count(*) AS n, min(variant_id) AS first, max(variant_id) AS last FROM e GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT size) <= 1 AND count(DISTINCT colour) <= 1",
    "suspects_near_value": f"WITH {_NEAR} SELECT low, high, a, b, a_n, b_n FROM near",
    "stale_names": f"""WITH e AS ({ENTRY_FACTS}), f AS ({LISTING_FACTS}), l AS (SELECT true_id AS variant_id, model AS reads FROM (SELECT *, row_number() OVER (PARTITION BY true_id, seller_id ORDER BY seen_at DESC, offer_id DESC) AS k FROM f WHERE model IS NOT NULL) WHERE k = 1),
c AS (SELECT variant_id, reads, count(*) AS n FROM l GROUP BY ALL), x AS (SELECT c.variant_id, e.model, reads AS becomes, n, row_number() OVER (PARTITION BY c.variant_id ORDER BY n DESC, len(reads), reads) AS k FROM c JOIN e USING (variant_id) WHERE NOT EXISTS (SELECT 1 FROM c i WHERE i.variant_id = c.variant_id AND i.reads = e.model))
SELECT variant_id, model, becomes, n FROM x WHERE k = 1""",
    "split_candidates": f"""WITH e AS ({ENTRY_FACTS}), f AS ({LISTING_FACTS}) SELECT true_id AS variant_id, count(DISTINCT coalesce(f.colour, 'plain')) AS kinds FROM f WHERE true_id IN (SELECT variant_id FROM e WHERE colour IS NULL) GROUP BY ALL HAVING bool_and(channel % 5 <> 0) AND count(DISTINCT coalesce(f.colour, 'plain')) >= 2""",
    "misfiled": f"""WITH e AS ({ENTRY_FACTS}), m AS (SELECT *, first_value(model) OVER (PARTITION BY brand, category, variant_id % 50 ORDER BY variant_id) AS family_model FROM e) SELECT variant_id, model, family_model FROM m WHERE lower(model) <> lower(family_model)""",
    "miscased_families": f"""WITH e AS ({ENTRY_FACTS}), f AS (SELECT brand, model, list_aggregate(list_transform(string_split(lower(model), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS name FROM e)
SELECT brand || '|' || name AS family, min(model) AS model, count(*) AS entries FROM f GROUP BY brand, name HAVING count(DISTINCT model) = 1 AND name <> min(model)""",
    "deletable_families": "SELECT s_suppkey AS family_id, s_name FROM supplier WHERE s_acctbal < 3000 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09) AND s_suppkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 95) AND s_suppkey NOT IN (SELECT p_size FROM part WHERE p_partkey % 70 = 0)",
    "stale_axes": f"""WITH e AS ({ENTRY_FACTS}), f AS ({LISTING_FACTS}), r AS (SELECT true_id AS variant_id, 'size' AS axis, size AS value FROM f UNION ALL SELECT true_id, 'colour', colour FROM f), u AS (SELECT variant_id, axis, min(value) AS reads, count(value) AS n FROM r GROUP BY ALL HAVING count(DISTINCT value) = 1),
h AS (SELECT variant_id, 'size' AS axis, size AS held FROM e UNION ALL SELECT variant_id, 'colour', colour FROM e) SELECT variant_id, axis, held, reads, n FROM u JOIN h USING (variant_id, axis) WHERE reads IS DISTINCT FROM held""",
    "suspects_report": f"""WITH {_NEAR}, e AS ({ENTRY_FACTS}), s AS (SELECT 'near_value' AS kind, a AS entry, a_n + b_n AS size FROM near UNION ALL SELECT 'part_number', min(variant_id), count(*) FROM e GROUP BY brand, mpn HAVING count(*) > 1 AND count(DISTINCT size) <= 1 AND count(DISTINCT colour) <= 1)
SELECT kind, count(*) AS total, arg_max(entry, (size, -entry)) AS entry, max(size) AS size FROM s GROUP BY kind""",
}
