"""From a listing's signals to a catalogue entry: brands, agreement of axes, and the ladder of rungs.

Axes are maps of text. Each rung is asked for itself: its questions are the different
(signal, axes) of all listings, and they meet classes of entries (those of one key, axes and
category, with their number and least id), so a popular model costs one row for each of its different
questions and classes, however many listings and entries it has. Answers are written, and a listing gets its rungs'
answers by their keys: without a shuffle where they are small (in memory, whatever their files take); else listings without a signal are dealt out by their id.
Tables that grow with the catalogue are merged with each other by a shuffle, so that none of them is sent to the driver.

Names are compared in their Unicode forms (`functions.unicode`), which are made once for each different name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import without_brand
from ..functions.unicode import normalize_brand, normalize_model
from .saved import met, saved

CONFIDENCE = {"gtin": "1.000", "brand_mpn": "0.950", "brand_model": "0.800", "human": "1.000"}
UNPUBLISHED_SHARE, UNPUBLISHED_LEAST = 10, 50
_NONE = lambda: F.array().cast("array<string>")


def brand_lookup(listings: DataFrame, aliases: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """listings (offer_id, brand_raw, title, model) with brand and brand_state.

    aliases: alias, brand. A field that means one maker is resolved; one that means
    several is ambiguous unless a verdict (offer_id, choice; null for none of them) settles it. Where
    it means nothing, or nothing stands in it, the first two words or the first one of the title, then of
    the model, then the only maker named anywhere in the title. A field of which nothing is left in a
    brand's form is unreadable, and its title isn't asked.

    Each different field, title and model is looked up once, by itself, however many listings say it and in whatever combination, and what was found is
    written, so that it is joined without a shuffle of the listings where it is small. Only ambiguous ones meet the verdicts.
    """
    known = aliases.select(normalize_brand(F.col("alias")).alias("form"), "brand").groupBy("form").agg(F.countDistinct("brand").alias("n"), F.min("brand").alias("one")).where("form is not null")
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    start = lambda w, n: F.when(F.size(w) >= n, F.array_join(F.slice(w, 1, n), " "))
    said_by = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    def names(of: str, *said: Column) -> DataFrame:
        """Each different text of a column with the names in it."""
        texts = saved(listings.select(F.col(of).alias("_text")).distinct())
        return texts.select(F.lit(of).alias("of"), "_text", F.explode(F.concat(*said)).alias("x")).select("of", "_text", "x.*").where("name is not null and name <> ''")

    # each different name gets its form and its makers once; each text gets what was found by one aggregation
    w = words(F.col("_text"))
    every = F.transform(F.array_distinct(w), lambda x: said_by("any", F.regexp_replace(x, r"^[(),.:;/]+|[(),.:;/]+$", "")))
    edges = lambda *kinds: F.array(*[said_by(kind, start(w, 2 if kind.endswith("2") else 1)) for kind in kinds])
    said = names("title", edges("t2", "t1"), every).unionByName(names("model", edges("m2", "m1"))).unionByName(names("brand_raw", F.array(said_by("f", F.col("_text")))))
    formed = said.select("name").distinct().withColumn("form", normalize_brand(F.col("name")))
    meant = saved(formed.hint("merge").join(known, "form", "left").where("n is not null or form is null").select(F.col("name").alias("_on"), F.coalesce("n", F.lit(0)).alias("n"), "one"))
    means = met(said.withColumn("_n", F.lit(0)), F.col("name"), "_n", meant).where("n is not null")
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    sole = lambda kind: F.when((F.col("kind") == kind) & (F.col("n") == 1), F.col("one"))
    found = means.groupBy("of", F.col("_text").alias("_on")).agg(F.max(of("f", "n")).alias("_f_n"), F.max(of("f", "one")).alias("_f"), *[F.max(sole(k)).alias(f"_{k}") for k in ("t2", "t1", "m2", "m1")], F.min(sole("any")).alias("_low"), F.max(sole("any")).alias("_high"))
    found = saved(found.select("of", "_on", "_f_n", "_f", F.coalesce("_t2", "_t1").alias("_t"), F.coalesce("_m2", "_m1").alias("_m"), F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_any")))
    rows = listings
    for text, told in (("title", ("_t", "_any")), ("model", ("_m",)), ("brand_raw", ("_f_n", "_f"))):
        rows = met(rows, F.col(text), "offer_id", found.where(F.col("of") == text).select("_on", *told))
    rows = rows.withColumn("_field", F.nullif("brand_raw", F.lit("")))
    unreadable = F.coalesce(F.col("_f_n") == 0, F.lit(False))
    from_title = F.coalesce("_t", "_m", "_any")
    several = F.coalesce(F.col("_f_n") > 1, F.lit(False))
    unjudged = lambda some: some.withColumn("_choice", F.lit(None).cast("string")).withColumn("_judged", F.lit(None).cast("boolean"))
    if verdicts is not None:
        judged = rows.where(several).hint("merge").join(verdicts.select("offer_id", F.col("choice").alias("_choice"), F.lit(True).alias("_judged")), "offer_id", "left")
        rows = judged.unionByName(unjudged(rows.where(~several)))
    else:
        rows = unjudged(rows)
    brand = F.when(F.col("_f_n") == 1, F.col("_f")).when(several, F.col("_choice")).when(~unreadable, from_title)
    state = (
        F.when(unreadable, "unreadable").when(F.col("_f_n") == 1, "resolved")
        .when(several, F.when(F.col("_choice").isNotNull(), "resolved_judge").when(F.col("_judged"), "judged_none").otherwise("ambiguous"))
        .when(from_title.isNotNull(), "resolved_title").when(F.col("_field").isNull(), "none_given").otherwise("unknown")
    )
    return rows.select(*listings.columns, brand.alias("brand"), state.alias("brand_state"))


@dataclass(frozen=True)
class Agreement:
    """What a listing's axes say of an entry's: columns of booleans."""

    checked: Column  # the listing names an axis at all
    agreed: Column
    unverifiable: Column
    complete: Column


def agreement(wanted: Column, held: Column, required: Column, excused: Column) -> Agreement:
    """Over the axes that both name: none is unverifiable, all equal agree. Complete: every axis that tells
    the category's entries apart (or, if it says none, that the listing names), but those excused, was compared."""
    checked = F.size(F.map_keys(wanted)) > 0
    shared = F.array_intersect(F.map_keys(wanted), F.map_keys(held))
    equal = F.forall(shared, lambda k: wanted[k] == held[k])
    needed = F.array_except(F.when(F.size(required) > 0, required).otherwise(F.map_keys(wanted)), excused)
    agreed = ~checked | ((F.size(shared) > 0) & equal)
    return Agreement(checked, agreed, checked & (F.size(shared) == 0), checked & (F.size(shared) > 0) & equal & (F.size(F.array_except(needed, shared)) == 0))


def axes(**columns: Column) -> Column:
    """A map of the axes that are not null."""
    every = F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[c.cast("string") for c in columns.values()]))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def unpublished_axes(latest: DataFrame, names: list[str]) -> DataFrame:
    """channel, axis, n, stated: axes that a channel states on under a tenth of its latest listings, if these are fifty or more.

    latest: channel, axes.
    """
    rows = latest.select("channel", "axes", F.explode(F.array(*[F.lit(n) for n in names])).alias("axis"))
    counts = rows.groupBy("channel", "axis").agg(F.count("*").alias("n"), F.count_if(F.map_contains_key("axes", F.col("axis"))).alias("stated"))
    return counts.where((F.col("n") >= UNPUBLISHED_LEAST) & (F.col("stated") * UNPUBLISHED_SHARE < F.col("n")))


def _compared(axis_names: list[str], excused: bool) -> Agreement:
    """`agreement` over columns x_ (what a question says), h_ (what a class holds), r_ (what its category requires, or r_any) and e_ (excused)."""
    every = lambda of: reduce(and_, map(of, axis_names))
    some = lambda of: reduce(or_, map(of, axis_names))
    says, both = lambda x: F.col(f"x_{x}").isNotNull(), lambda x: F.col(f"x_{x}").isNotNull() & F.col(f"h_{x}").isNotNull()
    needs = lambda x: F.when(F.col("r_any"), F.col(f"r_{x}")).otherwise(says(x)) & (~F.col(f"e_{x}") if excused else F.lit(True))
    equal = every(lambda x: ~both(x) | (F.col(f"x_{x}") == F.col(f"h_{x}")))
    checked, shared, equal = some(says), some(both), F.coalesce(equal, F.lit(True))
    return Agreement(checked, ~checked | (shared & equal), checked & ~shared, checked & shared & equal & every(lambda x: ~needs(x) | both(x)))


def held_axes(entries: DataFrame, categories: DataFrame, axis_names: list[str]) -> DataFrame:
    """variant_id of entries with h_ (what they hold), r_ and r_any (what their category requires)."""
    wanted = F.coalesce("required", _NONE())
    held = met(entries, F.col("category"), "variant_id", categories.select(F.col("category").alias("_on"), "required"))
    return held.select("variant_id", *[F.col("axes")[a].alias(f"h_{a}") for a in axis_names], *[F.array_contains(wanted, a).alias(f"r_{a}") for a in axis_names], (F.size(wanted) > 0).alias("r_any"))


def taken_by_key(axis_names: list[str]) -> tuple[Column, Column]:
    """Whether a question takes a class under its key, whose first letter is the rung (g, p, m; others take all), and whether that is complete: what `ladder` asks of each rung."""
    plain, spared, rung = _compared(axis_names, excused=False), _compared(axis_names, excused=True), F.substring("key", 1, 1)
    taken = (
        F.when(rung == "g", ~(F.col("learned") & plain.checked & ~plain.agreed)).when(rung == "p", plain.agreed | plain.unverifiable)
        .when(rung == "m", spared.agreed & (~F.col("strict") | spared.complete)).otherwise(True)
    )
    return taken, spared.complete


def first_found(found: Column) -> Column:
    """The entry that the ladder finds, of what stands under each key in the rungs' order (key, there, n, one, c_n, c): none below a barcode or part number of several, and the first form of a name that any entry has."""
    at = lambda rung: F.get(F.filter(found, lambda f: f["key"].startswith(f"{rung}|") & f["there"]), F.lit(0))
    g, p, m = at("g"), at("p"), at("m")
    sole = F.when(m["n"] == 1, m["one"]).when((m["n"] > 1) & (m["c_n"] == 1), m["c"])
    return F.when(g["n"] == 1, g["one"]).when(g["n"] > 1, None).when(p["n"] == 1, p["one"]).when(p["n"] > 1, None).otherwise(sole)


def _answers(asked: DataFrame, classes: DataFrame, by: list[str], takes: Callable[[Agreement], Column], axis_names: list[str], excused: bool = False) -> DataFrame:
    """For each question (by) what it finds among classes of its key: n and one of those taken, c_n and c of the complete ones, u_n that nothing could check, and the bounds of the axes of those taken."""
    a = _compared(axis_names, excused)
    pairs = asked.where("key is not null").hint("merge").join(classes, "key").select(*by, "many", "variant_id", *[f"h_{x}" for x in axis_names], takes(a).alias("taken"), a.complete.alias("complete"), a.unverifiable.alias("unverifiable"))
    whole = F.col("taken") & F.col("complete")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("many"))), F.lit(0))
    bounds = [of(F.when(F.col("taken"), F.col(f"h_{x}"))).alias(f"{end}_{x}") for x in axis_names for end, of in (("low", F.min), ("high", F.max))]
    return pairs.groupBy(*by).agg(
        total(F.col("taken")).alias("n"), F.min(F.when(F.col("taken"), F.col("variant_id"))).alias("one"), total(whole).alias("c_n"), F.min(F.when(whole, F.col("variant_id"))).alias("c"), total(F.col("unverifiable")).alias("u_n"), *bounds
    )


def ladder(listings: DataFrame, entries: DataFrame, gtins: DataFrame, mpns: DataFrame, categories: DataFrame, axis_names: list[str]) -> DataFrame:
    """listings with strict, method, found, complete and reason.

    listings    offer_id, gtin, brand, brand_raw, brand_state, mpn, model, title, axes, category, excused (axes that its channel doesn't publish)
    entries     variant_id, brand, category, model, axes
    gtins       gtin, variant_id, learned (whether a match put it there)
    mpns        brand, mpn, variant_id
    categories  category, required (axes), strict
    axis_names  all axes that there are

    A barcode needs one entry, those left out whose learned barcode the axes contradict; a part
    number one that the axes don't contradict; a model one that they confirm (in a strict category on
    every required axis that its channel publishes), or the only complete one of several.
    """
    x, e = [f"x_{a}" for a in axis_names], [f"e_{a}" for a in axis_names]
    categories = saved(categories)
    by = met(listings, F.col("category"), "offer_id", categories.select(F.col("category").alias("_on"), "strict")).withColumn("strict", F.coalesce("strict", F.lit(False)))
    by = by.select("*", *[F.col("axes")[a].alias(f"x_{a}") for a in axis_names], *[(F.col("strict") & F.array_contains("excused", a)).alias(f"e_{a}") for a in axis_names], F.coalesce(F.nullif("model", F.lit("")), F.nullif("title", F.lit(""))).alias("_name"))

    held = held_axes(entries, categories, axis_names)
    own = [c for c in held.columns if c != "variant_id"]
    classed = lambda rows, *key: rows.hint("merge").join(held, "variant_id").groupBy(*key, *own).agg(F.count("*").alias("many"), F.min("variant_id").alias("variant_id"))
    within = lambda form: F.when(form != "", F.concat("brand", F.lit("|"), form))

    coded = gtins.groupBy(F.col("gtin").alias("key"), "variant_id").agg(F.bool_and("learned").alias("learned"))
    asked = by.where("gtin is not null").select("gtin", *x).distinct().withColumn("key", F.col("gtin"))
    g = _answers(asked, classed(coded, "key", "learned"), ["gtin", *x], lambda a: ~(F.col("learned") & a.checked & ~a.agreed), axis_names)

    parts = mpns.select(within(normalize_model(F.col("mpn"))).alias("key"), "variant_id").where("key is not null").distinct()
    asked = by.where("brand is not null and mpn is not null").select("brand", "mpn", *x).distinct().withColumn("key", within(normalize_model(F.col("mpn"))))
    p = _answers(asked, classed(parts, "key"), ["brand", "mpn", *x], lambda a: a.agreed | a.unverifiable, axis_names)

    named = entries.select(within(normalize_model(F.col("model"))).alias("key"), "variant_id").where("key is not null")
    asked = by.where("brand is not null and _name is not null").select("brand", "_name", "strict", *x, *e).distinct()
    forms = asked.select("brand", "_name").distinct()
    forms = forms.select("*", *[within(normalize_model(form)).alias(f"k{i}") for i, form in enumerate((F.col("_name"), without_brand(F.col("_name"), F.col("brand")), F.concat("brand", F.lit(" "), F.col("_name"))))])
    forms = forms.select("brand", "_name", F.posexplode(F.array("k0", "k1", "k2")).alias("rung", "key"))
    # the first form of a name that any entry has
    forms = forms.hint("merge").join(named.select("key").distinct(), "key").groupBy("brand", "_name").agg(F.min_by("key", "rung").alias("key"))
    m = _answers(asked.hint("merge").join(forms, ["brand", "_name"]), classed(named, "key"), ["brand", "_name", "strict", *x, *e], lambda a: a.agreed & (~F.col("strict") | a.complete), axis_names, excused=True)

    def answered(rows: DataFrame, answers: DataFrame, key: list[str], rung: str, entry: Column, **told: Column) -> DataFrame:
        """rows with the rung's entry and what is told of it, whose yes and no are bits of one number until they are there."""
        asks = reduce(and_, [F.col(c).isNotNull() for c in key if not c.startswith("x_")])
        on = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in key])
        bits = reduce(add, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(told.values())])
        right = saved(answers.where("n > 0 or u_n > 0").select(on.alias("_on"), entry.alias(rung), bits.alias("_bits")))
        out = met(rows, F.when(asks, on), "offer_id", right)
        return out.withColumns({f"{rung}_{name}": F.col("_bits").bitwiseAND(1 << i) > 0 for i, name in enumerate(told)}).drop("_bits")

    # what an answer means is worked out once for each question, so that little is left to do for each listing
    n, one, whole = F.col("n"), F.when(F.col("n") == 1, F.col("one")), F.col("c_n") == 1
    sole = F.when(n == 1, F.col("one")).when((n > 1) & whole, F.col("c"))
    varies = {f"varies_{a}": F.coalesce(F.col(f"low_{a}") != F.col(f"high_{a}"), F.lit(False)) for a in axis_names}
    out = answered(by, g, ["gtin", *x], "g", one, several=n > 1, whole=whole)
    out = answered(out, p, ["brand", "mpn", *x], "p", one, several=n > 1, whole=whole)
    out = answered(out, m, ["brand", "_name", "strict", *x, *e], "m", sole, several=n > 1, whole=whole & (sole == F.col("c")), unsure=F.col("u_n") > 0, **varies)

    def first_rung(g: Column, p: Column, m: Column) -> Column:
        """Of the highest rung that finds one; none below a rung that finds several."""
        low = F.when(F.col("m").isNotNull(), m)
        return F.when(F.col("g").isNotNull(), g).when(F.col("g_several"), None).when(F.col("p").isNotNull(), p).when(F.col("p_several"), None).otherwise(low)

    method = first_rung(F.lit("gtin"), F.lit("brand_mpn"), F.lit("brand_model"))
    complete = first_rung(F.col("g_whole"), F.col("p_whole"), F.col("m_whole"))
    silent = reduce(or_, [F.col(f"m_varies_{a}") & F.col(f"x_{a}").isNull() for a in axis_names], F.lit(False))
    several = F.when(F.col("g_several") | F.col("p_several"), "ambiguous").when(F.col("m_several"), F.when(silent, "axis_unpublished").otherwise("ambiguous")).when(F.col("m_unsure") & ~F.col("strict"), "low_confidence")
    empty = lambda c: F.nullif(c, F.lit(""))
    nothing = (
        F.when(F.coalesce(*map(empty, ("gtin", "mpn", "model", "brand_raw"))).isNull(), "no_signals").when(F.col("gtin").isNotNull(), "signals_unmatched").when(F.col("brand_state") == "ambiguous", "brand_ambiguous")
        .when(F.col("brand_state").isin("unknown", "unreadable", "judged_none"), "brand_unknown").otherwise("signals_unmatched")
    )
    out = out.select(*listings.columns, "strict", method.alias("method"), first_rung(F.col("g"), F.col("p"), F.col("m")).alias("found"), F.coalesce(complete, F.lit(False)).alias("complete"), F.coalesce(several, nothing).alias("reason"))
    return out.withColumn("reason", F.when(F.col("method").isNull(), F.col("reason")))


def pending(listings: DataFrame, matches: DataFrame, queue: DataFrame, limit: int) -> DataFrame:
    """The new listings that a pass tries: those without a match in force, never tried ones first, then the least recently tried, ids breaking ties; `limit` is the pass's.

    listings: offer_id, condition; matches: offer_id, active; queue: offer_id (once each), last_attempt_at. The limit is a top-k over tasks, not a sort of all.
    """
    open_ = listings.where("condition = 'new'").join(matches.where("active").select("offer_id"), "offer_id", "left_anti")
    tried = open_.join(queue.select("offer_id", "last_attempt_at"), "offer_id", "left").select("offer_id", "last_attempt_at")
    return tried.orderBy(F.col("last_attempt_at").asc_nulls_first(), "offer_id").limit(limit)
