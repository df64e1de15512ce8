"""Scalar rules as Spark columns; nulls in give nulls out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the barcode kinds.
GTIN_LENGTHS = (8, 12, 13, 14)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _checks(d: Column) -> Column:
    """Whether the check digit of a text of at most 14 digits holds: filled to 14, weights are 3 and 1 from the left."""
    whole = F.lpad(d, 14, "0")
    total = sum((F.ascii(F.substring(whole, i + 1, 1)) - 48) * (3 if i % 2 == 0 else 1) for i in range(14))
    return total % 10 == 0


def gtin_valid(x: Column) -> Column:
    """Whether its digits are as many as a barcode kind has and their check digit holds (weights 3 and 1 from the right)."""
    d = digits(x)
    return F.when(x.isNull(), None).when(~F.length(d).isin(*GTIN_LENGTHS), False).otherwise(_checks(d))


def gtin_canonical(x: Column) -> Column:
    """Digits filled to 14; a longer number stays as it is."""
    d = digits(x)
    return F.when(F.length(d) > 14, d).otherwise(F.lpad(d, 14, "0"))


def gtin_restricted(x: Column) -> Column:
    """Numbers that shops give out themselves, by the digits as given."""
    return digits(x).rlike("^(02|04|2)")


def gtin_pick(candidates: Column) -> Column:
    """Of an array the longest barcode that is valid and unrestricted (the first of equals), in canonical form."""
    plain = F.filter(F.transform(candidates, digits), lambda d: F.length(d).isin(*GTIN_LENGTHS) & ~d.rlike("^(02|04|2)"))
    longest = F.aggregate(F.filter(plain, _checks), F.lit("").cast("string"), lambda best, d: F.when(F.length(d) > F.length(best), d).otherwise(best))
    return F.transform(F.array(longest), lambda d: F.when(d != "", F.lpad(d, 14, "0")))[0]


def gtin_generic(x: Column) -> Column:
    """A feed's barcode: 8 to 14 digits, without a test of the check digit."""
    d = digits(x)
    return F.when(F.length(d).between(8, 14), F.lpad(d, 14, "0"))


def price(x: Column) -> Column:
    """`1 179,00` is 1179.00; what is no number, or below 0, is null."""
    plain = F.regexp_replace(F.replace(F.regexp_replace(x, r"[\s ]", ""), F.lit(","), F.lit(".")), "[^0-9.-]", "")
    value = plain.try_cast("decimal(12,2)")
    return F.when(value >= 0, value)


def currency(field: Column, price_text: Column) -> Column:
    """A field of three letters, else the first three capitals in the price."""
    code = F.upper(F.trim(field))
    found = F.regexp_extract(price_text, r"\b([A-Z]{3})\b", 1)
    return F.when(code.rlike("^[A-Z]{3}$"), code).otherwise(F.nullif(found, F.lit("")))


def text(x: Column, most: int) -> Column:
    """White space as one space, cut, empty as null."""
    return F.nullif(F.trim(F.substring(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), 1, most)), F.lit(""))


def display_number(value: Column, unit: Column) -> Column:
    """Megabytes in the largest unit that gives one or more, inches with a mark; two decimals at most."""
    short = lambda v: F.regexp_replace(F.format_string("%.2f", v.cast("double")), r"\.?0+$", "")
    sized = F.when(value >= 1048576, F.concat(short(value / 1048576), F.lit(" TB"))).when(value >= 1024, F.concat(short(value / 1024), F.lit(" GB"))).otherwise(F.concat(short(value), F.lit(" MB")))
    return F.when(unit == "mb", sized).when(unit == "inch", F.concat(short(value), F.lit('"'))).otherwise(short(value))


def compose_title(*parts: Column) -> Column:
    """Parts joined by one space, blanks left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), " ")


def near_value(a: Column, b: Column) -> Column:
    """Within five in a hundred of the larger one."""
    return F.abs(a - b) * 20 <= F.greatest(F.abs(a), F.abs(b))


def word_bag(x: Column) -> Column:
    """Words in order, `+` being one."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(F.replace(x, F.lit("+"), F.lit(" plus "))), F.lit("([0-9a-z]+)"), 1)), " ")


def identity_key(brand: Column, category: Column, model: Column, axes: Column, expected: Column, kind: Column | None = None, unit_count: Column | None = None) -> Column:
    """A hash of maker, category, model, kind, units and axes (map of text); null unless every expected axis is there."""
    pairs = F.array_sort(F.transform(F.map_entries(axes), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    whole = (F.size(F.array_except(expected, F.map_keys(axes))) == 0) & F.forall(expected, lambda k: axes[k].isNotNull())
    parts = [brand, category, model, F.lit("single") if kind is None else kind, (F.lit(1) if unit_count is None else unit_count).cast("string"), F.array_join(pairs, ";")]
    bar = F.lit("|")
    return F.when(whole, F.sha2(F.concat(*[x for part in parts for x in (part, bar)][:-1]), 256))


# Fields of a flat feed in the order in which they are asked, and words for states.
TITLE_KEYS = ("title", "name", "product_name")
BRAND_KEYS = ("brand", "manufacturer", "vendor", "brand_name")
GTIN_KEYS = ("gtin", "ean", "ean13", "barcode", "upc")
MPN_KEYS = ("mpn", "part_number", "partnumber", "sku", "vendor_code", "article")
MODEL_KEYS = ("model", "model_name")
PRICE_KEYS = ("price", "current_price", "sale_price", "amount")
CONDITIONS = {"new": "new", "refurbished": "refurbished", "refurb": "refurbished", "renewed": "refurbished", "used": "used", "second-hand": "used", "pre-owned": "used"}
AVAILABILITY = {
    "in_stock": "in_stock", "instock": "in_stock", "available": "in_stock", "true": "in_stock", "yes": "in_stock", "out_of_stock": "out_of_stock", "outofstock": "out_of_stock", "unavailable": "out_of_stock", "false": "out_of_stock", "no": "out_of_stock",
    "preorder": "preorder", "pre-order": "preorder", "backorder": "preorder",
}


def lowered(fields: Column) -> Column:
    """A map of text with its keys in lower case; of keys that become one the last counts."""
    pairs = F.map_entries(fields)
    keys = F.transform(pairs, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(pairs, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def first_text(fields: Column, keys: tuple[str, ...], most: int) -> Column:
    """The first of some keys (of a map with lower-case keys) that says anything."""
    return text(F.coalesce(*[F.nullif(fields[k], F.lit("")) for k in keys]), most)


def mapped(value: Column, table: dict[str, str], fallback: str) -> Column:
    """A synonym's meaning; white space between words counts as an underscore."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))), F.lit(fallback))


def category_path(parts: Column) -> Column:
    """Parts that say anything, with ` / ` between them, up to 500 characters."""
    plain = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.nullif(F.substring(F.array_join(F.filter(plain, lambda x: x != ""), " / "), 1, 500), F.lit(""))


def attribute_name(x: Column) -> Column:
    """Commas and semicolons are spaces, marks at the ends go (a closing bracket stays), lower case."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(x, "[,;]", " "), r"(?U)[\s ]+", " "))
    plain = F.trim(F.regexp_replace(plain, "^[:.,;®™]+|[:.,;®™]+$", ""))
    return F.nullif(F.lower(F.trim(F.regexp_replace(plain, r"(?U)[^\w)]+$", ""))), F.lit(""))


def without_brand(name: Column, brand: Column) -> Column:
    """The name without the brand before it, where it ends there or a mark follows; unchanged if nothing is left."""
    plain, head = F.trim(name), F.trim(brand)
    rest = F.substring(plain, F.length(head) + 1, F.length(plain))
    bounded = F.lower(plain).startswith(F.lower(head)) & (head != "") & ((rest == "") | rest.rlike(r"^[\s,./|-]"))
    left = F.regexp_replace(rest, r"^[\s,./|-]+|[\s,./|-]+$", "")
    return F.when(F.coalesce(bounded & (left != ""), F.lit(False)), left).otherwise(plain)


#: No device holds more.
LARGEST_MB = 2 * 1024 * 1024


def megabytes(x: Column) -> Column:
    """The largest size in a text that a device can have; `128/4 GB` lends its unit to both, sizes marked as RAM don't count."""
    number, unit = r"\d+(?:[.,]\d+)?", "(?:TB|GB|MB)"
    plain = F.regexp_replace(x, rf"(?i)\bRAM\s*:?\s*{number}\s?GB\b|\b{number}\s?GB\s+(?:of\s+)?RAM\b", " ")
    found = lambda pattern: F.regexp_extract_all(plain, F.lit(pattern), 1)
    alone = found(rf"(?i)(\b{number}\s?{unit}\b)")
    shared = F.transform(found(rf"(?i)(\b{number}\s*/\s*{number}\s?{unit}\b)"), lambda p: F.concat(F.regexp_extract(p, rf"^({number})", 1), F.regexp_extract(p, r"([A-Za-z]+)$", 1)))

    def size(p: Column) -> Column:
        scale = F.when(p.ilike("%TB"), 1048576).when(p.ilike("%GB"), 1024).otherwise(1)
        return F.floor(F.replace(F.regexp_extract(p, rf"^({number})", 1), F.lit(","), F.lit(".")).cast("double") * scale).cast("long")

    return F.array_max(F.filter(F.transform(F.concat(alone, shared), size), lambda v: v <= LARGEST_MB))


def agreed_storage(stated: Column, titled: Column) -> Column:
    """The one size that fields (an array) and title agree on; of several fields the title settles which."""
    kinds = F.array_distinct(F.filter(stated, lambda x: x.isNotNull()))
    n = F.size(kinds)
    return F.when(titled.isNull(), F.when(n == 1, kinds[0])).when((n == 0) | ((n == 1) & (kinds[0] == titled)) | ((n > 1) & F.array_contains(kinds, titled)), titled)


def size_as_name(x: Column) -> Column:
    """A screen's size in place of a name: with a fraction, or with an inch mark; a whole number is a name."""
    mark = "(?:\"|''|”|″)"
    return x.rlike(rf"^\s*\d{{1,2}}(?:[.,]\d{{1,2}}\s*{mark}?|\s*{mark})\s*$")


def edition(title: Column, model: Column, mpn: Column) -> Column:
    """enterprise where title, model or part number say so, else standard."""
    said = F.concat_ws(" ", title, mpn, model)
    return F.when(said.rlike(r"(?i)\benterprise\b") | said.rlike(r"(?<![\w-])EE(?![\w-])") | said.rlike(r"(?i)\bSM-?[A-Z]\d{3}[A-Z0-9]*EE[A-Z]\b"), "enterprise").otherwise("standard")


def without_edition(model: Column) -> Column:
    """The model without words of its edition, unless nothing else is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(model, r"(?i)\b(?:enterprise(?:\s+edition)?)\b|(?-i)(?<![\w-])EE(?![\w-])", " "), r"\s+", " "))
    return F.when(bare != "", bare).otherwise(model)


def colour_of(phrase: Column, colours: Column) -> Column:
    """The meaning of a phrase in a map of colours: as a whole, else without words at its front, down to the last one."""
    plain = F.regexp_replace(phrase, "[„“”«»\"']", "")
    words = F.filter(F.split(F.lower(F.regexp_replace(plain, r"\([^)]*\)|\[[^\]]*\]", " ")), r"[\s,.;:/]+"), lambda w: w != "")
    tries = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.try_element_at(colours, F.array_join(F.slice(words, i, F.size(words)), " ")))
    return F.when(F.size(words) > 0, F.try_element_at(F.filter(tries, lambda x: x.isNotNull()), F.lit(1)))


def colour_pair(parts: Column, colours: Column) -> Column:
    """Several colours as one (`a-b`), if all are known and the registry has the pair; one alone is itself."""
    named = F.transform(parts, lambda p: colour_of(p, colours))
    joined = F.array_join(named, "-")
    known = F.size(named) == F.size(F.filter(named, lambda x: x.isNotNull()))
    return F.when(known & (F.size(named) > 0), F.when(F.size(named) == 1, named[0]).when(F.array_contains(F.map_values(colours), joined), joined))


def colour_in_title(title: Column, palette: Column) -> Column:
    """The one colour that a maker's palette (map of names) finds in a title as whole words in a row; none if there are two."""
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(title), F.lit(r"([\p{L}]+)"), 1), " "), F.lit(" "))
    found = F.array_distinct(F.transform(F.filter(F.map_entries(palette), lambda e: F.contains(words, F.concat(F.lit(" "), e["key"], F.lit(" ")))), lambda e: e["value"]))
    return F.when(F.size(found) == 1, found[0])


#: Words that make a name another model where they follow it.
VARIANTS = ("pro", "max", "plus", "ultra", "mini", "lite")


def model_in_title(title: Column, names: Column, longest: int = 6, variants: tuple[str, ...] = VARIANTS) -> Column:
    """The longest registered name (map of names) in a title, as whole words in a row; none if two have that length.

    A name that a variant word follows is no name there, nor are shorter ones within it.
    """
    def bound(value: Column, then) -> Column:
        """then(value), the value being worked out once."""
        return F.transform(F.array(value), then)[0]

    def held_of(words: Column) -> Column:
        n = F.size(words)
        spans = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.struct(k.alias("k")))
        windows = F.flatten(F.transform(words, lambda _, i: F.transform(F.filter(spans, lambda s: i + s["k"] <= n), lambda s: F.struct((i + 1).alias("at"), s["k"].alias("k"), F.array_join(F.slice(words, i + 1, s["k"]), " ").alias("name")))))
        return F.filter(windows, lambda w: F.map_contains_key(names, w["name"]))

    def chosen(words: Column, held: Column) -> Column:
        after = lambda w: F.regexp_replace(F.coalesce(F.get(words, w["at"] + w["k"] - 1), F.lit("")), r"\++$", "")
        goes_on = lambda w, next: next.isin(*variants) & ~((next == "plus") & w["name"].rlike(r"(?:\+|plus)$"))
        refused = F.filter(held, lambda w: bound(after(w), lambda next: goes_on(w, next)))
        good = bound(refused, lambda r: F.filter(held, lambda w: ~F.exists(r, lambda x: (x["at"] <= w["at"]) & (w["at"] + w["k"] <= x["at"] + x["k"]))))
        return bound(good, lambda g: bound(F.array_max(F.transform(g, lambda w: w["k"])), lambda most: F.array_distinct(F.transform(F.filter(g, lambda w: w["k"] == most), lambda w: names[w["name"]]))))

    words = F.regexp_extract_all(F.lower(title), F.lit(r"((?:[\p{L}\p{N}]|\+)+)"), 1)
    best = bound(words, lambda w: bound(held_of(w), lambda held: chosen(w, held)))
    return bound(best, lambda b: F.when(F.size(b) == 1, b[0]))


#: Keys whose values never leave the engine.
SENSITIVE = ("password", "new_password", "current_password", "password_hash", "secret", "secret_key", "token", "access_token", "refresh_token", "authorization", "api_key")


def redacted(fields: Column) -> Column:
    """A map of text with sensitive values replaced."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE), "[redacted]").otherwise(v))
