"""Shops' payloads as records: one row for each thing that can be bought, fields flattened under the shop's own words.

Four shapes of JSON and one of XML. A page is decoded by a schema of its envelope only; what a shop names as it
likes stays text until it is asked for. A page that can't be decoded is one row with `failed`, and an item
without an id is none. Nothing is chosen or checked here: barcodes, brands and prices go on as they were written.

Records: page_id, external_id, title, brand, model, codes (what may be barcodes), mpn, price, currency, availability, attributes (map), failed.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "brand", "model", "codes", "mpn", "price", "currency", "availability", "attributes")
_MAP = "map<string,string>"


def text(x: Column) -> Column:
    """A value as text without space around it; of a list the first one."""
    first = F.when(F.startswith(x, F.lit("[")), F.get(F.from_json(x, "array<string>"), F.lit(0))).otherwise(x)
    return F.nullif(F.trim(first), F.lit(""))


def joined(x: Column) -> Column:
    """A value as text, those of a list one after the other."""
    every = F.array_join(F.transform(F.from_json(x, "array<string>"), lambda v: F.trim(v)), "; ")
    return F.nullif(F.when(F.startswith(x, F.lit("[")), every).otherwise(F.trim(x)), F.lit(""))


def named(entries: Column, every: bool) -> Column:
    """A map of an array of (name, value) without empty ones; of one name the last value, or with `every` its different values one after the other."""
    kept = F.filter(entries, lambda e: e["name"].isNotNull() & (e["name"] != "") & e["value"].isNotNull() & (e["value"] != ""))
    names = F.array_distinct(F.transform(kept, lambda e: e["name"]))
    of = lambda n: F.transform(F.filter(kept, lambda e: e["name"] == n), lambda e: e["value"])
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.array_distinct(of(n)), "; ") if every else F.element_at(of(n), -1)))


def _entry(name: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), value.alias("value"))


def _records(pages: DataFrame, envelope: str, items: str, record) -> DataFrame:
    """pages (page_id, payload) decoded by a schema; `items` is the path of the list in it, record(item, page) the columns of a record; a page without the list has failed."""
    page = pages.select("page_id", F.from_json("payload", f"{envelope}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("page"))
    whole = F.col("page._corrupt").isNull() & F.col(f"page.{items}").isNotNull()
    bad = page.where(~F.coalesce(whole, F.lit(False))).select("page_id", F.lit("not_decoded").alias("failed"))
    item = page.where(whole).select("page_id", "page", F.explode(f"page.{items}").alias("item"))
    rows = record(item).where("external_id is not null and external_id <> ''").withColumn("failed", F.lit(None).cast("string"))
    return rows.unionByName(bad, allowMissingColumns=True).select("page_id", "external_id", *FIELDS, "failed")


def _money(x: Column) -> Column:
    """Two places, halves up; a price may have a float's tail."""
    return F.round(x.try_cast("decimal(30,10)"), 2).try_cast("decimal(12,2)")


def faceted(pages: DataFrame) -> DataFrame:
    """`items` whose `attribute_*` fields are numbered, their names told once a page in `_facet_names`."""

    def record(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("f", F.from_json("item", _MAP))
        own = F.filter(F.map_entries("f"), lambda e: e["key"].startswith("attribute_"))
        entries = F.transform(own, lambda e: _entry(F.coalesce(F.col("page._facet_names")[e["key"]], e["key"]), joined(e["value"])))
        f = lambda k: F.col("f")[k]
        return rows.select(
            "page_id", text(f("id")).alias("external_id"), text(f("title")).alias("title"), text(f("razotaji")).alias("brand"), F.lit(None).cast("string").alias("model"), F.array_compact(F.array(text(f("ean_code")))).alias("codes"), F.lit(None).cast("string").alias("mpn"),
            _money(f("item_price")).alias("price"), F.lit("EUR").alias("currency"), f("in_stock").alias("availability"), named(entries, False).alias("attributes"),
        )

    return _records(pages, f"items array<string>, _facet_names {_MAP}", "items", record)


def encoded(pages: DataFrame, column: str = "attributes_lv_", language: str = "lv") -> DataFrame:
    """`items` with a list of attributes in several languages, and more of them in fields whose names end in the attribute's name in base64; the list wins."""
    nested = f"array<struct<name: {_MAP}, value: {_MAP}, unit: {_MAP}>>"

    def record(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("f", F.from_json("item", _MAP))
        f = lambda k: F.col("f")[k]
        listed = F.coalesce(F.from_json(f("attributes"), nested), F.array().cast(nested))
        valued = F.transform(listed, lambda a: _entry(F.trim(a["name"][language]), F.trim(F.concat_ws(" ", F.trim(a["value"][language]), F.trim(a["unit"][language])))))
        rows = rows.withColumn("listed", named(F.filter(valued, lambda e: e["value"] != ""), True))
        fields = F.filter(F.map_entries("f"), lambda e: e["key"].startswith(column))
        padded = lambda k: F.concat(F.substring_index(k, "_", -1), F.repeat(F.lit("="), F.pmod(-F.length(F.substring_index(k, "_", -1)), F.lit(4))))
        spelled = F.transform(fields, lambda e: _entry(F.trim(F.try_to_binary(padded(e["key"]), F.lit("base64")).cast("string")), joined(e["value"])))
        rest = named(F.filter(spelled, lambda e: e["name"].isNotNull() & ~F.map_contains_key("listed", e["name"])), False)
        return rows.select(
            "page_id", text(f("id")).alias("external_id"), text(f(f"title_{language}")).alias("title"), text(f(f"brand_{language}")).alias("brand"), F.lit(None).cast("string").alias("model"), F.coalesce(F.from_json(f("alternative_codes"), "array<string>"), F.array().cast("array<string>")).alias("codes"),
            text(f("article_number")).alias("mpn"), _money(f("price_default")).alias("price"), F.lit("EUR").alias("currency"), f("in_stock").alias("availability"), F.map_concat("listed", rest).alias("attributes"),
        )

    return _records(pages, "items array<string>", "items", record)


_PRODUCT = "name: string, sku: string, url_key: string, stock_status: string, price_range: struct<minimum_price: struct<final_price: struct<value: string, currency: string>>>"


def configurable(pages: DataFrame) -> DataFrame:
    """A GraphQL list of families: each variant is a record with the family's name as its model and its options as attributes; a family without variants is its own record."""
    member = f"struct<{_PRODUCT}>"
    variant = f"struct<product: {member}, attributes: array<struct<code: string, label: string>>>"
    envelope = f"data struct<products: struct<items: array<struct<{_PRODUCT}, variants: array<{variant}>>>>>"

    def record(rows: DataFrame) -> DataFrame:
        own = F.struct(F.struct(*[F.col(f"item.{c}").alias(c) for c in ("name", "sku", "url_key", "stock_status", "price_range")]).alias("product"), F.array().cast("array<struct<code:string,label:string>>").alias("attributes"))
        each = rows.select("page_id", F.trim("item.name").alias("family"), F.explode(F.when(F.size("item.variants") > 0, F.col("item.variants")).otherwise(F.array(own))).alias("v"))
        price = F.col("v.product.price_range.minimum_price.final_price")
        sku = F.trim("v.product.sku")
        entries = F.transform("v.attributes", lambda o: _entry(o["code"], F.trim(o["label"])))
        return each.select(
            "page_id", sku.alias("external_id"), F.trim("v.product.name").alias("title"), F.lit(None).cast("string").alias("brand"), F.col("family").alias("model"), F.array().cast("array<string>").alias("codes"), sku.alias("mpn"),
            _money(price["value"]).alias("price"), F.coalesce(price["currency"], F.lit("EUR")).alias("currency"), F.trim("v.product.stock_status").alias("availability"), named(entries, False).alias("attributes"),
        )

    return _records(pages, envelope, "data.products.items", record)


def coded(pages: DataFrame, brand: str = "manufacturer", barcode: str = "ean", part: str = "mpn", stock: str = "availability") -> DataFrame:
    """A GraphQL list of products whose attributes are a list of codes with a value or chosen options; some codes are the record's own fields."""
    custom = "custom_attributesV2: struct<items: array<struct<code: string, value: string, selected_options: array<struct<label: string>>>>>"
    envelope = f"data struct<products: struct<items: array<struct<{_PRODUCT}, {custom}>>>>"

    def record(rows: DataFrame) -> DataFrame:
        said = F.transform(F.coalesce("item.custom_attributesV2.items", F.array()), lambda a: _entry(a["code"], F.coalesce(text(a["value"]), F.array_join(F.filter(F.transform(a["selected_options"], lambda o: F.trim(o["label"])), lambda x: x != ""), "; "))))
        rows = rows.withColumn("a", named(said, False))
        price = F.col("item.price_range.minimum_price.final_price")
        rest = F.map_filter("a", lambda k, _: ~k.isin(brand, barcode, part, stock))
        a = lambda k: F.col("a")[k]
        return rows.select(
            "page_id", F.trim("item.sku").alias("external_id"), F.trim("item.name").alias("title"), a(brand).alias("brand"), F.lit(None).cast("string").alias("model"), F.array_compact(F.array(a(barcode))).alias("codes"), a(part).alias("mpn"),
            _money(price["value"]).alias("price"), F.coalesce(price["currency"], F.lit("EUR")).alias("currency"), a(stock).alias("availability"), rest.alias("attributes"),
        )

    return _records(pages, envelope, "data.products.items", record)


def exported(pages: DataFrame, section: str) -> DataFrame:
    """An XML export of all sections of a shop, of which those whose name begins with `section` count: the maker stands behind the section's last separator, the id at the end of the link. Tags in texts go."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    fields = ("name", "link", "category_full", "price", "in_stock")
    schema = f"item array<struct<{', '.join(f'{c}: string' for c in fields)}>>, _corrupt string"
    page = pages.select("page_id", F.from_xml("payload", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("page"))
    whole = F.coalesce(F.col("page._corrupt").isNull() & F.col("page.item").isNotNull(), F.lit(False))
    bad = page.where(~whole).select("page_id", F.lit("not_decoded").alias("failed"))
    rows = page.where(whole).select("page_id", F.explode("page.item").alias("i")).withColumn("section", plain(F.col("i.category_full"))).withColumn("title", plain(F.col("i.name"))).where(F.col("section").startswith(section))
    none = F.lit(None).cast("string")
    rows = rows.select(
        "page_id", F.nullif(F.regexp_extract("i.link", r"([0-9]+)/?$", 1), F.lit("")).alias("external_id"), "title", F.trim(F.element_at(F.split("section", "/"), -1)).alias("brand"), none.alias("model"), F.array().cast("array<string>").alias("codes"), none.alias("mpn"),
        _money(F.trim("i.price")).alias("price"), F.lit("EUR").alias("currency"), F.trim("i.in_stock").alias("availability"), F.create_map().cast(_MAP).alias("attributes"),
    )
    return rows.where("external_id is not null").withColumn("failed", none).unionByName(bad, allowMissingColumns=True).select("page_id", "external_id", *FIELDS, "failed")
