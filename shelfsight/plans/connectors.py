"""Shops' payloads decoded: a payload of each shape is written from the parts by SQL that both engines read; what it must give is told from the parts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.payloads import coded, configurable, encoded, exported, faceted
from ..sources.tables import dealt
from .matching import _facts

_ID = "CAST(p_partkey AS STRING)"
_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)"
# every hundredth page breaks off
_BROKEN = "CASE WHEN p_partkey % 100 = 1 THEN substr(payload, 1, 40) ELSE payload END"


def _payload(body: str) -> str:
    return f"SELECT page_id, {_BROKEN} AS payload FROM (SELECT p_partkey, p_partkey AS page_id, {body} AS payload FROM part) x"


FACETED = _payload(
    f"""'{{"total":2,"limit":2,"offset":0,"items":[{{"id":' || {_ID} || ',"title":" ' || p_name || ' ","razotaji":["' || p_brand || '"],"item_price":' || {_PRICE} || '004,"ean_code":"' || lpad({_ID}, 13, '0') || '","in_stock":true,"attribute_string_1":"' || p_type || '","attribute_string_2":["' || p_type || '"," 5G "],"attribute_number_3":' || CAST(p_size AS STRING)
    || ',"attribute_string_9":"","attribute_string_8":[]}},{{"id":null,"title":"no id"}}],"_facet_names":{{"attribute_string_1":"Krāsa","attribute_string_2":"Tīkls"}}}}'"""
)
ENCODED = _payload(
    f"""'{{"items":[{{"id":' || {_ID} || ',"title_lv":"' || p_name || '","brand_lv":["' || p_brand || '"],"article_number":"A-' || {_ID} || '","alternative_codes":["' || {_ID} || '","' || lpad({_ID}, 14, '0') || '"],"price_default":' || {_PRICE} || ',"in_stock":false,"attributes":[{{"name":{{"lv":"Kamera","ru":"x"}},"value":{{"lv":"12"}},"unit":{{"lv":"MP"}}}},{{"name":{{"lv":"Kamera"}},"value":{{"lv":"'
    || CAST(p_size AS STRING) || '"}},"unit":null}},{{"name":{{"lv":"Kamera"}},"value":{{"lv":"12"}},"unit":{{"lv":"MP"}}}},{{"name":{{"lv":"Nekas"}},"value":{{"lv":""}}}}],"attributes_lv_str_TW9kZWxpcw==":["' || p_type || '","b"],"attributes_lv_str_S2FtZXJh":["lost"],"attributes_lv_str_****":["no name"]}}]}}'"""
)
_MEMBER = """{{"name":"{name}","sku":"{sku}","stock_status":"IN_STOCK","price_range":{{"minimum_price":{{"final_price":{{"value":{price},"currency":{currency}}}}}}}}}"""
_TWO = "'" + _MEMBER.format(name="' || p_name || ' ", sku="C-' || " + _ID + " || '-{k}", price="' || " + _PRICE + " || '00043", currency='"EUR"') + "'"
CONFIGURABLE = _payload(
    f"""CASE WHEN p_partkey % 3 = 0 THEN '{{"data":{{"products":{{"items":[' || {_TWO.replace('{k}', '0')} || ']}}}}}}' ELSE '{{"data":{{"products":{{"items":[{{"name":"' || p_type || ' ","sku":"family","variants":[{{"product":' || {_TWO.replace('{k}', '1')} || ',"attributes":[{{"code":"color","label":" Star White "}},{{"code":"storage","label":"256GB"}}]}},{{"product":' || {_TWO.replace('{k}', '2')}
    || ',"attributes":[]}},{{"product":{{"name":"nothing to buy"}}}}]}}]}}}}}}' END"""
)
CODED = _payload(
    f"""'{{"data":{{"products":{{"items":[{{"name":"' || p_name || '","sku":"B-' || {_ID} || '","stock_status":"IN_STOCK","price_range":{{"minimum_price":{{"final_price":{{"value":' || {_PRICE} || '}}}}}},"custom_attributesV2":{{"items":[{{"code":"manufacturer","selected_options":[{{"label":"' || p_brand || '"}}]}},{{"code":"ean","value":"' || lpad({_ID}, 13, '0') || '"}},{{"code":"mpn","value":"M' || {_ID} || '"}},{{"code":"availability","selected_options":[{{"label":"Ir"}}]}},{{"code":"memory","selected_options":[{{"label":"8"}},{{"label":" "}},{{"label":"16"}}]}},{{"code":"type","value":"'
    || p_type || '"}},{{"code":"empty","value":""}}]}}}}]}}}}}}'"""
)
EXPORTED = _payload(
    f"""'<export><item><name>&lt;b&gt;' || p_name || '&lt;/b&gt;  x</name><link>https://shop.example/p/' || {_ID} || '</link><category_full>Phones / ' || CASE WHEN p_partkey % 2 = 0 THEN '&lt;b&gt;' ELSE '' END || p_brand || '</category_full><price> ' || {_PRICE} || ' </price><in_stock>1</in_stock></item><item><name>other</name><link>https://shop.example/p/1</link><category_full>Toys / ' || p_brand
    || '</category_full></item><item><name>no id</name><link>https://shop.example/</link><category_full>Phones / z</category_full></item></export>'"""
)


def _pages(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return dealt(_facts(spark, sf_dir, sql))


def _shown(records: DataFrame) -> DataFrame:
    """Records with their lists and maps as text."""
    told = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return records.select("page_id", "external_id", "title", "brand", "model", F.array_join("codes", ",").alias("codes"), "mpn", "price", "currency", "availability", told.alias("attributes"), "failed")


def decoded_faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose attributes are numbered fields."""
    return _shown(faceted(_pages(spark, sf_dir, FACETED)))


def decoded_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with attributes in several languages, some named in base64."""
    return _shown(encoded(_pages(spark, sf_dir, ENCODED)))


def decoded_configurable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of families, one record for each member."""
    return _shown(configurable(_pages(spark, sf_dir, CONFIGURABLE)))


def decoded_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a list of coded attributes."""
    return _shown(coded(_pages(spark, sf_dir, CODED)))


def decoded_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML exports of all sections, of which one counts."""
    return _shown(exported(_pages(spark, sf_dir, EXPORTED), "Phones"))


QUERIES = {f.__name__: f for f in (decoded_faceted, decoded_encoded, decoded_configurable, decoded_coded, decoded_exported)}


def _told(external_id: str, title: str = "p_name", brand: str = "p_brand", model: str = "NULL", codes: str = "''", mpn: str = "NULL", availability: str = "''", attributes: str = "''", where: str = "true") -> str:
    return f"SELECT p_partkey AS page_id, {external_id} AS external_id, {title} AS title, {brand} AS brand, {model} AS model, {codes} AS codes, {mpn} AS mpn, CAST(p_retailprice AS DECIMAL(12,2)) AS price, 'EUR' AS currency, {availability} AS availability, {attributes} AS attributes, CAST(NULL AS VARCHAR) AS failed FROM part WHERE p_partkey % 100 <> 1 AND {where}"


_LOST = " UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not_decoded' FROM part WHERE p_partkey % 100 = 1"
_SHORT, _LONG = "lpad(CAST(p_partkey AS VARCHAR), 13, '0')", "lpad(CAST(p_partkey AS VARCHAR), 14, '0')"
ORACLES = {
    "decoded_faceted": _told("CAST(p_partkey AS VARCHAR)", codes=_SHORT, availability="'true'", attributes="'Krāsa=' || p_type || '|Tīkls=' || p_type || '; 5G|attribute_number_3=' || p_size") + _LOST,
    "decoded_encoded": _told("CAST(p_partkey AS VARCHAR)", codes=f"p_partkey || ',' || {_LONG}", mpn="'A-' || p_partkey", availability="'false'", attributes="'Kamera=12 MP; ' || p_size || '|Modelis=' || p_type || '; b'") + _LOST,
    "decoded_configurable": " UNION ALL ".join(_told(f"'C-' || p_partkey || '-{k}'", brand="NULL", model=model, mpn=f"'C-' || p_partkey || '-{k}'", availability="'IN_STOCK'", attributes=a, where=w) for k, model, a, w in ((0, "p_name", "''", "p_partkey % 3 = 0"), (1, "p_type", "'color=Star White|storage=256GB'", "p_partkey % 3 <> 0"), (2, "p_type", "''", "p_partkey % 3 <> 0"))) + _LOST,
    "decoded_coded": _told("'B-' || p_partkey", codes=_SHORT, mpn="'M' || p_partkey", availability="'Ir'", attributes="'memory=8; 16|type=' || p_type") + _LOST,
    "decoded_exported": _told("CAST(p_partkey AS VARCHAR)", title="p_name || ' x'", availability="'1'") + _LOST,
}
