"""Readings of laptops: what each listing's title and fields say of its axes.

Titles are put together from pieces in the ways in which shops write them; the SQL states what each piece means, and no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import laptops as L
from ..sources.tables import dealt, read

# Each piece: what the title says, what the field says (or nothing), and what both mean (or nothing, where they don't agree).
CHIPS = [
    ("Core Ultra 7 255H", None, "Intel Core Ultra 7 255H"), ("ULT5-226 V", "Intel Core Ultra 5", "Intel Core Ultra 5 226V"), ("Core 7 235U", None, "Intel Core Ultra 7 235U"), ("i7-13620H", "Intel Core i7-13620H", "Intel Core i7-13620H"),
    ("R7-8845HS", "AMD Ryzen 7", "AMD Ryzen 7 8845HS"), ("IPS 7535HS", "AMD Ryzen 5", "AMD Ryzen 5 7535HS"), ("Ultra 7 255H", "AMD Ryzen 7", None), ("Apple M4 Pro", "Apple M4", "Apple M4 Pro"),
    ("Snapdragon X1P-64-100", None, "Qualcomm Snapdragon X1-64-100"), ("i5-1334U", "Intel Core i7-1355U", None), ("258V", None, "Intel Core Ultra 7 258V"), ("Ultra 9 388H", None, "Intel Core Ultra X9 388H"), ("a fast chip", "fast", None),
]
MEMORIES = [
    ("16GB DDR5, 512GB SSD", None, 16384, 524288), ("32 GB/1 TB", "32 GB", 32768, 1048576), ("24GB SSD2TB", "16 GB", None, 2097152), ("16 GB 1 SSD", None, 16384, 1048576), ("8/256GB", "8GB", 8192, 262144), ("512GB SSD + 1TB SSD", "64 GB", 65536, None), ("light", "4 GB + 4 GB", None, None),
]
SCREENS = [("15,6\"", None, 15.6), ("13”", "13.6", 13.6), ("35,56 cm", "14", 14.0), ("14\"", "16", None), ("wide", "39.62 cm", 15.6)]
CARDS = [("RTX 4070 Ti", "RTX 4070", "NVIDIA GeForce RTX 4070 Ti"), ("RTX 500 Ada", None, "NVIDIA RTX 500 Ada"), ("RTX PRO 500", None, "NVIDIA RTX PRO 500"), ("Intel Graphics", None, "integrated"), ("RX 7600S", "GTX 1650", None), ("cool", "Radeon", "integrated")]
KEYBOARDS = [("ENG kbd", None, "english"), ("Nordic Backlit keyboard", "NORDIC (lit)", "nordic"), ("quiet", "GER / ENG", "english+german"), ("ENG kb", "nordic", None), ("quiet", "ENG/XYZ", None)]
NUMBERS = {"258V": "Intel Core Ultra 7 258V"}
WORDS = {"eng": "english", "ger": "german", "nordic": "nordic"}
COLOURS = {"black": "black", "night blue": "blue", "blue": "blue"}
KINDS = ("laptop", "notebook")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _piece(pieces: list[tuple], of: int, step: int) -> Column:
    """What the piece of a row says at place `of`; rows go through all pieces of a kind, `step` rows to each."""
    at = (F.floor(F.col("p_partkey") / step) % len(pieces) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(p[of]).cast("string") for p in pieces]), at)


def laptop_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each laptop's axes and name, from its title and fields; an axis on which they don't agree is empty."""
    field = lambda pieces, step: F.array(_piece(pieces, 1, step))
    title = F.concat_ws(" ", F.lit("Laptop"), "p_brand", "p_name", F.when(F.col("p_partkey") % 3 == 0, "Night Blue"), F.concat(F.lit("- "), _piece(SCREENS, 0, 3), F.lit(", "), _piece(CHIPS, 0, 1), F.lit(", "), _piece(MEMORIES, 0, 2), F.lit(", "), _piece(CARDS, 0, 5), F.lit(", "), _piece(KEYBOARDS, 0, 7)))
    rows = dealt(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")).select("p_partkey", "p_brand", title.alias("title"), *[field(p, s).alias(n) for n, p, s in (("chips", CHIPS, 1), ("memories", MEMORIES, 2), ("screens", SCREENS, 3), ("cards", CARDS, 5), ("boards", KEYBOARDS, 7))])
    t = F.col("title")
    rows = rows.withColumns({"cpu": L.processor(t, F.col("chips"), _map(NUMBERS)), "screen_inch": L.screen(t, F.col("screens"))})
    name = L.without_colour(L.name_in_title(t, F.col("p_brand"), KINDS, F.col("screen_inch")), _map(COLOURS))
    return rows.select(F.col("p_partkey").alias("offer_id"), "cpu", L.memory(t, F.col("memories")).alias("ram_mb"), L.storage(t, F.array().cast("array<string>")).alias("storage_mb"), "screen_inch", L.graphics(t, F.col("cards"), F.col("cpu")).alias("gpu"), L.keyboard(t, F.col("boards"), _map(WORDS)).alias("keyboard"), name.alias("model"))


QUERIES = {"laptop_read": laptop_read}


def _means(pieces: list[tuple], of: int, step: int) -> str:
    said = ["NULL" if p[of] is None else repr(p[of]) for p in pieces]
    return f"([{', '.join(said)}])[CAST(floor(p_partkey / {step}) AS BIGINT) % {len(pieces)} + 1]"


# 7535HS is told by its number alone, and 7600S of a card could be one too: then neither counts
_AMBIGUOUS = f"p_partkey % {len(CHIPS)} = 5 AND CAST(floor(p_partkey / 5) AS BIGINT) % {len(CARDS)} = 4"
ORACLES = {
    "laptop_read": f"""SELECT p_partkey AS offer_id, CASE WHEN NOT ({_AMBIGUOUS}) THEN {_means(CHIPS, 2, 1)} END AS cpu, CAST({_means(MEMORIES, 2, 2)} AS BIGINT) AS ram_mb, CAST({_means(MEMORIES, 3, 2)} AS BIGINT) AS storage_mb, CAST({_means(SCREENS, 2, 3)} AS DOUBLE) AS screen_inch,
  {_means(CARDS, 2, 5)} AS gpu, {_means(KEYBOARDS, 2, 7)} AS keyboard, p_name AS model FROM part""",
}
