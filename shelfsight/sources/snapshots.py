"""Pages as they were fetched, one file each under source=.../, and reading them again with the decoders as they are now.

A page that no decoder understands is a row with `failed`; its file stays where it is, so a later
decoder can take it. Streams take in so many bytes of files at once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Decoder = Callable[[DataFrame], DataFrame]
#: What a cheap pass wants of a record.
CHEAP = ("external_id", "price", "availability")


def _pages(files: DataFrame) -> DataFrame:
    return files.select("source", F.element_at(F.split("path", "/"), -1).alias("page_id"), F.decode("content", "UTF-8").alias("payload"))


def pages(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """source, page_id (the file's name), payload of the pages in a folder; of one source, only its files are opened."""
    files = spark.read.format("binaryFile").load(folder)
    return _pages(files if source is None else files.where(F.col("source") == source))


def reparsed(stored: DataFrame, decoders: Mapping[str, Decoder]) -> DataFrame:
    """Records of all pages by their source's decoder; pages of a source without one have failed with no_decoder."""
    parts = [decode(stored.where(F.col("source") == source).select("page_id", "payload")).withColumn("source", F.lit(source)) for source, decode in sorted(decoders.items())]
    rest = stored.where(~F.col("source").isin(*decoders)).select("source", "page_id", F.lit("no_decoder").alias("failed"))
    out = None
    for part in [*parts, rest]:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def cheap(records: DataFrame) -> DataFrame:
    """What a pass over listings alone gives: id, price and availability; nothing else of the pages is decoded."""
    return records.where("failed is null").select("source", *CHEAP)


def reparse_stream(spark: SparkSession, folder: str, decoders: Mapping[str, Decoder], to: str, checkpoint: str, size: int = 512_000_000) -> DataFrame:
    """All records of a folder's pages so far, taken in as micro-batches of `size` bytes of files; a batch that is run again replaces itself."""
    schema = "path string, modificationTime timestamp, length long, content binary, source string"

    def write(batch: DataFrame, number: int) -> None:
        reparsed(_pages(batch), decoders).write.mode("overwrite").parquet(f"{to}/batch={number}")

    stream = spark.readStream.format("binaryFile").schema(schema).option("maxBytesPerTrigger", size).load(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(to).drop("batch")
