"""Observations as a stream: each taken in once, however late or often it comes, in batches that overwrite themselves if replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def observed(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of events without repeats of one id within the watermark; later ones are out of the counts below, never out of `ingested`."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def hourly(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and cents of each state by hour, final once the watermark has passed."""
    return observed(stream, late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents"))


def append_new(stream: DataFrame, to: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Each micro-batch goes to a folder of its own number, without rows whose key an earlier batch holds.

    Nothing is dropped for being late: what was taken in is looked up, not remembered for a while.
    A replayed batch is held against the batches before it only, so it gives the same rows again.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(key)
        if number > 0:
            fresh = fresh.join(batch.sparkSession.read.parquet(to).where(F.col("batch") < number).select(*key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, source: str, schema, to: str, checkpoint: str, key: tuple[str, ...] = ("event_id",), files: int = 1) -> DataFrame:
    """All that a folder of event files holds now, taken in as micro-batches of `files` files each."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    append_new(stream, to, checkpoint, list(key)).awaitTermination()
    return spark.read.option("mergeSchema", "false").parquet(to).drop("batch")
