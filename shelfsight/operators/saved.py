"""Intermediate tables, written where driver and executors both see them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the rows of a table that is sent to all tasks may take in memory, in bytes.
SENT = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _written(df: DataFrame) -> str:
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return at


def saved(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends here, and a lost executor loses nothing of it."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


def _bytes(df: DataFrame) -> Column:
    """About what a row takes in memory."""
    size = F.lit(16 + 8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + 4 * F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
    return size


def to_join(written: DataFrame) -> DataFrame:
    """A written table as the right side of a join: merged with the left one by a shuffle if its rows take more than SENT; otherwise Spark may send it to all tasks.

    Spark itself goes by the size of the files, where equal values are kept once: they may be a small part of what the rows take in the driver's memory.
    """
    size = written.agg(F.sum(_bytes(written))).first()[0] or 0
    return written if size <= SENT else written.hint("merge")


def met(rows: DataFrame, on: Column, number: str, answers: DataFrame) -> DataFrame:
    """rows with the columns of `answers` (a written table; _on, once each) whose _on is `on`, or null. Rows without it meet nothing, each at a place of its own by its `number`.

    They meet by a hash of the text and then by the text itself: a table keyed by a number takes what its rows do where it is sent to all tasks, one keyed by a text a whole page of memory at least (up to 64 MB) and its keys twice.
    """
    asked = rows.withColumn("_asked", on).withColumn("_at", F.when(F.col("_asked").isNull(), F.col(number).cast("long")).otherwise(F.xxhash64("_asked")))
    same = (F.col("_at") == F.xxhash64("_on")) & F.col("_asked").between(F.col("_on"), F.col("_on"))
    return asked.join(to_join(answers), same, "left").drop("_asked", "_at", "_on")


_made: dict[tuple, tuple] = {}


def saved_once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a written table, the one of this key that this application has written if it is still there; the tables it is made of must not change meanwhile."""
    key = (spark.sparkContext.applicationId, *key)
    schema, at = _made.get(key, (None, None))
    if at is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).parquet(at)
    made = make()
    _made[key] = made.schema, _written(made)
    return spark.read.schema(made.schema).parquet(_made[key][1])
