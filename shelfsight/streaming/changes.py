"""What is new in a stream of observations, held against a state for each listing: contents that it never had, and changes of its price.

The state is a listing's content hashes, its last price and when that was read. A micro-batch costs its own
rows and the state of its listings, whatever has been written before. A state grows with the
different contents of its listing only. A listing's rows of one micro-batch meet in one task, so files a trigger bound it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.unicode import payload_hash

STATE = "at timestamp, id long, priced boolean, cents long, contents array<string>"
CHANGES = "offer_id long, event_id long, obs_at timestamp, kind string, content string, cents long"


def _changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, last, priced, cents, contents = state.get if state.exists else (None, None, False, None, [])
    seen = set(contents)
    rows = pd.concat(list(frames))
    rows = rows.sort_values(["obs_at", "event_id"], kind="stable")
    out: list[tuple] = []
    for event, when, content, value in zip(rows["event_id"], rows["obs_at"], rows["content"], rows["cents"].astype("object").where(rows["cents"].notna(), None)):
        value = None if value is None else int(value)
        if content not in seen:
            seen.add(content)
            out.append((key[0], event, when, "content", content, value))
        if at is not None and (when, event) <= (pd.Timestamp(at), last):
            continue  # history by now: what came after it has been told
        if not priced or value != cents:
            out.append((key[0], event, when, "price", content, value))
        at, last, priced, cents = when, int(event), True, value
    state.update((pd.Timestamp(at).to_pydatetime(), last, priced, cents, sorted(seen)))
    yield pd.DataFrame(out, columns=["offer_id", "event_id", "obs_at", "kind", "content", "cents"]).astype({"cents": "Int64"})


def changes(stream: DataFrame) -> DataFrame:
    """offer_id, event_id, obs_at, kind, content, cents: a row `content` for each content that a listing never had, a row `price` for each price (none is one too) that isn't the one before.

    stream: event_id, offer_id, obs_at, cents, payload (JSON; hashed whatever the order of its keys). A price that comes back is a change. An observation that comes
    after a later one of its listing may bring a new content, but no change of price; one that comes again brings nothing. Rows without event_id or obs_at are left out.
    """
    rows = stream.where("event_id is not null and obs_at is not null").select("offer_id", "event_id", "obs_at", F.col("cents").cast("long").alias("cents"), F.coalesce(payload_hash(F.col("payload")), F.lit("")).alias("content"))
    return rows.groupBy("offer_id").applyInPandasWithState(_changed, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def tracked(spark: SparkSession, source: str, schema, to: str, checkpoint: str, files: int = 1) -> DataFrame:
    """All changes of a folder of observation files so far; each micro-batch of `files` files goes to a folder of its own number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    changes(stream).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CHANGES).parquet(to)
