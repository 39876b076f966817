"""Extensions for event streams: windows, sessions, late data and the latest state; each works on a stream and on a batch.

Event time has to be a TIMESTAMP, so times without a zone are cast in the session's zone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.sources.scratch import shared_dir

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("completed", "failed", "cancelled")


def stream_of(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """A table as a stream of its files; a pattern is given, as a path has to be a folder but the table may be one file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def timed(events: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Event time as TIMESTAMP; with ``late``, later rows than that may be dropped."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def windowed(events: DataFrame, width: str, slide: str | None = None, by: tuple[str, ...] = ("event_type",), ts: str = "ts", value: str = "value") -> DataFrame:
    """(start, by..., n, total) of tumbling or sliding windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str = "user_id", ts: str = "ts") -> DataFrame:
    """(by, start, n): runs of events less than a gap apart."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def latest_state(events: DataFrame, key: str = "user_id", state: str = "event_type", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, state, seen): what polling a status table would show."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(ts, tie)).alias(state), F.max(ts).alias("seen"))


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each event once, while its duplicates aren't later than the watermark; over a batch, once at all."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def idle(states: DataFrame, as_of: str, timeout_seconds: int, state: str = "event_type", seen: str = "seen") -> DataFrame:
    """States that aren't terminal and haven't changed for so long."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(seen).cast("timestamp"))
    return states.where(~F.col(state).isin(*TERMINAL) & (age > timeout_seconds))


def bad_transitions(events: DataFrame, allowed: set[tuple[str, str]], key: str = "user_id", state: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events whose state may not follow the one before."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    pair = F.concat_ws(">", "before", state)
    return events.withColumn("before", before).where(F.col("before").isNotNull() & ~pair.isin(*[f"{a}>{b}" for a, b in sorted(allowed)]))


def drained(stream: DataFrame, mode: str = "complete", base: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, then reads what it has written to the shared folder.

    With the ``base`` of an earlier run, the stream goes on from its checkpoint there, and what both have written is read.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")  # a batch that is run again replaces itself

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # state on the executors' disks, which stateful operators with timers need
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    numbered = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(numbered).parquet(f"{base}/out").drop("batch")
