"""Windowed, sessionised, deduplicated and joined event streams.

The same expressions run on a batch and on a stream; event times are cast from
TIMESTAMP_NTZ, which watermarks don't take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the event files of a folder."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` for each window, sliding if ``slide`` is given."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = events.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    counts = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """First of equal keys; on a stream, within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def joined(clicks: DataFrame, buys: DataFrame, within: str = "2 hours") -> DataFrame:
    """Purchases of a user within a time after a click; state is bounded by both watermarks."""
    a, b = clicks.alias("a"), buys.alias("b")
    on = F.expr(f"a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL {within}")
    return a.join(b, on).select(F.col("a.event_id").alias("click"), F.col("b.event_id").alias("purchase"))


def running_counts(events: DataFrame) -> DataFrame:
    """Events of each user so far, by a stateful operator."""
    import pandas as pd

    def count(key, batches, state):
        n = state.get[0] if state.exists else 0
        for b in batches:
            n += len(b)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(count, "user_id long, n long", "n long", "update", "NoTimeout")


def run_once(df: DataFrame, path: str, mode: str) -> DataFrame:
    """Drain a stream into Parquet files under ``path`` and return the result.

    Every micro-batch writes a folder of its own and writes it anew if it is
    run again. ``append`` and ``update`` return the rows of all batches, with
    ``batch``; ``complete`` returns the last batch.
    """
    spark, schema = df.sparkSession, df.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    batches = (q.lastProgress or {}).get("batchId", -1) if q.lastProgress is not None else -1
    if batches < 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out")
    if mode != "complete":
        return rows
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in columns])
