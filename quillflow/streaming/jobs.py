"""Structured Streaming forms of the stateful behaviours: quotas, rate limits, sessions, incremental postings, upserts, latency windows.  Events: (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bm25 import postings

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_quota(stream: DataFrame, cap: int, late: str = "1 day") -> DataFrame:
    """(day, used, allowed) by UTC day."""
    n = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("used"))
    return n.select(F.to_date("w.start").alias("day"), "used", F.least("used", F.lit(cap)).alias("allowed"))


def rate_limit(stream: DataFrame, cap: int, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, used, refused) by user and fixed window."""
    n = stream.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("used"))
    return n.select("user_id", F.col("w.start").alias("start"), "used", F.greatest(F.lit(0), F.col("used") - cap).alias("refused"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n) of visits without a longer pause than gap."""
    n = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latency_windows(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(event_type, start, n, total, most) by type and window."""
    n = stream.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return n.select("event_type", F.col("w.start").alias("start"), "n", "total", "most")


def distinct_events(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without those whose id came before within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def index_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends the postings of arriving documents (doc_id, text) to a table, one folder for each batch: a batch that runs again replaces its own folder."""

    def add(batch: DataFrame, n: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State on the executors' disks: groups are as many as the data has.
STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """What a stream gives after all that is there now, from files beside the checkpoint: executors write them, the driver holds no row.  In complete mode the last batch is the whole result."""
    spark, out = result.sparkSession, f"{checkpoint.rstrip('/')}-result"
    batches: list[str] = []

    def keep(batch: DataFrame, n: int) -> None:
        path = f"{out}/batch={n}"
        batch.write.mode("overwrite").parquet(path)
        batches.append(path)

    before = spark.conf.get(STATE[0])
    spark.conf.set(*STATE)
    try:
        q = result.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STATE[0], before)
    read = batches[-1:] if mode == "complete" else batches
    return spark.read.schema(result.schema).parquet(*read) if read else spark.createDataFrame([], result.schema)
