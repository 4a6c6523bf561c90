"""Streaming ingest: a stateful change gate that keeps each key's newest time and value."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamstone.plans.tables import micros


def stream_changes(feed: DataFrame, key: str, value: str, key_type: str = "long", value_type: str = "string") -> DataFrame:
    """Of a streaming feed (key, ts, value) the rows that are newer than the key's newest and change its value.

    State is one time and one value per key. Inside a micro-batch a key's rows are taken in order of time; rows that
    arrive with a time not above the newest seen are rejected, as an insertion at or before the head is.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ts, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        kept = []
        for row in rows.itertuples(index=False):
            ts, now = int(row.ts), getattr(row, value)
            if last_ts is None or ts > last_ts:
                if last_ts is None or now != last:
                    kept.append((keys[0], ts, now))
                    last = now
                last_ts = ts
        state.update((last_ts, last))
        yield pd.DataFrame(kept, columns=[key, "ts", value])

    return feed.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, ts long, {value} {value_type}", f"last_ts long, last {value_type}", "append", GroupStateTimeout.NoTimeout)


def shared_root(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loamstone-stream-")
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def replayed_changes(spark: SparkSession, path: str) -> DataFrame:
    """All events of a Parquet table (a file or folder) through the streaming gate, as stored by the sink."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path if _is_folder(spark, path) else f"{folder}/{name[:-1]}[{name[-1]}]")
    feed = source.select("user_id", micros("ts").alias("ts"), "event_type")
    root = shared_root(spark)
    running = stream_changes(feed, "user_id", "event_type").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("user_id long, ts long, event_type string").parquet(f"{root}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_counts(feed: DataFrame, late: str = "10 minutes", width: str = "5 minutes", by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts per window of a streaming or static feed with late rows up to `late`."""
    return feed.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", by, "n")


def scheduled_ingest(feed: DataFrame, engine, checkpoint: str, interval: str | None = "60 minutes"):
    """Starts a query that ingests each micro-batch of sections (CHUNK, kind, section, atoms, ts), one time after the other.

    interval: time between batches; None takes what is there, once. Batches run one at a time, and one that fails is run
    again from the checkpoint. A batch that was committed before a failure is rejected the second time as not newer.
    """

    def step(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates().persist()  # rows may be delivered again
        for row in batch.select("ts").filter("ts is not null").distinct().orderBy("ts").collect():
            engine.ingest(row["ts"], batch.filter(F.col("ts") == row["ts"]).drop("ts"))
        batch.unpersist()

    writer = feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
