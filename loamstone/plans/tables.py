"""The supplied tables in the shapes that the engine's operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EARLY, LATE = 1_704_153_600_000_000, 1_705_708_800_000_000  # 2024-01-02 and 2024-01-20 in microseconds
NOW = 1_706_745_600  # 2024-02-01 in seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, event_type, value."""
    return table(spark, sf_dir, "events").select("user_id", micros("ts").alias("ts"), "event_type", "value")


def atoms():
    """Four small integers of an event; neighbouring events share some of them."""
    return F.array(F.length("event_type"), F.floor(F.col("value") % 3).cast("int"), F.floor(F.col("ts") / 86_400_000_000 % 7).cast("int"), F.lit(1))


ATOMS = "[length(event_type)::INT, floor(value % 3)::INT, floor((ts // 86400000000) % 7)::INT, 1]"


def array_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, atoms: histories of width 4, changes only."""
    from loamstone.operators.chains import changes

    return changes(feed(spark, sf_dir).select("user_id", "ts", atoms().alias("atoms")), ["user_id"], ["atoms"])


def joined(array: str):
    """An integer array as text, '-' for null elements."""
    return F.array_join(F.transform(array, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, ts, content: documents as versions of 200 files."""
    doc = table(spark, sf_dir, "documents").select("doc_id", "text")
    return doc.select(F.concat(F.lit("Notes/f"), (F.col("doc_id") % 200).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".TXT").otherwise(".md")).alias("path"), F.col("doc_id").alias("ts"), F.col("text").alias("content"))


FILES = "(SELECT 'Notes/f' || (doc_id % 200) || CASE WHEN doc_id % 3 = 0 THEN '.TXT' ELSE '.md' END AS path, doc_id AS ts, text AS content FROM documents)"


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts in seconds: order dates."""
    return table(spark, sf_dir, "orders").select(F.floor(micros("o_orderdate") / 1_000_000).cast("long").alias("ts"))


def ship_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.floor(micros("l_shipdate") / 1_000_000).cast("long").alias("ts"))


def daily_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts (day), item, n: per user and day a map from event type to how often."""
    day = F.floor(F.col("ts") / 86_400_000_000).cast("long")
    return feed(spark, sf_dir).groupBy("user_id", day.alias("ts"), F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, atoms: embeddings as integers of 0..511."""
    level = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 256), F.lit(0)), F.lit(511)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", level.alias("atoms"))


QUANTISED = "(SELECT vec_id, label, list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 1) * 256), 0), 511)::INT) AS atoms FROM embeddings)"


def registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two epochs of names: nations by key, and the same without one, in order of the name."""
    nation = table(spark, sf_dir, "nation")
    from pyspark.sql import Window

    old = nation.select(F.lit("a").alias("epoch"), F.lit("block").alias("kind"), F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n_name")) - 1
    new = nation.filter("n_nationkey != 7").select(F.lit("b").alias("epoch"), F.lit("block").alias("kind"), rank.cast("int").alias("id"), F.col("n_name").alias("name"))
    return old, new


def worlds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """live and restored: customers as chunks (cx, cz, content, status), the second with losses, changes and swaps."""
    key = F.col("c_custkey")
    live = table(spark, sf_dir, "customer").select((key % 40).alias("cx"), F.floor(key / 40).cast("long").alias("cz"), F.concat_ws("|", "c_name", "c_mktsegment").alias("content"), F.when(key % 5 == 0, "minecraft:noise").otherwise("minecraft:full").alias("status"), key.alias("k"))
    kept = live.filter("k % 7 != 0")
    changed = F.when(F.col("k") % 11 == 0, F.concat(F.col("content"), F.lit("!"))).otherwise(F.col("content"))
    moved = kept.select((F.col("cx") + F.when(F.col("k") % 13 == 0, 100).otherwise(0)).alias("cx"), "cz", changed.alias("content"), "status", "k")
    neighbour = live.select((F.col("cx") - 1).alias("cx"), "cz", F.col("content").alias("_next"))
    swapped = moved.join(neighbour, ["cx", "cz"], "left").withColumn("content", F.when((F.col("k") % 17 == 0) & F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("content"))).drop("_next")
    return live, swapped
