"""Histories of keyed maps: put and erase changes per item, as exploded rows.

A snapshot of one key is one row on its way through a window, so it should fit a row (the items of one chunk do).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _versions(snapshots: DataFrame, keys: list[str], item: str, value: str, ts: str) -> DataFrame:
    """keys, ts, _m: each snapshot as one sorted array of items."""
    return snapshots.groupBy(*keys, ts).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("item"), F.col(value).alias("value")))).alias("_m"))


def map_changes(snapshots: DataFrame, keys: list[str], item: str, value: str, ts: str = "ts") -> DataFrame:
    """keys, ts, item, value of the snapshots whose content differs from the snapshot before; unchanged ones are no versions."""
    before = F.lag("_m").over(W.partitionBy(*keys).orderBy(ts))
    kept = _versions(snapshots, keys, item, value, ts).withColumn("_p", before).filter(F.col("_p").isNull() | (F.col("_p") != F.col("_m")))
    return kept.select(*keys, ts, F.explode("_m").alias("_e")).select(*keys, ts, F.col("_e.item").alias(item), F.col("_e.value").alias(value))


def map_deltas(snapshots: DataFrame, keys: list[str], item: str, value: str, ts: str = "ts") -> DataFrame:
    """Reverse deltas of full, differing snapshots (see map_changes; one row per item and snapshot): keys, ts, item, op, value.

    The newest snapshot is kept as puts. An older one holds, for each item that differs from the next newer snapshot, a put
    of its old value, or an erase if it was not there yet.
    """
    newer = F.lead("_m").over(W.partitionBy(*keys).orderBy(ts))
    both = _versions(snapshots, keys, item, value, ts).withColumn("_n", newer)

    def entry(op: str, name, held):
        return F.struct(name.alias("item"), F.lit(op).alias("op"), held.cast(snapshots.schema[value].dataType).alias("value"))

    kept = F.when(F.col("_n").isNull(), F.col("_m")).otherwise(F.array_except("_m", "_n"))
    items = [F.transform(c, lambda e: e["item"]) for c in ("_n", "_m")]
    erased = F.transform(F.array_except(*items), lambda x: entry("erase", x, F.lit(None)))
    changes = F.transform(kept, lambda e: entry("put", e["item"], e["value"]))
    listed = F.when(F.col("_n").isNull(), changes).otherwise(F.concat(changes, erased))
    exploded = both.select(*keys, ts, F.explode(listed).alias("_e"))
    return exploded.select(*keys, ts, F.col("_e.item").alias(item), F.col("_e.op").alias("op"), F.col("_e.value").alias(value))


def map_as_of(deltas: DataFrame, keys: list[str], item: str, value: str, at: int, ts: str = "ts") -> DataFrame:
    """keys, item, value at `at` from reverse deltas; before the first snapshot the first one counts.

    An item's state is its oldest change at or after the snapshot in force, as an older entry describes older content.
    """
    in_force = deltas.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(ts) <= at, F.col(ts))), F.min(ts)).alias("_from"))
    valid = deltas.join(in_force, keys).filter(F.col(ts) >= F.col("_from"))
    oldest = valid.groupBy(*keys, item).agg(F.min_by("op", ts).alias("op"), F.min_by(value, ts).alias(value))
    return oldest.filter("op = 'put'").drop("op")


def map_nearest(deltas: DataFrame, keys: list[str], at: int, ts: str = "ts") -> DataFrame:
    from loamstone.operators.chains import nearest_ts

    return nearest_ts(deltas.select(*keys, ts), keys, at, ts)


def map_truncate(deltas: DataFrame, keys: list[str], cutoff: int, ts: str = "ts") -> DataFrame:
    """Whole snapshots at or after the cutoff, and the newest of each key."""
    head = F.max(ts).over(W.partitionBy(*keys))
    return deltas.withColumn("_head", head).filter((F.col(ts) >= cutoff) | (F.col(ts) == F.col("_head"))).drop("_head")


def map_checkpoint(deltas: DataFrame, keys: list[str], item: str, value: str, at: int, ts: str = "ts") -> DataFrame:
    """deltas with the full content of the snapshot in force at `at` in place of its delta."""
    in_force = deltas.filter(F.col(ts) <= at).groupBy(*keys).agg(F.max(ts).alias(ts))
    full = map_as_of(deltas, keys, item, value, at, ts).join(in_force, keys).withColumn("op", F.lit("put"))
    erased = deltas.join(in_force, [*keys, ts], "left_semi").filter("op = 'erase'")
    rest = deltas.join(in_force, [*keys, ts], "left_anti")
    return rest.unionByName(full.select(*deltas.columns)).unionByName(erased.select(*deltas.columns))
