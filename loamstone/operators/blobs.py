"""Content-addressed files: a history of (path, ts, hash) and each content once under its hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.functions.names import contains_ignoring_case
from loamstone.operators.chains import as_of, changes, truncate


def hashed(files: DataFrame, content: str = "content") -> DataFrame:
    """files with the SHA-256 of their content."""
    return files.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256))


def history(files: DataFrame, content: str = "content") -> DataFrame:
    """path, ts, hash: an entry for each time that a file's content changes (A, B, A are three entries)."""
    return changes(hashed(files, content).select("path", "ts", "hash"), ["path"], ["hash"])


def blobs(files: DataFrame, content: str = "content") -> DataFrame:
    """hash, content: each content once."""
    return hashed(files, content).groupBy("hash").agg(F.first(content).alias(content))


def files_as_of(entries: DataFrame, at: int, path_part: str | None = None) -> DataFrame:
    """path, hash at `at`; files that had no entry yet are absent. path_part filters by a part of the path, in any case."""
    if path_part:
        entries = entries.filter(contains_ignoring_case("path", F.lit(path_part)))
    return as_of(entries, ["path"], ["hash"], at)


def restored(entries: DataFrame, store: DataFrame, at: int, path_part: str | None = None) -> DataFrame:
    """path, hash, content at `at`."""
    return files_as_of(entries, at, path_part).join(store, "hash")


def reference_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("hash").agg(F.count(F.lit(1)).alias("refs"))


def orphans(store: DataFrame, entries: DataFrame) -> DataFrame:
    """Blobs that no entry refers to."""
    return store.join(entries, "hash", "left_anti")


def missing(store: DataFrame, entries: DataFrame) -> DataFrame:
    """hash, refs of blobs that entries refer to and the store lacks."""
    return reference_counts(entries).join(store, "hash", "left_anti")


def collected(store: DataFrame, entries: DataFrame) -> DataFrame:
    """The store without orphans."""
    return store.join(entries, "hash", "left_semi")


def prune(entries: DataFrame, store: DataFrame, cutoff: int, floor: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries and store after dropping entries older than the cutoff (never a file's newest) and then orphans."""
    kept = truncate(entries, ["path"], cutoff, floor=floor)
    return kept, collected(store, kept)


def totals(entries: DataFrame, store: DataFrame, content: str = "content") -> DataFrame:
    """One row: tracked_files, entries, oldest_ts, newest_ts, blobs, blob_bytes."""
    own = entries.agg(F.countDistinct("path").alias("tracked_files"), F.count(F.lit(1)).alias("entries"), F.min("ts").alias("oldest_ts"), F.max("ts").alias("newest_ts"))
    held = store.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).cast("long").alias("blob_bytes"))
    return own.crossJoin(held)  # one row each


def diff_files(entries: DataFrame, older: int, newer: int) -> DataFrame:
    """path, old_hash, new_hash of files whose content differs between two times (null: absent)."""
    old, new = (F.max_by("hash", F.when(F.col("ts") <= t, F.col("ts"))) for t in sorted((older, newer)))
    held = [F.when(F.min("ts") <= t, h) for t, h in zip(sorted((older, newer)), (old, new), strict=True)]
    return entries.groupBy("path").agg(held[0].alias("old_hash"), held[1].alias("new_hash")).filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))


def latest_entries(entries: DataFrame) -> DataFrame:
    w = W.partitionBy("path").orderBy(F.col("ts").desc())
    return entries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
