"""Restore points, listings and retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400
NO_CUTOFF = -(1 << 63)


@dataclass(frozen=True)
class RetentionPolicy:
    """Limits on age and on the number of restore points; a value below 1 switches that limit off."""

    days: int = 0
    snapshots: int = 0

    @classmethod
    def of_days(cls, days: int) -> RetentionPolicy:
        return cls(days, 0)

    @classmethod
    def of_snapshots(cls, snapshots: int) -> RetentionPolicy:
        return cls(0, snapshots)

    @property
    def has_age_limit(self) -> bool:
        return self.days >= 1

    @property
    def has_snapshot_limit(self) -> bool:
        return self.snapshots >= 1

    @property
    def is_unbounded(self) -> bool:
        return not (self.has_age_limit or self.has_snapshot_limit)

    def describe(self) -> str:
        age = f"older than {self.days} day(s)" if self.has_age_limit else "no age limit"
        return age + (f", keep the history of the last {self.snapshots} snapshot(s)" if self.has_snapshot_limit else "")


def restore_points(*histories: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct times of all histories."""
    out = histories[0].select(ts)
    for h in histories[1:]:
        out = out.unionByName(h.select(ts))
    return out.distinct()


def points_per_key(history: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return history.groupBy(*keys).agg(F.array_sort(F.collect_set(ts)).alias("points"))


def bounds(points: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: oldest_ts, newest_ts (null without points)."""
    return points.agg(F.min(ts).alias("oldest_ts"), F.max(ts).alias("newest_ts"))


def listing(points: DataFrame, now: int, min_days: int = 0, max_days: int = 0, skip: int = 0, keep: int = 50, ts: str = "ts") -> DataFrame:
    """Distinct times of an inclusive range of ages, newest first, a page of them; the future is never listed."""
    age = F.lit(now) - F.col(ts)
    low = age >= max(0, min_days) * DAY
    inside = low & (age <= max_days * DAY) if max_days > 0 else low
    return points.select(ts).distinct().filter(inside).orderBy(F.col(ts).desc()).offset(max(0, skip)).limit(max(0, keep))


def listing_since(points: DataFrame, now: int, days: int = 0, ts: str = "ts") -> DataFrame:
    """The command line's list: all times of the last `days` days (all if below 1), newest first, the future too."""
    found = points.select(ts).distinct()
    return (found.filter(F.col(ts) >= now - days * DAY) if days > 0 else found).orderBy(F.col(ts).desc())


def nth_newest(points: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """One row: the n-th newest time, NO_CUTOFF when there are fewer."""
    top = points.select(ts).distinct().orderBy(F.col(ts).desc()).limit(n)
    return top.agg(F.when(F.count(F.lit(1)) >= n, F.min(ts)).otherwise(F.lit(NO_CUTOFF)).alias("cutoff"))


def cutoff(points: DataFrame, policy: RetentionPolicy, now: int, ts: str = "ts") -> DataFrame:
    """One row: the stricter of both limits."""
    by_age = now - policy.days * DAY if policy.has_age_limit else NO_CUTOFF
    if not policy.has_snapshot_limit:
        return points.sparkSession.range(1).select(F.lit(by_age).cast("long").alias("cutoff"))
    return nth_newest(points, policy.snapshots, ts).select(F.greatest("cutoff", F.lit(by_age)).cast("long").alias("cutoff"))


def cutoff_value(points: DataFrame, policy: RetentionPolicy, now: int, ts: str = "ts") -> int:
    return cutoff(points, policy, now, ts).first()["cutoff"]


def removals(history: DataFrame, keys: list[str], at: int, ts: str = "ts") -> DataFrame:
    """Dry run: keys and how many entries pruning at the cutoff would remove."""
    from pyspark.sql import Window as W

    newest = F.max(ts).over(W.partitionBy(*keys))
    return history.withColumn("_newest", newest).filter((F.col(ts) < at) & (F.col(ts) < F.col("_newest"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("removed"))
