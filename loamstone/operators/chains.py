"""Version histories that keep changes only, and what they answer about a point in time.

A history is a table of key columns, `ts` and value columns. Three forms are used:

- states: one row per real change, with the value at that time;
- chain: the newest value in full, each older entry as what differs from the next newer one (null elements: unchanged),
  with `is_full` and, for a checkpoint that shares its time with a delta, an explicit place;
- keyed maps: one row per (key, item) change, with op 'put' or 'erase'.

Every operator groups by the full key, so work spreads over all keys and no step needs one order over a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def changes(feed: DataFrame, keys: list[str], values: list[str], ts: str = "ts") -> DataFrame:
    """Rows of a feed that change the value of their key; of equal times the row of smallest value counts as first."""
    w = W.partitionBy(*keys).orderBy(ts, *values)
    marked = feed.select(*keys, ts, *values, F.row_number().over(w).alias("_n"), *[F.lag(v).over(w).alias(f"_{v}") for v in values])
    differs = F.lit(False)
    for v in values:
        differs |= _distinct_from(F.col(v), F.col(f"_{v}"))
    return marked.filter((F.col("_n") == 1) | differs).select(*keys, ts, *values)


def insert(heads: DataFrame, batch: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """One insertion per key: keys, ts, value, status ('inserted', 'older', 'no_changes'), changes.

    heads: the newest state of each key; changes counts the array elements that differ, all of them for a first state.
    """
    head = heads.select(*keys, F.col(ts).alias("_ts"), F.col(value).alias("_value"))
    both = batch.join(head, keys, "left")
    differing = F.size(F.filter(F.zip_with(value, "_value", lambda a, b: _distinct_from(a, b)), lambda d: d))
    status = F.when(F.col("_ts").isNull(), "inserted").when(F.col(ts) <= F.col("_ts"), "older").when(differing == 0, "no_changes").otherwise("inserted")
    count = F.when(F.col("_ts").isNull(), F.size(value)).when(F.col("status") == "inserted", differing).otherwise(0)
    return both.withColumn("status", status).withColumn("changes", count).select(*keys, ts, value, "status", "changes")


def section_changes(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed atoms per key over all sections; rejected insertions count 0."""
    return outcomes.groupBy(*keys).agg(F.sum(F.coalesce(F.when(F.col("status") == "inserted", F.col("changes")), F.lit(0))).cast("long").alias("changes"))


def reverse_deltas(states: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Chain of a history of array states: the newest in full, others null where the next newer state is equal."""
    w = W.partitionBy(*keys).orderBy(ts)
    newer = F.lead(value).over(w)
    delta = F.zip_with(F.col(value), F.col("_newer"), lambda old, new: F.when(_distinct_from(old, new), old))
    out = states.withColumn("_newer", newer)
    return out.withColumn(value, F.when(F.col("_newer").isNull(), F.col(value)).otherwise(delta)).withColumn("is_full", F.col("_newer").isNull()).drop("_newer")


def checkpoints(states: DataFrame, chain: DataFrame, keys: list[str], value: str, every: int, ts: str = "ts") -> DataFrame:
    """chain with a full copy of every `every`-th state, counted from the oldest; the copy stands for its delta."""
    order = W.partitionBy(*keys).orderBy(ts)
    full = states.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") % every == 0).select(*keys, ts, F.col(value).alias("_full"))
    return chain.join(full, [*keys, ts], "left").select(*keys, ts, F.coalesce("_full", value).alias(value), (F.col("is_full") | F.col("_full").isNotNull()).alias("is_full"))


def checkpointed(states: DataFrame, keys: list[str], value: str, every: int, ts: str = "ts") -> DataFrame:
    """The chain of a history with its checkpoints, in one pass over the states."""
    w = W.partitionBy(*keys).orderBy(ts)
    marked = states.withColumn("_newer", F.lead(value).over(w)).withColumn("is_full", F.lead(ts).over(w).isNull() | (F.row_number().over(w) % every == 0))
    delta = F.zip_with(F.col(value), F.col("_newer"), lambda old, new: F.when(_distinct_from(old, new), old))
    return marked.select(*keys, ts, F.when(F.col("is_full"), F.col(value)).otherwise(delta).alias(value), "is_full")


def deltas_since_full(chain: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Entries behind the newest one and before the next full entry."""
    behind = W.partitionBy(*keys).orderBy(F.col(ts).desc())
    ranked = chain.select(*keys, "is_full", F.row_number().over(behind).alias("_n"), ts)
    older = ranked.filter("_n > 1")
    seen = F.sum(F.col("is_full").cast("int")).over(behind.rowsBetween(W.unboundedPreceding, 0))
    return older.withColumn("_seen", seen).filter("_seen = 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("deltas"))


def folds(chain: DataFrame, keys: list[str], value: str, ats: list[int], ts: str = "ts", clamp: bool = True) -> DataFrame:
    """keys, `value`_0, `value`_1, ...: the array state of each key at each of some times, from one pass over its chain.

    Entries are chosen on narrow columns first: those between the nearest full entry that is new enough and the state
    asked for. Only their arrays are read and laid over each other, from new to old. Before the first state the oldest
    one counts if `clamp`, else the state is null; keys without any state are absent.
    """
    w, whole = W.partitionBy(*keys).orderBy(ts), W.partitionBy(*keys)
    narrow = chain.select(*keys, ts, "is_full", F.lead(ts).over(w).alias("_newer"), F.min(ts).over(whole).alias("_first"))
    flags = [f"_in{i}" for i in range(len(ats))]
    for flag, at in zip(flags, ats, strict=True):
        target = F.greatest(F.lit(at), F.col("_first")) if clamp else F.lit(at)
        narrow = narrow.withColumn(flag, (F.col("_newer").isNull() | (F.col("_newer") > target)) & (F.col("_first") <= target))
        base = F.min(F.when(F.col("is_full") & F.col(flag), F.col(ts))).over(whole)
        narrow = narrow.withColumn("_base", base).withColumn(flag, F.col(flag) & (F.col(ts) <= F.col("_base")))
    needed = narrow.filter(" or ".join(flags)).groupBy(*keys, ts).agg(*[F.max(f).alias(f) for f in flags])
    entries = chain.select(*keys, ts, value).join(needed, [*keys, ts])

    def lay(below: Column, above: Column) -> Column:
        return F.zip_with(above, below, lambda a, b: F.coalesce(a, b))

    def newest_first(flag: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col(flag), F.struct(F.col(ts), F.col(value)))), asc=False), lambda e: e[value])

    listed = entries.groupBy(*keys).agg(*[newest_first(f).alias(f) for f in flags])
    return listed.select(*keys, *[F.aggregate(F.slice(f, 2, F.size(f)), F.get(f, F.lit(0)), lay).alias(f"{value}_{i}") for i, f in enumerate(flags)])


def fold(chain: DataFrame, keys: list[str], value: str, at: int, ts: str = "ts", clamp: bool = True) -> DataFrame:
    """Array state of each key at time `at` from its chain (see folds); keys without a state are absent."""
    return folds(chain, keys, value, [at], ts, clamp).select(*keys, F.col(f"{value}_0").alias(value))


def as_of(states: DataFrame, keys: list[str], values: list[str], at, ts: str = "ts", clamp: bool = False) -> DataFrame:
    """Newest values of each key at or before `at` (a number or column); with clamp the oldest ones before the first."""
    at = at if isinstance(at, Column) else F.lit(at)
    if not clamp:
        return states.filter(F.col(ts) <= at).groupBy(*keys).agg(*[F.max_by(v, ts).alias(v) for v in values])
    before = F.when(F.col(ts) <= at, F.col(ts))
    picked = [F.when(F.max(before).isNotNull(), F.max_by(v, before)).otherwise(F.min_by(v, ts)).alias(v) for v in values]
    return states.groupBy(*keys).agg(*picked)


def nearest_ts(states: DataFrame, keys: list[str], at: int, ts: str = "ts") -> DataFrame:
    """Time of each key's state nearest to `at`; the newer one at ties."""
    low, high = F.max(F.when(F.col(ts) <= at, F.col(ts))), F.min(F.when(F.col(ts) > at, F.col(ts)))
    near = F.when(low.isNull() | (high - F.lit(at) <= F.lit(at) - low), high).otherwise(low)
    return states.groupBy(*keys).agg(near.alias("nearest_ts"))


def nearest(states: DataFrame, keys: list[str], values: list[str], at: int, ts: str = "ts") -> DataFrame:
    """Values of each key at its nearest time."""
    return states.join(nearest_ts(states, keys, at, ts).withColumnRenamed("nearest_ts", ts), [*keys, ts]).groupBy(*keys).agg(*[F.max(v).alias(v) for v in [ts, *values]])


def newest(history: DataFrame, keys: list[str], n: int, ts: str = "ts") -> DataFrame:
    """The n newest entries of each key (a limit per group that Spark applies before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(F.col(ts).desc())
    return history.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def truncate(history: DataFrame, keys: list[str], cutoff: int, ts: str = "ts", floor: bool = False) -> DataFrame:
    """Entries at or after `cutoff`, and always the newest of each key; with floor also the one that held at the cutoff."""
    w = W.partitionBy(*keys).orderBy(F.col(ts).desc())
    newer = F.lag(ts).over(w)
    kept = (F.col(ts) >= cutoff) | F.col("_newer").isNull()
    if floor:
        kept |= F.col("_newer") > cutoff
    return history.withColumn("_newer", newer).filter(kept).drop("_newer")


def type_changes(states: DataFrame, keys: list[str], kind: str = "type", ts: str = "ts") -> DataFrame:
    """State list: entries that are newer than the one before and of another type."""
    return changes(states, keys, [kind], ts)


def newer_and_different(old: DataFrame, now: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Rows of now (one per key) that are newer than their key's newest in old and of another value, or of keys not held."""
    head = newest(old, keys, 1, ts).select(*keys, F.col(ts).alias("_ts"), F.col(value).alias("_value"))
    kept = F.col("_ts").isNull() | ((F.col(ts) > F.col("_ts")) & _distinct_from(F.col(value), F.col("_value")))
    return now.join(head, keys, "left").filter(kept).select(*now.columns)


def type_as_of(states: DataFrame, keys: list[str], at: int, kind: str = "type", ts: str = "ts") -> DataFrame:
    """Type of each key at `at` (clamped), with the time asked for."""
    return as_of(states, keys, [kind], at, ts, clamp=True).withColumn(ts, F.lit(at).cast("long"))


def born_by(states: DataFrame, keys: list[str], at: int, ts: str = "ts") -> DataFrame:
    """Keys that had a state at or before `at`; the others are skipped by a restore."""
    return states.groupBy(*keys).agg(F.min(ts).alias("first_ts")).filter(F.col("first_ts") <= at)


def gate(scan: DataFrame, heads: DataFrame, keys: list[str], scan_ts: str = "header_ts", head_ts: str = "head_ts") -> DataFrame:
    """Scanned rows newer than the newest time held of their key, or of keys that are not held."""
    joined = scan.join(heads.select(*keys, head_ts), keys, "left")
    held = F.coalesce(F.col(head_ts), F.lit(0))
    return joined.filter((held == 0) | (F.col(scan_ts) > held)).drop(head_ts)


def head_ts(histories: list[DataFrame], keys: list[str], ts: str = "ts") -> DataFrame:
    """Newest time of each key over all its histories (sections and tiles alike)."""
    both = histories[0].select(*keys, ts)
    for h in histories[1:]:
        both = both.unionByName(h.select(*keys, ts))
    return both.groupBy(*keys).agg(F.max(ts).alias("head_ts"))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], ts: str = "ts") -> DataFrame:
    """Each left row with the values of the newest right row of its key at or before its time (null if there is none)."""
    other = [c for c in left.columns if c not in (*keys, ts)]
    a = left.select(*keys, ts, F.struct(*other).alias("_left") if other else F.lit(True).alias("_left"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))
    b = right.select(*keys, ts, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.lit(0).alias("_side"), F.struct(*values).alias("_right"))
    w = W.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return filled.select(*keys, ts, *[F.col(f"_left.{c}").alias(c) for c in other], *[F.col(f"_right.{v}").alias(v) for v in values])
