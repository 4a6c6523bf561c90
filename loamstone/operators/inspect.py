"""Statistics, verification and two-point differences of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.operators import blobs as blob_ops
from loamstone.operators.chains import as_of, folds

PROTOCOL = 777
CHUNK = ["dimension", "rx", "rz", "lx", "lz"]


def chain_stats(chain: DataFrame, keys: list[str]) -> DataFrame:
    """One row: chains, entries, min_chain, max_chain, avg_chain."""
    sizes = chain.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("chains"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("entries"), F.coalesce(F.min("n"), F.lit(0)).alias("min_chain"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_chain"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_chain"),
    )


def palette_stats(palettes: DataFrame, palette: str = "palette") -> DataFrame:
    """One row: refs, distinct_palettes, dedup_ratio (1.0 without any)."""
    used = palettes.filter(F.size(palette) > 0)
    out = used.groupBy(palette).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("refs"), F.count(F.lit(1)).alias("distinct_palettes"))
    return out.withColumn("dedup_ratio", F.when(F.col("refs") == 0, 1.0).otherwise(F.col("distinct_palettes") / F.col("refs")))


def difference(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, status of keys that differ: 'only_old', 'only_new' or 'changed'."""
    a = old.select(*keys, F.struct(*values).alias("_a"))
    b = new.select(*keys, F.struct(*values).alias("_b"))
    same = F.lit(True)
    for v in values:
        same &= F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}"))
    status = F.when(F.col("_a").isNull(), "only_new").when(F.col("_b").isNull(), "only_old").when(~same, "changed")
    return a.join(b, keys, "full").select(*keys, status.alias("status")).filter("status is not null")


def two_points(states: DataFrame, keys: list[str], values: list[str], older: int, newer: int) -> DataFrame:
    """keys, status of what differs between two times; one pass over the history."""
    older, newer = sorted((older, newer))

    def state(at) -> list[Column]:
        before = F.when(F.col("ts") <= at, F.col("ts"))
        return [F.max(before).isNotNull().alias("there"), *[F.max_by(v, before).alias(v) for v in values]]

    both = states.filter(F.col("ts") <= newer).groupBy(*keys).agg(F.struct(*state(F.lit(older))).alias("a"), F.struct(*state(F.lit(newer))).alias("b"))
    same = F.lit(True)
    for v in values:
        same &= F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    status = F.when(~F.col("a.there"), "only_new").when(~same, "changed").otherwise("same")
    return both.select(*keys, status.alias("status"))


def diff_chunks(chain: DataFrame, tiles: DataFrame | None, older: int, newer: int, keys: list[str] | None = None, deep: bool = False) -> DataFrame:
    """Chunk keys, status between two times from chains (keys, kind, section, ts, atoms, is_full) and tile deltas.

    Sections born later do not count at the older time. Tiles count by their number; with deep by their content.
    """
    from loamstone.operators.tiles import map_as_of

    keys = keys or CHUNK
    times = sorted((older, newer))
    states = folds(chain, [*keys, "kind", "section"], "atoms", times, clamp=False)

    def content(i: int) -> Column:
        held = F.when(F.col(f"atoms_{i}").isNotNull(), F.struct("kind", "section", f"atoms_{i}"))
        return F.when(F.count(f"atoms_{i}") > 0, F.xxhash64(F.array_sort(F.collect_list(held)))).alias(f"content_{i}")

    both = states.groupBy(*keys).agg(content(0), content(1))
    for i, at in enumerate(times):
        if tiles is None:
            both = both.withColumn(f"tiles_{i}", F.lit(None).cast("long"))
            continue
        born = tiles.groupBy(*keys).agg(F.min("ts").alias("_t")).filter(F.col("_t") <= at).drop("_t")
        now = map_as_of(tiles, keys, "pos", "nbt", at)
        what = F.xxhash64(F.array_sort(F.collect_list(F.struct("pos", "nbt")))) if deep else F.count(F.lit(1))
        counted = born.join(now.groupBy(*keys).agg(what.cast("long").alias(f"tiles_{i}")), keys, "left").withColumn(f"tiles_{i}", F.coalesce(f"tiles_{i}", F.lit(0)))
        both = both.join(counted, keys, "full")
    there = [F.col(f"content_{i}").isNotNull() | F.col(f"tiles_{i}").isNotNull() for i in (0, 1)]
    same = F.col("content_0").eqNullSafe(F.col("content_1")) & F.col("tiles_0").eqNullSafe(F.col("tiles_1"))
    status = F.when(~there[0] & there[1], "only_new").when(there[0] & ~there[1], "only_old").when(~same, "changed")
    return both.select(*keys, status.alias("status")).filter("status is not null")


def unordered(chain: DataFrame, keys: list[str], place: str = "ordinal") -> DataFrame:
    """Keys whose stored entries are not newest first (equal times are in order)."""
    w = W.partitionBy(*keys).orderBy(place)
    return chain.withColumn("_p", F.lag("ts").over(w)).filter("ts > _p").select(*keys).distinct()


def problems(
    region_files: DataFrame | None = None, chain: DataFrame | None = None, states: DataFrame | None = None, entries: DataFrame | None = None, store: DataFrame | None = None,
    tiles: DataFrame | None = None, protocol: int = PROTOCOL, heads: DataFrame | None = None, tile_heads: DataFrame | None = None,
) -> DataFrame:
    """place, problem of everything that is wrong with the parts given.

    region_files: path, dimension, header_dimension, protocol, error; chain: chunk keys, kind, section, ordinal, ts;
    tiles: chunk keys, ordinal, ts; states: chunk keys, ts; entries and store: as in blobs; heads: a stored chain (chunk keys,
    kind, section, ts, is_full, atoms); tile_heads: stored tile deltas (chunk keys, ts, pos, op).
    """
    found = []

    def add(df: DataFrame, place: Column, text: Column) -> None:
        found.append(df.select(place.cast("string").alias("place"), text.alias("problem")))

    chunk = F.concat_ws("/", *CHUNK)
    if region_files is not None:
        from loamstone.functions.coords import region_of_file

        named = region_files.withColumn("_r", region_of_file("path", "zvcr3d"))
        add(named.filter("_r is null"), F.col("path"), F.lit("not a region file name"))
        readable = named.filter("_r is not null and error is null")
        add(named.filter("_r is not null and error is not null"), F.col("path"), F.concat(F.lit("unreadable: "), F.col("error")))
        add(readable.filter("header_dimension != dimension"), F.col("path"), F.concat(F.lit("header names another dimension: "), F.col("header_dimension")))
        add(readable.filter(F.col("protocol") != protocol), F.col("path"), F.concat(F.lit("protocol version differs: "), F.col("protocol").cast("string")))
    if chain is not None:
        add(unordered(chain, [*CHUNK, "kind", "section"]), chunk, F.concat_ws(" ", F.col("kind"), F.lit("section"), F.col("section").cast("string"), F.lit("is not newest first")))
    if tiles is not None:
        add(unordered(tiles, CHUNK), chunk, F.lit("tile deltas are not newest first"))
    if heads is not None:
        section = [*CHUNK, "kind", "section"]
        what = F.concat_ws(" ", F.col("kind"), F.lit("section"), F.col("section").cast("string"))
        newest = heads.groupBy(*section).agg(F.max_by("is_full", "ts").alias("full"), F.count(F.lit(1)).alias("n"), F.countDistinct("ts").alias("times"), F.countDistinct(F.size("atoms")).alias("sizes"))
        add(newest.filter("not full"), chunk, F.concat(what, F.lit(": the newest entry is not full")))
        add(newest.filter("n > times"), chunk, F.concat(what, F.lit(": several entries at one time")))
        add(newest.filter("sizes > 1"), chunk, F.concat(what, F.lit(": entries of different lengths")))
    if tile_heads is not None:
        last = F.max("ts").over(W.partitionBy(*CHUNK))
        wrong = tile_heads.withColumn("_last", last).filter("ts = _last and op = 'erase' and pos is not null")
        add(wrong.select(*CHUNK).distinct(), chunk, F.lit("the newest tiles erase an item"))
        add(tile_heads.groupBy(*CHUNK, "ts", "pos").count().filter("count > 1").select(*CHUNK).distinct(), chunk, F.lit("several tiles at one place and time"))
    if states is not None:
        twice = states.groupBy(*CHUNK, "ts").count().filter("count > 1").select(*CHUNK).distinct()
        add(twice, chunk, F.lit("several states at one time"))
        add(states.filter("ts < 0"), chunk, F.lit("negative state time"))
    if entries is not None and store is None:
        lost = entries.agg(F.countDistinct("hash").alias("n")).filter("n > 0")
        add(lost, F.lit("blobs"), F.concat(F.lit("no blob table, yet entries refer to "), F.col("n").cast("string"), F.lit(" blobs")))
    if entries is not None and store is not None:
        add(blob_ops.orphans(store, entries), F.col("hash"), F.lit("orphan blob"))
        add(blob_ops.missing(store, entries), F.col("hash"), F.concat(F.lit("missing blob, references: "), F.col("refs").cast("string")))
        actual = F.sha2(F.col("content").cast("binary"), 256)
        add(blob_ops.collected(store, entries).filter(actual != F.col("hash")), F.col("hash"), F.concat(F.lit("corrupt blob, content is "), actual))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def state_counts(states: DataFrame, keys: list[str], values: list[str], at: int) -> DataFrame:
    """How many keys have each combination of values at `at`."""
    return as_of(states, keys, values, at).groupBy(*values).agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(outcomes: DataFrame, by: str = "status") -> DataFrame:
    return outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def atom_summary(states: DataFrame, keys: list[str], atoms: str = "atoms") -> DataFrame:
    """keys, entries, nonzero, max_atom: what a dump of a container lists per chain."""
    e = F.transform(F.col(atoms), lambda x: x)
    per_row = states.select(*keys, F.size(F.filter(e, lambda x: x != 0)).alias("z"), F.array_max(e).alias("m"))
    return per_row.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum("z").cast("long").alias("nonzero"), F.max("m").alias("max_atom"))
