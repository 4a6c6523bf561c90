"""The engine: ingest, restore, list, diff, verify, stats and prune over a store."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.functions.coords import BIOME_WIDTH, BLOCK_WIDTH, floor_div32, parse_dimension
from loamstone.functions.palette import palette
from loamstone.operators import blobs, chains, inspect, registry, retention, tiles
from loamstone.sources import container
from loamstone.sources.store import Store

CHUNK = inspect.CHUNK
SECTION = [*CHUNK, "kind", "section"]


@dataclass(frozen=True)
class Restored:
    """Results of a restore; parts not asked for are None."""

    sections: DataFrame | None
    tiles: DataFrame | None
    files: DataFrame | None


def sector():
    return F.concat_ws("_", F.col("dimension"), floor_div32("rx").cast("string"), floor_div32("rz").cast("string"))


class Engine:
    def __init__(self, spark: SparkSession, root: str, checkpoint_every: int = 32, level: int = 4):
        self.spark, self.store, self.every, self.level = spark, Store(spark, root), checkpoint_every, level

    # --- writing

    def ingest(self, ts: int, sections: DataFrame | None = None, tile_items: DataFrame | None = None, states: DataFrame | None = None, files: DataFrame | None = None, manifest: DataFrame | None = None) -> dict[str, int]:
        """Inserts what changed at time ts; returns counts by outcome.

        sections: CHUNK, kind, section, atoms; tile_items: CHUNK, pos, type, nbt (all items of each chunk given; a row with a
        null pos names a chunk that has none left); states: CHUNK, type; files: path, content; manifest: epoch, kind, id, name.
        Two rows for one section, item, state or file are a ValueError. States and files that are not newer than what is held,
        or not different from it, are left out; entries and blobs are only ever added to.
        """
        for what, df, keys in (("sections", sections, SECTION), ("tile_items", tile_items, [*CHUNK, "pos"]), ("states", states, CHUNK), ("files", files, ["path"])):
            if df is not None and (twice := df.groupBy(*keys).count().filter("count > 1").first()):
                raise ValueError(f"{what}: more than one row for {', '.join(str(twice[k]) for k in keys)}")
        changed: dict[str, DataFrame] = {}
        counts: dict[str, int] = {}
        outcome = None
        if sections is not None:
            batch = sections.select(*SECTION, F.lit(ts).cast("long").alias("ts"), "atoms").withColumn("sector", sector())
            touched = [r[0] for r in batch.select("sector").distinct().collect()]  # sectors of 1,024 regions
            old = self.store.read("chains", touched)
            heads = chains.newest(old, SECTION, 1) if old is not None else batch.limit(0)
            outcome = chains.insert(heads, batch, SECTION, "atoms").withColumn("sector", sector()).cache()
            counts |= {f"sections_{r['status']}": r["n"] for r in inspect.outcome_counts(outcome).collect()}
            new = outcome.filter("status = 'inserted'").select(*SECTION, "ts", "atoms", F.lit(True).alias("is_full"), "sector")
            if old is not None:
                newer = new.select(*SECTION, F.col("atoms").alias("_new"))
                newest = F.row_number().over(W.partitionBy(*SECTION).orderBy(F.col("ts").desc())) == 1
                depth = F.count(F.lit(1)).over(W.partitionBy(*SECTION))
                kept_full = F.col("_depth") % self.every == 0  # a full copy every so many entries stays as a checkpoint
                delta = F.zip_with("atoms", "_new", lambda a, b: F.when(~a.eqNullSafe(b), a))
                marked = old.withColumn("_head", newest).withColumn("_depth", depth).join(newer, SECTION, "left")
                superseded = F.col("_head") & F.col("_new").isNotNull() & ~kept_full
                old = marked.withColumn("is_full", F.when(superseded, False).otherwise(F.col("is_full"))).withColumn("atoms", F.when(superseded, delta).otherwise(F.col("atoms")))
                new = old.select(*new.columns).unionByName(new)
            changed["chains"] = new
        if tile_items is not None:
            given = tile_items.select(*CHUNK, F.lit(ts).cast("long").alias("ts"), "pos", F.struct("type", "nbt").alias("item")).withColumn("sector", sector())
            touched = [r[0] for r in given.select("sector").distinct().collect()]
            now = given.filter("pos is not null")
            old = self.store.read("tiles", touched)
            out = now.withColumn("op", F.lit("put")) if old is None else self._tile_step(old, now, given.select(*CHUNK).distinct(), ts)
            changed["tiles"] = out.select(*CHUNK, "ts", "pos", "op", "item", "sector")
        if states is not None:
            old = self.store.read("states")
            now = states.select(*CHUNK, F.lit(ts).cast("long").alias("ts"), "type")
            changed["states"] = chains.newer_and_different(old, now, CHUNK, "type") if old is not None else now
        if files is not None:
            now = files.select("path", F.lit(ts).cast("long").alias("ts"), "content")
            hashed = blobs.hashed(now)
            old, old_blobs = self.store.read("entries"), self.store.read("blobs")
            if old is not None:
                hashed = chains.newer_and_different(old, hashed, ["path"], "hash")
            stored = hashed.groupBy("hash").agg(F.first("content").alias("content"))
            if old_blobs is not None:
                stored = stored.join(old_blobs.select("hash"), "hash", "left_anti")
            changed |= {"entries": hashed.select("path", "ts", "hash"), "blobs": stored}
        if manifest is not None:
            old = self.store.read("registry")
            changed["registry"] = registry.add_missing(old, manifest) if old is not None else manifest
        self.store.commit(changed, self.level, "sector", added=("states", "entries", "blobs"))
        if outcome is not None:
            outcome.unpersist()
        return counts

    def _tile_step(self, old: DataFrame, now: DataFrame, given: DataFrame, ts: int) -> DataFrame:
        """Tile deltas with a new newest snapshot for the given chunks whose tiles changed.

        A snapshot without items is one row with a null pos, an erase.
        """
        head = tiles.map_as_of(old, CHUNK, "pos", "item", 1 << 62).join(given, CHUNK, "left_semi")
        differs = ~F.col("a").eqNullSafe(F.col("b"))
        pairs = head.withColumnRenamed("item", "a").join(now.select(*CHUNK, "pos", F.col("item").alias("b")), [*CHUNK, "pos"], "full").filter(differs)
        moved = pairs.select(*CHUNK).distinct()
        head_ts = old.groupBy(*CHUNK).agg(F.max("ts").alias("ts")).filter(F.col("ts") < ts)
        moved = moved.join(head_ts.select(*CHUNK), CHUNK, "left_semi").unionByName(moved.join(old.select(*CHUNK).distinct(), CHUNK, "left_anti"))
        # what the old head held where the new snapshot differs; an item that is new is an erase in the old one
        delta = pairs.join(head_ts, CHUNK).select(*CHUNK, "ts", "pos", F.when(F.col("a").isNull(), "erase").otherwise("put").alias("op"), F.col("a").alias("item")).withColumn("sector", sector())
        replaced = head_ts.join(moved, CHUNK, "left_semi")
        rest = old.join(replaced, [*CHUNK, "ts"], "left_anti")
        fresh = now.join(moved, CHUNK, "left_semi").withColumn("op", F.lit("put"))
        none = moved.join(now.select(*CHUNK).distinct(), CHUNK, "left_anti").withColumn("ts", F.lit(ts).cast("long")).withColumn("op", F.lit("erase")).withColumn("sector", sector())
        none = none.withColumn("pos", F.lit(None).cast(now.schema["pos"].dataType)).withColumn("item", F.lit(None).cast(now.schema["item"].dataType))
        columns = [*CHUNK, "ts", "pos", "op", "item", "sector"]
        return rest.select(*columns).unionByName(delta.select(*columns)).unionByName(fresh.select(*columns)).unionByName(none.select(*columns))

    def prune(self, policy: retention.RetentionPolicy, now: int | None = None, dry_run: bool = False, floor: bool = False) -> dict[str, int]:
        """Removes entries beyond the policy's cutoff, never a newest one, and blobs without references; counts what goes."""
        if policy.is_unbounded:
            raise ValueError("nothing to prune: give days and/or snapshots")
        at = retention.cutoff_value(self.points(), policy, int(time.time()) if now is None else now)
        removed, changed = {}, {}
        for name, keys in (("chains", SECTION), ("tiles", CHUNK), ("states", CHUNK), ("entries", ["path"])):
            table = self.store.read(name)
            if table is None:
                continue
            distinct = table.select(*keys, "ts").distinct() if name == "tiles" else table
            removed[name] = retention.removals(distinct, keys, at).agg(F.coalesce(F.sum("removed"), F.lit(0))).first()[0]
            if removed[name] and not dry_run:
                changed[name] = tiles.map_truncate(table, keys, at) if name == "tiles" else chains.truncate(table, keys, at, floor=floor)
        if "entries" in changed:
            changed["blobs"] = blobs.collected(self.store.read("blobs"), changed["entries"])
        if changed:
            self.store.commit(changed, 8, "sector")
        return removed

    # --- reading

    def points(self) -> DataFrame:
        """ts of all restore points."""
        found = [t.select("ts") for n in ("chains", "tiles", "states", "entries") if (t := self.store.read(n)) is not None]
        return retention.restore_points(*found) if found else self.spark.createDataFrame([], "ts long")

    def list(self, now: int | None = None, min_days: int = 0, max_days: int = 0, skip: int = 0, keep: int = 50) -> DataFrame:
        return retention.listing(self.points(), int(time.time()) if now is None else now, min_days, max_days, skip, keep)

    def restore(self, at: int | str = "latest", dimensions: list[str] | None = None, chunks: bool = True, files: bool = True, path_part: str | None = None) -> Restored:
        """State at a time. Nothing selected, or a time before the oldest point, is a ValueError."""
        if not (chunks or files):
            raise ValueError("nothing selected: chunks, files or both")
        at = int(time.time()) if at == "latest" else int(at)
        span = retention.bounds(self.points()).first()
        if span["oldest_ts"] is None or at < span["oldest_ts"]:
            raise ValueError(f"{at} is before the oldest restore point; the range is {span['oldest_ts']} to {span['newest_ts']}")
        wanted = [parse_dimension(d) for d in dimensions] if dimensions else None
        sections = items = None
        if chunks:
            parts = [p for p in self.store.generation().get("chains", {}) if wanted is None or p.rsplit("_", 2)[0] in wanted]
            table = self.store.read("chains", parts)
            if table is not None:
                born = chains.born_by(table, CHUNK, at).select(*CHUNK)
                sections = chains.fold(table, SECTION, "atoms", at).join(born, CHUNK, "left_semi")
            held = self.store.read("tiles", parts)
            if held is not None:
                items = tiles.map_as_of(held, CHUNK, "pos", "item", at).select(*CHUNK, "pos", "item.type", "item.nbt")
        entries = self.store.read("entries") if files else None
        return Restored(sections, items, blobs.restored(entries, self.store.read("blobs"), at, path_part) if entries is not None else None)

    def diff(self, older: int, newer: int, deep: bool = False) -> dict[str, int]:
        """Counts of chunks and files that differ between two times."""
        out = {"changed": 0, "only_new": 0, "only_old": 0, "files": 0}
        table, held, entries = (self.store.read(n) for n in ("chains", "tiles", "entries"))
        if table is not None:
            named = held.withColumnRenamed("item", "nbt") if held is not None else None
            found = inspect.diff_chunks(table, named, older, newer, deep=deep)
            out |= {r["status"]: r["n"] for r in inspect.outcome_counts(found).collect()}
        if entries is not None:
            out["files"] = blobs.diff_files(entries, older, newer).count()
        return out

    def stats(self) -> dict:
        out: dict = {"segments": 0, "chains": 0, "entries": 0, "min_chain": 0, "max_chain": 0, "avg_chain": 0.0, "tile_deltas": 0, "refs": 0, "distinct_palettes": 0, "dedup_ratio": 1.0, "tracked_files": 0, "blobs": 0, "blob_bytes": 0} | self.store.usage()
        if (table := self.store.read("chains")) is not None:
            out |= inspect.chain_stats(table, SECTION).first().asDict()
            out["segments"] = table.select(*CHUNK).distinct().count()
            real = table.select(palette(F.transform("atoms", lambda x: F.coalesce(x, F.lit(0xFFFF)))).alias("palette")).filter(F.size("palette") > 1)
            out |= inspect.palette_stats(real).first().asDict()
        if (held := self.store.read("tiles")) is not None:
            out["tile_deltas"] = held.select(*CHUNK, "ts").distinct().count()
        if (entries := self.store.read("entries")) is not None:
            found = blobs.totals(entries, self.store.read("blobs")).first().asDict()
            out |= {k: found[k] for k in ("tracked_files", "blobs", "blob_bytes")}
        return out

    def verify(self, regions: str | None = None) -> DataFrame:
        """place, problem of everything that is wrong; with `regions`, a folder, also with the container files there.

        Where parts of the store cannot be read, only these are told.
        """
        broken = self.store.broken() if self.store.exists() else []
        if broken:
            return self.spark.createDataFrame(broken, "place string, problem string")
        table, held, states, entries, stored = (self.store.read(n) for n in ("chains", "tiles", "states", "entries", "blobs"))
        files = chain = None
        if regions is not None:
            read = container.read_regions(self.spark, regions)
            files, chain = container.region_headers(read), container.chain_rows(read)
        if all(x is None for x in (table, held, states, entries, files)):
            return self.spark.createDataFrame([], "place string, problem string")
        return inspect.problems(region_files=files, chain=chain, heads=table, tile_heads=held, states=states, entries=entries, store=stored)

    def status(self) -> dict:
        span = retention.bounds(self.points()).first()
        return {"tables": self.store.tables(), "oldest": span["oldest_ts"], "newest": span["newest_ts"]}

    def inspect_section(self, dimension: str, rx: int, rz: int, lx: int, lz: int, section: int, kind: str = "block") -> DataFrame:
        """Entries of one section, newest first: ts, is_full, changed (positions held), distinct."""
        part = f"{parse_dimension(dimension)}_{rx >> 5}_{rz >> 5}"
        table = self.store.read("chains", [part])
        if table is None:
            raise ValueError("no such sector in the store")
        own = table.filter((F.col("rx") == rx) & (F.col("rz") == rz) & (F.col("lx") == lx) & (F.col("lz") == lz) & (F.col("section") == section) & (F.col("kind") == kind))
        held = F.filter("atoms", lambda x: x.isNotNull())
        return own.select("ts", "is_full", F.size(held).alias("changed"), F.size(F.array_distinct(held)).alias("distinct")).orderBy(F.desc("ts"))

    def rebuilt_chunks(self, at: int, sections: int) -> DataFrame:
        """All sections of each chunk at a time; those never stored are filled with id 0."""
        state = self.restore(at, files=False).sections
        places = state.select(*CHUNK).distinct().select(*CHUNK, F.explode(F.array(F.lit("block"), F.lit("biome"))).alias("kind"), F.lit(0).alias("_z"))
        full = places.select(*CHUNK, "kind", F.explode(F.sequence(F.lit(0), F.lit(sections - 1))).alias("section"))
        blank = F.array_repeat(F.lit(0), F.when(F.col("kind") == "block", BLOCK_WIDTH).otherwise(BIOME_WIDTH))
        return full.join(state, SECTION, "left").withColumn("atoms", F.coalesce("atoms", blank))


def tile_records(items: DataFrame) -> DataFrame:
    """Tiles with their world position beside type and data: id, x, y, z, nbt."""
    from loamstone.functions.coords import tile_of_position

    placed = items.withColumn("p", tile_of_position("pos"))
    low = F.when(F.col("dimension") == "overworld", -64).otherwise(0)
    return placed.select(*CHUNK, F.col("type").alias("id"), (F.col("p.x") + (F.col("rx") * 32 + F.col("lx")) * 16).alias("x"), (F.col("p.y") + low).alias("y"), (F.col("p.z") + (F.col("rz") * 32 + F.col("lz")) * 16).alias("z"), "nbt")
