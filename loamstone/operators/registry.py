"""Identifier registries by epoch, and remapping from one epoch's ids to another's by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # ids are 16 bits wide, so a registry has 65,536 rows a kind at most


def name_index(registry: DataFrame) -> DataFrame:
    """kind, name, id: the first id of each name."""
    return registry.groupBy("kind", "name").agg(F.min("id").alias("id"))


def epochs(registry: DataFrame) -> DataFrame:
    return registry.select("epoch").distinct().orderBy("epoch")


def add_missing(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """registry with the epochs of the manifest that it does not have yet; those it has never change."""
    return registry.unionByName(manifest.join(registry.select("epoch").distinct(), "epoch", "left_anti").select(*registry.columns))


def id_map(old: DataFrame, new: DataFrame, fallback: dict[str, str] | None = None) -> DataFrame:
    """kind, old_id, new_id, name: where each old id goes; unknown names go to the kind's fallback name (air, plains)."""
    fallback = fallback or {"block": "minecraft:air", "biome": "minecraft:plains"}
    index = name_index(new)
    spare = index.filter(F.concat_ws("|", "kind", "name").isin(*[f"{k}|{v}" for k, v in fallback.items()])).select("kind", F.col("id").alias("_spare"))
    joined = old.select("kind", F.col("id").alias("old_id"), "name").join(index.withColumnRenamed("id", "_id"), ["kind", "name"], "left").join(F.broadcast(spare), "kind", "left")  # a row a kind
    return joined.select("kind", "old_id", F.coalesce("_id", "_spare", F.lit(-1)).alias("new_id"), "name", F.col("_id").isNull().alias("missing"))


def is_identity(mapping: DataFrame) -> bool:
    return mapping.filter("old_id != new_id").limit(1).count() == 0


def remap_rows(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows (with kind) with `column` translated; null, the mark of an unchanged position, stays null."""
    small = mapping.select("kind", F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    if mapping.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return rows.join(small, ["kind", column], "left").withColumn(column, F.col("_new")).drop("_new").select(*rows.columns)


def remap_arrays(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows (with kind) with the elements of an array column translated.

    The map of a kind is one value of bounded size (ids are 16 bits wide) joined once; arrays are not exploded.
    """
    maps = mapping.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("old_id", "new_id"))).alias("_map"))
    out = rows.join(F.broadcast(maps), "kind", "left")  # a row a kind
    return out.withColumn(column, F.transform(column, lambda x: F.when(x.isNotNull(), F.coalesce(F.try_element_at("_map", x), F.lit(-1))))).select(*rows.columns)


def remap_palettes(palettes: DataFrame, mapping: DataFrame, column: str = "palette") -> DataFrame:
    """Only palettes are translated, their cells stay; a palette that loses its order or gets equal entries is marked."""
    out = remap_arrays(palettes, mapping, column)
    return out.withColumn("recode", F.col(column) != F.array_sort(F.array_distinct(column)))


def missing_counts(atoms: DataFrame, mapping: DataFrame, column: str = "atom") -> DataFrame:
    """kind, missing: atoms whose name the new registry lacks."""
    return atoms.join(mapping.filter("missing").select("kind", F.col("old_id").alias(column)), ["kind", column]).groupBy("kind").agg(F.count(F.lit(1)).alias("missing"))
