"""Queries through the sources, registry texts and the engine, each with the SQL of what must come back.

Vectors stand for biome sections (64 values), customers for chunks of world files, documents for files.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from loamstone.api import CHUNK, Engine, tile_records
from loamstone.functions import coords, names
from loamstone.operators.retention import RetentionPolicy
from loamstone.plans.register import query
from loamstone.plans.tables import FILES, QUANTISED, files, quantised, registries, table
from loamstone.sources import container, manifest, world
from loamstone.streaming.ingest import shared_root

SIDE = 16  # segments of a region that the vectors fill

# --- containers ---------------------------------------------------------------------------------------------------

PLACED = f"""v AS (SELECT vec_id, label, atoms, (vec_id // {SIDE} - 10)::INT AS rx, -1 AS rz, (vec_id % {SIDE})::INT AS lx, 31 AS lz FROM {QUANTISED})"""


def _containers(spark, sf):
    """One container per region: a chain of a head and a delta, two states and two tile lists per vector."""
    k = F.col("vec_id")
    place = [F.lit("nether").alias("dimension"), (F.floor(k / SIDE) - 10).cast("int").alias("rx"), F.lit(-1).alias("rz"), (k % SIDE).cast("int").alias("lx"), F.lit(31).alias("lz")]
    v = quantised(spark, sf).select("vec_id", "label", "atoms", *place)
    delta = F.transform("atoms", lambda a, i: F.when((k + i) % 9 == 0, a))
    types = {c.split()[0]: c.split()[1] for c in container.ROW.split(", ")}

    def entry(kind, ordinal, ts, **columns):
        given = {"kind": F.lit(kind), "ordinal": F.lit(ordinal), "ts": ts, **columns}
        return F.struct(*[given.get(c, F.col(c) if c in ("lx", "lz") else F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    entries = [
        entry("biome", 0, k + 2000, section=F.lit(5), atoms=F.col("atoms")), entry("biome", 1, k + 1000, section=F.lit(5), atoms=delta),
        entry("state", 0, k + 2000, state=F.lit("OLD")), entry("state", 1, k + 1000, state=F.when(F.col("label") % 2 == 0, "NEW").otherwise("UNKNOWN")),
        entry("tile", 0, k + 2000, pos=F.col("label") + 70_000, op=F.lit("put"), type=F.col("label") + 1, nbt=F.encode(k.cast("string"), "utf-8")), entry("tile", 0, k + 2000, pos=F.lit(9), op=F.lit("erase")),
        entry("tile", 1, k + 1000),
    ]
    return container.write_regions(v.select("dimension", "rx", "rz", F.explode(F.array(*entries)).alias("e")).select("dimension", "rx", "rz", "e.*"))


@query("container_round_trip", f"""
WITH {PLACED}, e AS (
  SELECT rx, rz, lx, lz, 'biome' AS kind, 5 AS section, 0 AS ordinal, vec_id + 2000 AS ts, array_to_string(atoms, ',') AS value FROM v UNION ALL
  SELECT rx, rz, lx, lz, 'biome', 5, 1, vec_id + 1000, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN (vec_id + i - 1) % 9 = 0 THEN atoms[i]::VARCHAR ELSE '-' END), ',') FROM v UNION ALL
  SELECT rx, rz, lx, lz, 'state', NULL, 0, vec_id + 2000, 'OLD' FROM v UNION ALL
  SELECT rx, rz, lx, lz, 'state', NULL, 1, vec_id + 1000, CASE WHEN label % 2 = 0 THEN 'NEW' ELSE 'UNKNOWN' END FROM v UNION ALL
  SELECT rx, rz, lx, lz, 'tile', NULL, 0, vec_id + 2000, (label + 70000) || ' put ' || (label + 1) || ' ' || vec_id FROM v UNION ALL
  SELECT rx, rz, lx, lz, 'tile', NULL, 0, vec_id + 2000, '9 erase' FROM v UNION ALL
  SELECT rx, rz, lx, lz, 'tile', NULL, 1, vec_id + 1000, '' FROM v)
SELECT 'nether/' || floor(rx / 32.0)::INT || '/' || floor(rz / 32.0)::INT || '/r.' || rx || '.' || rz || '.zvcr3d' AS path, 777 AS protocol, lx, lz, kind, section, ordinal, ts, value FROM e""")
def _(spark, sf):
    read = container.parsed(_containers(spark, sf))
    atoms = F.array_join(F.transform("atoms", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    tile = F.concat_ws(" ", F.col("pos").cast("string"), "op", F.col("type").cast("string"), F.decode("nbt", "utf-8"))
    return read.select("path", "protocol", "lx", "lz", "kind", "section", "ordinal", "ts", F.coalesce(atoms, "state", tile).alias("value"))


@query("container_newest", f"""
WITH {PLACED} SELECT rx, rz, lx, lz, section, ts, atoms FROM (SELECT rx, rz, lx, lz, 5 AS section, vec_id + 2000 AS ts, array_to_string(atoms, ',') AS atoms FROM v)""")
def _(spark, sf):
    chain = container.chain_rows(container.parsed(_containers(spark, sf), max_entries=1))
    return chain.filter("is_full").select("rx", "rz", "lx", "lz", "section", "ts", F.array_join("atoms", ",").alias("atoms"))


@query("container_damage", f"""
WITH {PLACED}, r AS (SELECT DISTINCT rx, rz, rx + 10 AS n FROM v)
SELECT rx, rz, n % 5 <> 1 AS has_magic, CASE WHEN n % 5 IN (0, 4) THEN 'nether' END AS dimension, n % 5 = 0 AS readable FROM r""")
def _(spark, sf):
    files = _containers(spark, sf).withColumn("r", coords.region_of_file("path", "zvcr3d"))
    n, raw = (F.col("r.rx") + 10) % 5, F.col("content")

    def from_byte(i):
        return F.substring(raw, i, 1 << 30)

    wrong = F.concat(F.encode(F.lit("zvcr2d"), "utf-8"), from_byte(7))
    future = F.concat(F.substring(raw, 1, 6), F.unhex(F.lit("09")), from_byte(8))
    nowhere = F.concat(F.substring(raw, 1, 7), F.unhex(F.lit("05")), from_byte(9))
    short = F.substring(raw, 1, 40)
    damaged = files.select("path", "r", F.when(n == 1, wrong).when(n == 2, future).when(n == 3, nowhere).when(n == 4, short).otherwise(raw).alias("content"))
    read = container.parsed(damaged.select("path", "content")).groupBy("path").agg(F.max("dimension").alias("dimension"), (F.count("error") == 0).alias("readable"))
    return damaged.withColumn("has_magic", container.has_magic("content")).join(read, "path").select("r.rx", "r.rz", "has_magic", "dimension", "readable")


# --- world files --------------------------------------------------------------------------------------------------

CHUNKS = """c AS (SELECT c_custkey AS k, c_mktsegment AS segment, (c_custkey // 64 - 3)::INT AS rx, 1 AS rz, (c_custkey % 64 % 32)::INT AS lx, (c_custkey % 64 // 32)::INT AS lz, c_nationkey FROM customer)"""


def _world(spark, sf):
    """Region files of customers as chunks; every compression, one in fifty damaged, palettes in either order."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment", "c_nationkey", (F.floor(F.col("c_custkey") / 64) - 3).cast("int").alias("rx"))

    def typed(value):
        if isinstance(value, dict):
            return world.Typed(10, {n: typed(v) for n, v in value.items()})
        if isinstance(value, list):
            return world.Typed(12, value) if value and isinstance(value[0], int) else world.Typed(9, [typed(v) for v in value])
        return world.Typed(8, value) if isinstance(value, str) else world.Typed(3, value)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rx, chunks = int(pdf["rx"].iloc[0]), {}
        for k, segment, nation in zip(pdf["k"].tolist(), pdf["c_mktsegment"], pdf["c_nationkey"].tolist(), strict=True):
            lx, lz = k % 64 % 32, k % 64 // 32
            x, z = rx * 32 + lx, 32 + lz
            palette, cell = (["m:air", f"m:{segment}"], 0x0101010101010101) if k % 2 else ([f"m:{segment}", "m:air"], 0x1010101010101010)
            root = {
                "zPos": z, "xPos": x, "Status": "minecraft:full" if k % 3 else "minecraft:noise",
                "sections": [{"Y": -4, "block_states": {"palette": palette, "data": [cell] * 256}, "biomes": {"palette": ["m:plains"]}}, {"Y": nation, "block_states": {"palette": [f"m:{segment}"]}}],
                "block_entities": [{"z": z * 16 + 3, "id": "m:chest", "y": nation - 60, "x": x * 16 + nation % 16, "b": k, "a": segment, "keepPacked": 0}, {"id": "m:far", "x": x * 16, "y": -65, "z": z * 16}],
            }
            tag = k % 4 + 1
            raw = world.compressed(tag, world.tree_bytes(typed(root)))
            chunks[lx, lz] = (1000 + k, 9 if k % 50 == 7 else tag, raw)
        return pd.DataFrame([(f"region/r.{rx}.1.mca", world.region_bytes(chunks))], columns=["path", "content"])

    return c.groupBy("rx").applyInPandas(run, "path string, content binary")


@query("world_headers", f"WITH {CHUNKS} SELECT 'region/r.' || rx || '.1.mca' AS path, rx, rz, lx, lz, k + 1000 AS header_ts FROM c")
def _(spark, sf):
    return world.headers_of(_world(spark, sf))


@query("world_sections", f"""
WITH {CHUNKS}, s AS (
  SELECT *, -4 AS y, 'm:' || segment || ',m:air' AS blocks, sha1(unhex(repeat('00000100', 2048))) AS block_digest, 'm:plains' AS biomes, sha1(unhex(repeat('0000', 64))) AS biome_digest FROM c WHERE k % 50 <> 7 UNION ALL
  SELECT *, c_nationkey, 'm:' || segment, sha1(unhex(repeat('0000', 4096))), NULL, NULL FROM c WHERE k % 50 <> 7 UNION ALL
  SELECT *, NULL, NULL, NULL, NULL, NULL FROM c WHERE k % 50 = 7)
SELECT rx, rz, lx, lz, k + 1000 AS header_ts, k % 50 <> 7 AS readable, CASE WHEN k % 50 <> 7 THEN k % 3 <> 0 END AS whole, CASE WHEN k % 50 <> 7 THEN rx * 32 + lx END AS x_pos, CASE WHEN k % 50 <> 7 THEN 32 + lz END AS z_pos,
       y, blocks, block_digest, biomes, biome_digest FROM s""")
def _(spark, sf):
    read = world.sections_in(_world(spark, sf))
    return read.select(
        "rx", "rz", "lx", "lz", "header_ts", F.col("error").isNull().alias("readable"), names.fully_generated("status").alias("whole"), "x_pos", "z_pos",
        "y", F.array_join("block_names", ",").alias("blocks"), "block_digest", F.array_join("biome_names", ",").alias("biomes"), "biome_digest",
    )


@query("world_tiles", f"""
WITH {CHUNKS} SELECT rx, rz, lx, lz, k % 50 <> 7 AS readable, CASE WHEN k % 50 <> 7 THEN (c_nationkey + 4) * 65536 + 3 * 256 + c_nationkey % 16 END AS pos, CASE WHEN k % 50 <> 7 THEN 'm:chest' END AS type,
  CASE WHEN k % 50 <> 7 THEN '0A08000161' || printf('%04X', length(segment)) || hex(segment) || '03000162' || printf('%08X', k) || '00' END AS nbt FROM c""")
def _(spark, sf):
    read = world.tiles_in(_world(spark, sf))
    return read.select("rx", "rz", "lx", "lz", F.col("error").isNull().alias("readable"), "pos", "type", F.hex("nbt").alias("nbt"))


@query("tile_records", f"""
WITH {CHUNKS} SELECT rx, rz, lx, lz, 'm:chest' AS id, (rx * 32 + lx) * 16 + c_nationkey % 16 AS x, c_nationkey - 60 AS y, (32 + lz) * 16 + 3 AS z FROM c WHERE k % 50 <> 7""")
def _(spark, sf):
    tiles = world.tiles_in(_world(spark, sf)).filter("error is null").withColumn("dimension", F.lit("overworld")).withColumn("pos", F.col("pos").cast("int"))
    return tile_records(tiles).select("rx", "rz", "lx", "lz", "id", "x", "y", "z")


# --- registries as text -------------------------------------------------------------------------------------------


@query("manifest_text", """
WITH n AS (SELECT 'block' AS kind, n_nationkey::INT AS id, n_name AS name FROM nation UNION ALL SELECT 'biome', r_regionkey::INT, r_name FROM region),
f AS (SELECT sha256(unhex(hex('777') || (SELECT string_agg('00' || hex(name), '' ORDER BY id) FROM n WHERE kind = 'block') || 'FF' || (SELECT string_agg('00' || hex(name), '' ORDER BY id) FROM n WHERE kind = 'biome'))) AS epoch)
SELECT epoch, kind, id, name FROM n, f""")
def _(spark, sf):
    old, _ = registries(spark, sf)
    biomes = table(spark, sf, "region").select(F.lit("a").alias("epoch"), F.lit("biome").alias("kind"), F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name"))
    written = manifest.of_table(old.unionByName(biomes), "a", 777)
    return manifest.table(spark, [manifest.parse(written.text(), written.fingerprint)])


# --- the engine ---------------------------------------------------------------------------------------------------

TIMES = (1000, 2000, 3000)
SECTIONS = f"""{PLACED}, s AS (SELECT vec_id, 1000 AS ts, atoms FROM v UNION ALL SELECT vec_id, 2000, list_reverse(atoms) FROM v WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 3000, list_transform(atoms, lambda x: x + 1) FROM v WHERE vec_id % 5 = 0)"""


def _engine(spark, sf) -> Engine:
    """A store after three ingests: sections and states of vectors, tiles of some, and files of documents."""
    k = F.col("vec_id")
    place = [F.lit("nether").alias("dimension"), (F.floor(k / SIDE) - 10).cast("int").alias("rx"), F.lit(-1).alias("rz"), (k % SIDE).cast("int").alias("lx"), F.lit(31).alias("lz")]
    v = quantised(spark, sf).select("vec_id", *place, F.lit("biome").alias("kind"), F.lit(5).alias("section"), "atoms")
    docs = files(spark, sf)
    engine = Engine(spark, f"{shared_root(spark)}/store")
    for ts, some, atoms, third in zip(TIMES, ("true", "vec_id % 3 = 0", "vec_id % 5 = 0"), (F.col("atoms"), F.reverse("atoms"), F.transform("atoms", lambda x: x + 1)), range(3), strict=True):
        own = v.filter(some).withColumn("atoms", atoms)
        newest = docs.filter(F.col("ts") % 3 == third).groupBy("path").agg(F.max_by("content", "ts").alias("content"))
        items = own.select(*CHUNK, k.cast("int").alias("pos"), F.lit("m:chest").alias("type"), F.encode(F.lit(str(ts)), "utf-8").alias("nbt"))
        engine.ingest(ts, own.drop("vec_id"), items, own.select(*CHUNK, F.lit("NEW" if ts == 1000 else "OLD").alias("type")), newest)
    return engine


@query("engine_restore", f"""
WITH {SECTIONS}, f AS (SELECT path, ts % 3 AS third, arg_max(content, ts) AS content FROM {FILES} GROUP BY path, ts % 3)
SELECT 'section' AS kind, vec_id::VARCHAR AS place, sha256(array_to_string(arg_max(atoms, ts), ',')) AS hash FROM s WHERE ts <= 2500 GROUP BY vec_id UNION ALL
SELECT 'tile', vec_id::VARCHAR, sha256(max(ts)::VARCHAR) FROM s WHERE ts <= 2500 GROUP BY vec_id UNION ALL
SELECT 'file', path, sha256(arg_max(content, third)) FROM f WHERE third <= 1 GROUP BY path""")
def _(spark, sf):
    found = _engine(spark, sf).restore(2500, dimensions=[" Nether "])
    number = ((F.col("rx") + 10) * SIDE + F.col("lx")).cast("string").alias("place")
    sections = found.sections.select(F.lit("section").alias("kind"), number, names.sha256_hex(F.array_join("atoms", ",")).alias("hash"))
    tiles = found.tiles.select(F.lit("tile").alias("kind"), number, names.sha256_hex("nbt").alias("hash"))
    return sections.unionByName(tiles).unionByName(found.files.select(F.lit("file").alias("kind"), F.col("path").alias("place"), names.sha256_hex("content").alias("hash")))


@query("engine_prune", f"""
WITH {SECTIONS} SELECT vec_id::VARCHAR AS place, array_to_string(list_reverse(list_sort(list(ts))), ',') AS times
FROM (SELECT vec_id, ts, max(ts) OVER (PARTITION BY vec_id) AS head FROM s) WHERE ts >= 2000 OR ts = head GROUP BY vec_id""")
def _(spark, sf):
    engine = _engine(spark, sf)
    engine.prune(RetentionPolicy(days=0, snapshots=2), now=4000)
    number = ((F.col("rx") + 10) * SIDE + F.col("lx")).cast("string").alias("place")
    times = F.array_join(F.reverse(F.array_sort(F.collect_list("ts"))), ",").alias("times")
    return engine.store.read("chains").groupBy(number).agg(times)


@query("engine_diff", f"""
WITH {SECTIONS}, f AS (SELECT path, ts % 3 AS third, arg_max(content, ts) AS content FROM {FILES} GROUP BY path, ts % 3),
c AS (SELECT vec_id, arg_max(atoms, ts) FILTER (WHERE ts <= 1500) AS a, arg_max(atoms, ts) AS b FROM s GROUP BY vec_id),
p AS (SELECT path, arg_max(content, third) FILTER (WHERE third = 0) AS a, arg_max(content, third) AS b FROM f GROUP BY path)
SELECT 'chunks' AS what, count(*) AS n FROM c WHERE a <> b UNION ALL SELECT 'files', count(*) FROM p WHERE a IS DISTINCT FROM b""")
def _(spark, sf):
    found = _engine(spark, sf).diff(1500, 3500)
    return spark.createDataFrame([("chunks", found["changed"]), ("files", found["files"])], "what string, n long")


@query("engine_states", f"""
WITH {PLACED}, t AS (SELECT vec_id, 1000 AS ts, 'NEW' AS type FROM v UNION ALL SELECT vec_id, 2000, 'OLD' FROM v WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 3000, 'OLD' FROM v WHERE vec_id % 5 = 0 AND vec_id % 3 <> 0)
SELECT vec_id::VARCHAR AS place, ts, type FROM t UNION ALL SELECT vec_id::VARCHAR, 2500, 'GONE' FROM v WHERE vec_id % 5 <> 0 OR vec_id % 3 = 0""")
def _(spark, sf):
    engine = _engine(spark, sf)
    late = engine.store.read("states").select(*CHUNK).distinct()
    engine.ingest(2500, states=late.withColumn("type", F.lit("GONE")))  # refused where a state of 3000 stands
    number = ((F.col("rx") + 10) * SIDE + F.col("lx")).cast("string").alias("place")
    return engine.store.read("states").select(number, "ts", "type")
