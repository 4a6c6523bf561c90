"""Container, world files, store, engine, command line, settings: inventory numbers 1-22, 118-145."""

import random
import struct
import zlib

import pytest
from helpers import rows
from pyspark.sql import functions as F

from loamstone.cli import run
from loamstone.config import Config
from loamstone.operators import compare
from loamstone.operators.retention import RetentionPolicy
from loamstone.sources import container, manifest, world

AT = dict(dimension="overworld", rx=-1, rz=2)


def sample_rows():
    r = random.Random(1)

    def chain(kind, section, ordinal, ts, atoms):
        return {"kind": kind, "lx": 3, "lz": 31, "section": section, "ordinal": ordinal, "ts": ts, "atoms": atoms}

    def values(n, width):
        return list(range(n)) + [r.randrange(n) for _ in range(width - n)]

    delta = [None] * 4096
    delta[7] = 5
    base = {"lx": 3, "lz": 31}
    return [
        chain("block", 0, 0, 2000, [7] * 4096), chain("block", 0, 1, 1000, delta), chain("block", 1, 0, 2000, values(256, 4096)), chain("block", 2, 0, 2000, list(range(4096))),
        chain("block", 3, 0, 1000, values(20, 4096)), chain("biome", 5, 0, 1000, values(3, 64)),
        {**base, "kind": "state", "ordinal": 0, "state": "OLD", "ts": 3000}, {**base, "kind": "state", "ordinal": 1, "state": "NEW", "ts": 1000},
        {**base, "kind": "tile", "ordinal": 0, "ts": 2000, "pos": 5, "op": "put", "type": 9, "nbt": b"xyz"}, {**base, "kind": "tile", "ordinal": 1, "ts": 1000, "pos": 5, "op": "erase"},
        {"kind": "block", "lx": 31, "lz": 31, "section": 0, "ordinal": 0, "ts": 1, "atoms": [1] * 4096},
    ]


def test_container_round_trip():
    data = container.serialise(sample_rows(), "overworld")
    assert data[:6] == b"zvcr3d" and data[6:10] == struct.pack("<BBH", 7, 0, 777)
    back = list(container.parse(data))
    assert sorted(map(repr, map(lambda d: sorted(d.items()), back))) == sorted(map(repr, map(lambda d: sorted(d.items()), sample_rows())))
    assert len([r for r in container.parse(data, 1) if r["kind"] == "block"]) == 5


@pytest.mark.parametrize("damage", [lambda d: b"zvcr2d" + d[6:], lambda d: d[:6] + b"\x09" + d[7:], lambda d: d[:7] + b"\x05" + d[8:], lambda d: d[:40], lambda d: d[:8]])
def test_container_rejects(damage):
    with pytest.raises(container.FormatError):
        list(container.parse(damage(container.serialise(sample_rows(), "overworld"))))


def test_container_files(spark, tmp_path):
    good = tmp_path / "overworld/-1/0/r.-1.2.zvcr3d"
    good.parent.mkdir(parents=True)
    good.write_bytes(container.serialise(sample_rows(), "overworld"))
    (tmp_path / "r.0.0.zvcr3d").write_bytes(b"junk")
    found = container.read_regions(spark, str(tmp_path))
    assert found.filter("error is not null").count() == 1
    table = container.chain_rows(found)
    assert table.count() == 7 and table.filter("not is_full").count() == 1 and table.first()["rx"] == -1
    again = container.write_regions(found.filter("error is null").withColumns({"rx": F.lit(-1), "rz": F.lit(2)})).first()
    assert again["path"] == "overworld/-1/0/r.-1.2.zvcr3d"
    assert len(list(container.parse(bytes(again["content"])))) == len(sample_rows())


def tree(value, name=b"", tag=10):
    def text(b):
        return struct.pack(">H", len(b)) + b

    def payload(tag, v):
        if tag == 10:
            return b"".join(bytes([t]) + text(k) + payload(t, x) for k, (t, x) in v.items()) + b"\0"
        if tag == 9:
            return struct.pack(">bi", v[0], len(v[1])) + b"".join(payload(v[0], x) for x in v[1])
        if tag == 8:
            return text(v)
        if tag == 12:
            return struct.pack(">i", len(v)) + struct.pack(f">{len(v)}q", *v)
        return struct.pack({1: ">b", 3: ">i"}[tag], v)

    return bytes([tag]) + text(name) + payload(tag, value)


def chunk(x, z, turned=False):
    cells = [0x1010101010101010 if not turned else 0x0101010101010101] * 256
    palette = [b"m:a", b"m:b"] if not turned else [b"m:b", b"m:a"]
    section = {b"Y": (1, 0), b"block_states": (10, {b"palette": (9, (8, palette)), b"data": (12, cells)}), b"biomes": (10, {b"palette": (9, (8, [b"m:plains"]))})}
    return tree({b"xPos": (3, x), b"zPos": (3, z), b"Status": (8, b"minecraft:full"), b"sections": (9, (10, [section])), b"block_entities": (9, (10, [{b"id": (8, b"m:chest"), b"x": (3, 1), b"y": (3, 2), b"z": (3, 3)}]))})


def region(chunks):
    head, body = bytearray(8192), b""
    for (lx, lz), raw in chunks.items():
        i = lx + lz * 32
        head[4 * i : 4 * i + 4] = (2 + len(body) // 4096).to_bytes(3, "big") + b"\1"
        head[4096 + 4 * i : 4100 + 4 * i] = (1000 + i).to_bytes(4, "big")
        packed = zlib.compress(raw)
        part = struct.pack(">IB", len(packed) + 1, 2) + packed
        body += part + bytes(-len(part) % 4096)
    return bytes(head) + body


def test_world_files(spark, tmp_path):
    for name, turned in (("live", False), ("restored", True)):
        d = tmp_path / name / "region"
        d.mkdir(parents=True)
        (d / "r.0.-1.mca").write_bytes(region({(0, 31): chunk(0, -1, turned), (5, 2): chunk(5, -30, turned)}))
        (tmp_path / name / "level.dat").write_bytes(name.encode())
    headers = world.scan_headers(spark, str(tmp_path / "live"))
    assert rows(headers.select("rx", "rz", "lx", "lz", "header_ts")) == [(0, -1, 0, 31, 1992), (0, -1, 5, 2, 1069)]
    sides = [world.read_sections(spark, str(tmp_path / n)).withColumnsRenamed({"block_names": "names", "block_digest": "digest"}) for n in ("live", "restored")]
    assert sides[0].filter("error is not null").count() == 0 and sides[0].first()["tiles"][0]["type"] == "m:chest"
    assert compare.section_differences(*sides, ["rx", "rz", "lx", "lz", "y"]).count() == 0  # palette order does not matter
    aux = [world.auxiliary_files(spark, str(tmp_path / n)).withColumn("hash", F.sha2("content", 256)) for n in ("live", "restored")]
    assert rows(compare.aux_differences(*aux)) == [("level.dat", "volatile")]


def test_world_tiles(spark, tmp_path):
    (tmp_path / "r.0.0.mca").write_bytes(region({(0, 0): chunk(0, 0)}))
    row = world.read_tiles(spark, str(tmp_path)).first()
    assert (row["pos"], row["type"], bytes(row["nbt"])) == ((2 + 64) << 16 | 3 << 8 | 1, "m:chest", b"\x0a\0")


def test_manifest(spark):
    m = manifest.Manifest(777, ("m:air", "m:stone[a=1]"), ())
    assert manifest.parse(m.text(), m.fingerprint) == m
    registry = manifest.table(spark, [m, manifest.Manifest(777, ("m:air",), ("m:plains",))])
    assert manifest.of_table(registry, m.fingerprint, 777) == m
    for bad in ("x", m.text()[:-30], m.text().replace("fingerprint", "print"), m.text().replace("biomes 0", "biomes 2")):
        with pytest.raises(manifest.ManifestError):
            manifest.parse(bad)
    with pytest.raises(manifest.ManifestError):
        manifest.parse(m.text(), "0" * 64)


def test_scheduled_ingest(spark, tmp_path):
    from loamstone.api import Engine
    from loamstone.streaming.ingest import scheduled_ingest

    e = Engine(spark, str(tmp_path / "s"))
    for ts, atoms in ((1000, [1, 2]), (2000, [1, 9])):
        sections(spark, {1: atoms}).withColumn("ts", F.lit(ts).cast("long")).write.mode("append").parquet(str(tmp_path / "feed"))
        feed = spark.readStream.schema(spark.read.parquet(str(tmp_path / "feed")).schema).parquet(str(tmp_path / "feed"))
        scheduled_ingest(feed, e, str(tmp_path / "c"), None).awaitTermination()
    assert [x["atoms"] for x in e.restore(1500).sections.collect()] == [[1, 2]]
    assert [x["atoms"] for x in e.restore(2500).sections.collect()] == [[1, 9]]


def test_tree_is_canonical():
    a = world.read_tree(tree({b"b": (3, 1), b"a": (8, b"x")}))
    b = world.read_tree(tree({b"a": (8, b"x"), b"b": (3, 1)}))
    assert world.canonical_bytes(a) == world.canonical_bytes(b) and world.plain(a) == {"b": 1, "a": "x"}
    with pytest.raises(world.TreeError):
        world.read_tree(b"\x0a\x00\x00\x63\x00\x00")
    with pytest.raises(world.TreeError):
        world.decompressed(9, b"")


def sections(spark, values):
    data = [("overworld", 0, 0, lx, 0, "block", 0, v) for lx, v in values.items()]
    return spark.createDataFrame(data, "dimension string, rx int, rz int, lx int, lz int, kind string, section int, atoms array<int>")


def tile_items(spark, values):
    return spark.createDataFrame([("overworld", 0, 0, 1, 0, p, 4, bytearray(v)) for p, v in values.items()], "dimension string, rx int, rz int, lx int, lz int, pos long, type long, nbt binary")


def files(spark, values):
    return spark.createDataFrame(list(values.items()), "path string, content string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    from loamstone.api import Engine

    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "s"), checkpoint_every=3)
    assert e.ingest(1000, sections(spark, {1: [1, 2], 2: [5, 5]}), tile_items(spark, {5: b"a", 6: b"b"}), files=files(spark, {"a.txt": "one", "b.txt": "x"})) == {"sections_inserted": 2}
    assert e.ingest(2000, sections(spark, {1: [1, 3], 2: [5, 5]}), tile_items(spark, {6: b"c", 7: b"d"}), files=files(spark, {"a.txt": "two"})) == {"sections_inserted": 1, "sections_no_changes": 1}
    e.ingest(3000, sections(spark, {1: [4, 3], 3: [9, 9]}), tile_items(spark, {6: b"c", 7: b"d"}))
    for t in range(4000, 8000, 1000):
        e.ingest(t, sections(spark, {1: [t, 3]}))
    return e


def state(e, at):
    r = e.restore(at)
    return (
        {x["lx"]: x["atoms"] for x in r.sections.collect()},
        {x["pos"]: bytes(x["nbt"]) for x in r.tiles.collect()},
        {x["path"]: x["content"] for x in r.files.collect()},
    )


def test_engine_time_travel(engine):
    assert state(engine, 1500) == ({1: [1, 2], 2: [5, 5]}, {5: b"a", 6: b"b"}, {"a.txt": "one", "b.txt": "x"})
    assert state(engine, 2000) == ({1: [1, 3], 2: [5, 5]}, {6: b"c", 7: b"d"}, {"a.txt": "two", "b.txt": "x"})
    assert state(engine, 5500)[0] == {1: [5000, 3], 2: [5, 5], 3: [9, 9]}
    assert state(engine, "latest")[0][1] == [7000, 3]
    with pytest.raises(ValueError, match="oldest"):
        engine.restore(10)
    with pytest.raises(ValueError, match="nothing"):
        engine.restore(2000, chunks=False, files=False)


def test_engine_reports(engine, capsys):
    assert engine.diff(1000, 3000) == {"changed": 1, "only_new": 1, "only_old": 0, "files": 1}
    assert [r["ts"] for r in engine.list(now=8000, keep=2).collect()] == [7000, 6000]
    stats = engine.stats()
    assert (stats["segments"], stats["chains"], stats["entries"], stats["max_chain"], stats["tracked_files"], stats["blobs"]) == (3, 3, 9, 7, 2, 3)
    assert engine.verify().count() == 0
    assert engine.inspect_section("overworld", 0, 0, 1, 0, 0).first()["ts"] == 7000
    root = engine.store.root
    assert run(["verify", "--store", root], engine.spark) == 0
    assert run(["list", "--store", root], engine.spark) == 0
    assert run(["stats", "--store", root], engine.spark) == 0
    assert run(["diff", "--store", root, "--older", "1000", "--newer", "2000"], engine.spark) == 0
    assert "1 changed" in capsys.readouterr().out


def states(spark, kinds):
    data = [("overworld", 0, 0, lx, 0, k) for lx, k in kinds.items()]
    return spark.createDataFrame(data, "dimension string, rx int, rz int, lx int, lz int, type string")


def no_tiles(spark):
    return spark.createDataFrame([("overworld", 0, 0, 1, 0, None, None, None)], "dimension string, rx int, rz int, lx int, lz int, pos long, type long, nbt binary")


def test_states_reject_what_is_older_or_equal(spark, tmp_path):
    from loamstone.api import Engine

    e = Engine(spark, str(tmp_path / "s"))
    for ts, kind in ((1000, "NEW"), (2000, "NEW"), (500, "OLD"), (3000, "OLD")):
        e.ingest(ts, states=states(spark, {1: kind}))
    assert rows(e.store.read("states").select("ts", "type")) == [(1000, "NEW"), (3000, "OLD")]


def test_files_are_only_added_to(spark, tmp_path):
    from loamstone.api import Engine

    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(1000, files=files(spark, {"a.dat": "1", "b.dat": "same"}))
    first = e.store.generation()
    e.ingest(2000, files=files(spark, {"a.dat": "2", "b.dat": "same"}))
    e.ingest(1500, files=files(spark, {"a.dat": "late"}))
    now = e.store.generation()
    assert all(first[t].items() <= now[t].items() for t in ("entries", "blobs"))
    assert rows(e.store.read("entries").select("path", "ts")) == [("a.dat", 1000), ("a.dat", 2000), ("b.dat", 1000)]
    assert state_of_files(e, 1600) == {"a.dat": "1", "b.dat": "same"} and state_of_files(e, 2500) == {"a.dat": "2", "b.dat": "same"}
    assert e.verify().count() == 0 and e.stats()["files"] >= 4 and e.stats()["bytes"] > 0


def state_of_files(e, at):
    return {x["path"]: x["content"] for x in e.restore(at, chunks=False).files.collect()}


def test_last_tile_goes_and_comes_back(spark, tmp_path):
    from loamstone.api import Engine

    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(1000, sections(spark, {1: [1]}), tile_items(spark, {5: b"a", 6: b"b"}))
    e.ingest(2000, tile_items=no_tiles(spark))
    e.ingest(2500, tile_items=no_tiles(spark))
    e.ingest(3000, tile_items=tile_items(spark, {6: b"c"}))
    found = {at: {x["pos"]: bytes(x["nbt"]) for x in e.restore(at).tiles.collect()} for at in (1000, 1999, 2000, 2700, 3000)}
    assert found == {1000: {5: b"a", 6: b"b"}, 1999: {5: b"a", 6: b"b"}, 2000: {}, 2700: {}, 3000: {6: b"c"}}
    assert e.verify().count() == 0


def test_batches_hold_a_key_once(spark, tmp_path):
    from loamstone.api import Engine
    from loamstone.streaming.ingest import scheduled_ingest

    e = Engine(spark, str(tmp_path / "s"))
    both = sections(spark, {1: [1, 2]}).unionByName(sections(spark, {1: [3, 4]}))
    with pytest.raises(ValueError, match="more than one row"):
        e.ingest(1000, both)
    assert not e.store.exists()
    timed = sections(spark, {1: [1, 2]}).withColumn("ts", F.lit(1000).cast("long")).unionByName(sections(spark, {1: [3, 4]}).withColumn("ts", F.lit(2000).cast("long")))
    timed.unionByName(timed).coalesce(1).write.parquet(str(tmp_path / "feed"))  # one micro-batch, each row twice
    scheduled_ingest(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "feed")), e, str(tmp_path / "c"), None).awaitTermination()
    assert [[x["atoms"] for x in e.restore(at).sections.collect()] for at in (1500, 2500)] == [[[1, 2]], [[3, 4]]]


def test_verify_finds_damage(spark, tmp_path):
    import pathlib
    import shutil

    from loamstone.api import Engine

    def problems(e, **a):
        return {r["problem"].split(":")[-1].strip() if "unreadable" not in r["problem"] else "unreadable" for r in e.verify(**a).collect()}

    e = Engine(spark, str(tmp_path / "s"))
    assert e.verify().count() == 0
    e.ingest(1000, sections(spark, {1: [1, 2]}), tile_items(spark, {5: b"a"}), states=states(spark, {1: "NEW"}), files=files(spark, {"a": "x", "b": "y"}))
    assert problems(e) == set()
    chain = e.store.read("chains")
    e.store.commit({"chains": chain.unionByName(chain.withColumn("is_full", F.lit(False)).withColumn("ts", F.lit(2000).cast("long"))).unionByName(chain)}, part="sector")
    e.store.commit({"blobs": e.store.read("blobs").limit(1)})
    found = problems(e)
    assert {"the newest entry is not full", "several entries at one time"} <= found and any("1" in p for p in found)
    good = tmp_path / "r/nether/0/0/r.0.0.zvcr3d"  # the folder names another dimension
    good.parent.mkdir(parents=True)
    good.write_bytes(container.serialise([{**r, "ordinal": 1 - r["ordinal"]} if r["ordinal"] < 2 and r["kind"] == "block" else r for r in sample_rows()], "overworld", 776))
    (good.parent / "r.0.1.zvcr3d").write_bytes(b"junk")
    told = [r["problem"] for r in e.verify(regions=str(tmp_path / "r")).collect()]
    assert any(p.startswith("unreadable") for p in told) and any("another dimension" in p for p in told) and any("protocol" in p for p in told)
    folder = next(iter(e.store.generation()["blobs"].values()))
    for f in pathlib.Path(e.store.root, folder).glob("*.parquet"):
        f.write_bytes(b"damaged")
    assert problems(e) == {"unreadable"}
    shutil.rmtree(pathlib.Path(e.store.root, folder))
    assert {r["problem"] for r in e.verify().collect()} == {"missing part of blobs"}


def test_engine_prune(engine):
    with pytest.raises(ValueError):
        engine.prune(RetentionPolicy())
    dry = engine.prune(RetentionPolicy(0, 3), now=8000, dry_run=True)
    assert dry["chains"] == 4 and engine.prune(RetentionPolicy(0, 3), now=8000) == dry
    assert engine.stats()["entries"] == 5 and engine.store.sweep() > 0
    assert state(engine, "latest")[0] == {1: [7000, 3], 2: [5, 5], 3: [9, 9]}


def test_cli_errors(spark, tmp_path):
    assert run([], spark) == 2 and run(["help"], spark) == 0 and run(["explode"], spark) == 2
    assert run(["prune", "--store", "nowhere"], spark) == 2 and run(["diff"], spark) == 2
    assert run(["list", "--store", str(tmp_path / "none")], spark) == 1


def test_config(tmp_path):
    path = tmp_path / "c.properties"
    c = Config.load(path)
    assert c.number("checkpoint-interval") == 32 and c.show()["dimensions"] == "(all)"
    assert c.set("dimensions", " Nether, overworld ,nether") == "nether,overworld"
    for key, bad in (("interval-minutes", "0"), ("threads", "-1"), ("compression-level", "23"), ("backup-on-stop", "maybe"), ("dimensions", "moon"), ("color", "red")):
        with pytest.raises(ValueError):
            c.set(key, bad)
    assert Config.load(path).values["dimensions"] == "nether,overworld"
    assert c.reset("dimensions") == ""
    c.path = tmp_path / "missing" / "c.properties"
    with pytest.raises(OSError):
        c.set("threads", "3")
    assert c.values["threads"] == "0"


def test_contents_that_are_none(spark):
    found = container.parsed(spark.createDataFrame([("a", None), ("b", bytearray())], "path string, content binary"))
    assert rows(found.select("path", F.col("error").isNotNull())) == [("a", True), ("b", True)]


def test_damaged_chunks_are_rows(spark, tmp_path):
    good, junk = chunk(0, 0), b"\x0a\0\0\x09junk"
    tall = world.tree_bytes(world.Typed(10, {"block_entities": world.Typed(3, 1)}))
    chunks = {(i, 0): (i, 2, zlib.compress(raw)) for i, raw in enumerate((good, junk, tall))} | {(3, 0): (3, 2, b"no stream"), (4, 0): (4, 9, good), (5, 0): (5, 4, b"x"), (6, 0): (6, 1, b"x")}
    (tmp_path / "r.0.0.mca").write_bytes(world.region_bytes(chunks))
    tiles = world.read_tiles(spark, str(tmp_path))
    assert rows(tiles.select("lx", F.col("error").isNull())) == [(i, i == 0) for i in range(7)]
    assert rows(world.read_sections(spark, str(tmp_path)).select("lx", F.col("error").isNull())) == [(i, i == 0) for i in range(7)]


def test_region_bytes_round_trip():
    trees = {(x, z): world.Typed(10, {"n": world.Typed(3, x * 32 + z), "long": world.Typed(8, "t" * 300 * z)}) for x, z in ((0, 0), (31, 0), (4, 20), (31, 31))}
    data = world.region_bytes({at: (7, at[0] % 4 + 1, world.compressed(at[0] % 4 + 1, world.tree_bytes(t))) for at, t in trees.items()})
    assert len(data) % world.SECTOR == 0
    assert {(lx, lz): world.chunk_tree(data, start) for lx, lz, _, start in world.chunk_headers(data)} == trees
    with pytest.raises(ValueError):
        world.region_bytes({(32, 0): (1, 3, b"")})


def test_auxiliary_files_below_an_odd_path(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    (root / "data").mkdir(parents=True)
    (root / "data/x.dat").write_bytes(b"1")
    assert rows(world.auxiliary_files(spark, str(root)).select("path")) == [("data/x.dat",)]
