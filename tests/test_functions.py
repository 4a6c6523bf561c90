"""Coordinates, names, palettes: inventory numbers 23-54."""

import hashlib
import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from loamstone.functions import coords, names, palette


def test_floor_and_ids(spark):
    df = spark.createDataFrame([(x,) for x in (0, 31, 32, -1, -31, -32, -33)], "x int")
    assert [r[0] for r in df.select(coords.floor_div32("x")).collect()] == [0, 0, 1, -1, -1, -1, -2]
    ids = spark.createDataFrame([(12345, -6789, 0), (-100000, 100000, 2)], "rx int, rz int, d int")
    back = ids.select(coords.region_of_id(coords.region_id("rx", "rz", "d")).alias("r")).select("r.*")
    assert rows(back) == rows(ids)


def test_segment_bounds(spark):
    df = spark.createDataFrame([(3, 32)], "x int, z int")
    with pytest.raises(Exception, match="0..31"):
        df.select(coords.segment_index("x", "z")).collect()
    assert coords.parse_dimension(" Nether ") == "nether"
    with pytest.raises(ValueError):
        coords.parse_dimension("moon")


def test_file_names(spark):
    df = spark.createDataFrame([("a/r.-3.12.zvcr3d",), ("r.1.2.mca",), ("r.x.2.zvcr3d",), ("r.99999999999.2.zvcr3d",)], "p string")
    assert [r[0] and tuple(r[0]) for r in df.select(coords.region_of_file("p", "zvcr3d")).collect()] == [(-3, 12), None, None, None]


def test_names(spark):
    df = spark.createDataFrame([("m:log", {"b": "2", "a": "1"}), ("m:air", {})], "n string, p map<string,string>")
    assert [r[0] for r in df.select(names.canonical_state("n", "p")).collect()] == ["m:log[a=1,b=2]", "m:air"]
    ages = spark.createDataFrame([(-1,), (5,), (65,), (3700,), (90_000,)], "s long")
    assert [r[0] for r in ages.select(names.human_age("s")).collect()] == ["in the future", "5s ago", "1m ago", "1h 1m ago", "1d 1h ago"]
    assert names.age_range(0, 0) == "of any age" and names.age_range(2, 3) == "between 2 and 3 days old"


def test_fingerprint(spark):
    reg = spark.createDataFrame([("e", "block", 1, "b"), ("e", "block", 0, "a"), ("e", "biome", 0, "p")], "epoch string, kind string, id int, name string")
    want = hashlib.sha256(b"777" + b"\0a" + b"\0b" + b"\xff" + b"\0p").hexdigest()
    assert names.registry_fingerprint(reg, 777).first()["fingerprint"] == want


@pytest.mark.parametrize("distinct", [1, 2, 16, 17, 256, 257, 300])
def test_pack_round_trip(spark, distinct):
    r = random.Random(distinct)
    atoms = list(range(1000, 1000 + distinct)) + [1000 + r.randrange(distinct) for _ in range(4096 - distinct)]
    r.shuffle(atoms)
    df = spark.createDataFrame([(atoms,)], "a array<int>").select("a", palette.packed("a").alias("d"))
    row = df.select("d", palette.unpacked("d", 4096).alias("u")).first()
    assert row["u"] == atoms
    assert (row["d"]["single"] is not None) == (distinct == 1)
    if 1 < distinct <= 256:
        assert row["d"]["palette"] == sorted(set(atoms))


def test_bit_layout_and_sizes(spark):
    assert palette.pack_indices(np.array([1, 2, 3]), 4).tolist() == [0x321]
    with pytest.raises(ValueError):
        palette.unpack_indices(np.zeros(1, np.int64), 16, 5)
    df = spark.createDataFrame([(n,) for n in (1, 2, 16, 17, 256, 257, 300)], "n int")
    got = df.select(palette.bits_per_entry("n"), palette.bits_on_disc("n", True), palette.bits_on_disc("n", False)).collect()
    met = spark.createDataFrame([([500, 3, 500, 42, 3, 42],)], "a array<int>").select(palette.palette_as_met("a"), palette.palette("a")).first()
    assert tuple(met) == ([500, 3, 42], [3, 42, 500])
    assert [tuple(r) for r in got] == [(4, 4, 0), (4, 4, 1), (4, 4, 4), (8, 5, 5), (8, 8, 8), (16, 9, 9), (16, 9, 9)]


def test_section_digest_ignores_palette_order(spark):
    df = spark.createDataFrame([(["b", "a"], [0, 1, 1]), (["a", "b"], [1, 0, 0])], "n array<string>, i array<int>")
    assert df.select(palette.section_digest("n", "i")).distinct().count() == 1
    assert df.select(F.size("n")).count() == 2


def test_palette_table_numbers_by_content(spark):
    found = [[5], [5, 0], [5, 0, 1], [0, 9], [5, 2], [0], [0, 9], [7, 8, 9]]
    data = spark.createDataFrame([((p, len(p)),) for p in found], "data struct<palette: array<int>, bits: int>")
    got = rows(palette.palette_table(data).select("palette_id", "palette"))
    assert got == [(i + 1, p) for i, p in enumerate(sorted(map(list, set(map(tuple, found)))))]
