"""Keyed maps, content-addressed files and retention: inventory numbers 67-76, 85-117."""

import hashlib
import random

import pytest
from helpers import rows

from loamstone.operators import blobs, retention, tiles
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", range(3))
def test_map_history(spark, seed):
    r = random.Random(seed)
    snaps, state = [], {"a": 0}
    for t in range(1, 9):
        snaps.append((t * 10, dict(state)))
        for _ in range(r.randrange(1, 4)):
            k = r.choice("abcd")
            if k in state and len(state) > 1 and r.random() < 0.4:
                del state[k]
            else:
                state[k] = r.randrange(5)
    df = spark.createDataFrame([(1, t, k, v) for t, s in snaps for k, v in s.items()], "k int, ts long, item string, v int")
    deltas = tiles.map_deltas(tiles.map_changes(df, ["k"], "item", "v"), ["k"], "item", "v").cache()
    for at in (5, 10, 35, 80, 99):
        want = [s for t, s in snaps if t <= at] or [snaps[0][1]]
        assert rows(tiles.map_as_of(deltas, ["k"], "item", "v", at)) == sorted((1, k, v) for k, v in want[-1].items())
        checked = tiles.map_checkpoint(deltas, ["k"], "item", "v", 55)
        assert rows(tiles.map_as_of(checked, ["k"], "item", "v", at)) == sorted((1, k, v) for k, v in want[-1].items())


def test_map_put_and_erase(spark):
    df = spark.createDataFrame([(1, 1000, "a", 1), (1, 1000, "b", 2), (1, 2000, "b", 3), (1, 2000, "c", 4)], "k int, ts long, item string, v int")
    got = rows(tiles.map_deltas(df, ["k"], "item", "v").filter("ts = 1000").select("item", "op", "v"))
    assert got == [("a", "put", 1), ("b", "put", 2), ("c", "erase", None)]


@pytest.fixture(scope="module")
def store(spark):
    f = spark.createDataFrame([("a.dat", 1000, "1"), ("a.dat", 2000, "2"), ("b.dat", 2500, "x"), ("a.dat", 3000, "1"), ("Steve.dat", 3000, "s")], "path string, ts long, content string")
    return blobs.history(f), blobs.blobs(f)


def test_blobs(store):
    entries, held = store
    assert entries.count() == 5 and held.count() == 4
    assert blobs.files_as_of(entries, 1500).count() == 1
    assert blobs.files_as_of(entries, 500).count() == 0
    assert blobs.files_as_of(entries, 9999, "sTEVE").count() == 1
    assert {r["hash"] for r in held.collect()} == {hashlib.sha256(x.encode()).hexdigest() for x in "12xs"}
    kept, left = blobs.prune(entries, held, 2500)
    assert kept.count() == 3 and left.count() == 3
    assert blobs.orphans(held, kept).count() == 1 and blobs.missing(left, entries).count() == 1
    assert rows(blobs.diff_files(entries, 1000, 2000).select("path")) == [("a.dat",)]
    assert blobs.totals(entries, held).first()["blob_bytes"] == 4


def test_listing_window(spark):
    now, hour, day = 1_791_288_000, 3600, 86_400
    ages = [4 * hour, 2 * day, 3 * day, 4 * day, int(5.5 * day), -5]
    points = spark.createDataFrame([(now - a,) for a in ages for _ in range(2)], "ts long")
    got = [now - r["ts"] for r in retention.listing(points, now, 2, 3).collect()]
    assert got == [2 * day, 3 * day]
    assert [now - r["ts"] for r in retention.listing(points, now, skip=1, keep=2).collect()] == [2 * day, 3 * day]
    assert retention.listing_since(points, now).first()["ts"] == now + 5


def test_cutoff(spark):
    points = spark.createDataFrame([(1000,), (2000,), (3000,), (4000,)], "ts long")
    assert retention.cutoff_value(points, retention.RetentionPolicy(0, 2), 0) == 3000
    assert retention.cutoff_value(points, retention.RetentionPolicy(0, 10), 0) == retention.NO_CUTOFF
    assert retention.cutoff_value(points.filter("ts < 4000"), retention.RetentionPolicy(10, 2), 100_000) == 2000
    assert retention.cutoff_value(points, retention.RetentionPolicy(1, 0), 90_000) == 3600
    assert retention.RetentionPolicy(0, 0).is_unbounded and "last 3" in retention.RetentionPolicy.of_snapshots(3).describe()
    assert retention.removals(points.withColumn("k", F.lit(1)), ["k"], 3000).first()["removed"] == 2
