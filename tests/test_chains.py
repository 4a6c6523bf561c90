"""Histories against a brute-force model: inventory numbers 55-78."""

import random

import pytest
from helpers import rows

from loamstone.operators import chains

SCHEMA = "k int, ts long, atoms array<int>"


def history(seed):
    r = random.Random(seed)
    out = {}
    for k in range(4):
        state, ts, own = [r.randrange(20) for _ in range(8)], 0, []
        for _ in range(r.randrange(1, 24)):
            ts += r.randrange(1, 50)
            own.append((ts, list(state)))
            for _ in range(r.randrange(1, 10)):
                state[r.randrange(8)] = r.randrange(20)
        out[k] = own
    return out


def model(own, at, clamp):
    before = [a for t, a in own if t <= at]
    return before[-1] if before else own[0][1] if clamp else None


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_history(spark, seed):
    h = history(seed)
    feed = spark.createDataFrame([(k, t, a) for k, own in h.items() for t, a in own], SCHEMA)
    states = chains.changes(feed, ["k"], ["atoms"])
    chain = chains.reverse_deltas(states, ["k"], "atoms")
    for source in (chain, chains.checkpoints(states, chain, ["k"], "atoms", 4)):
        source = source.cache()
        for at in (0, 60, 200, 10**6):
            for clamp in (True, False):
                want = [(k, m) for k, own in h.items() if (m := model(own, at, clamp)) is not None]
                assert rows(chains.fold(source, ["k"], "atoms", at, clamp=clamp)) == sorted(want, key=repr)


def test_ladder_and_nearest(spark):
    s = spark.createDataFrame([(1, 1000, "a"), (1, 2000, "b"), (1, 3000, "c"), (1, 4000, "d")], "k int, ts long, v string")
    for at, want in ((500, "a"), (1000, "a"), (2000, "b"), (3500, "c"), (9999, "d")):
        assert rows(chains.as_of(s, ["k"], ["v"], at, clamp=True)) == [(1, want)]
    assert rows(chains.as_of(s, ["k"], ["v"], 500)) == []
    for at, want in ((1100, 1000), (1900, 2000), (1500, 2000), (99, 1000)):
        assert rows(chains.nearest_ts(s, ["k"], at)) == [(1, want)]


def test_insert_rejects(spark):
    heads = spark.createDataFrame([(1, 1000, [7, 7]), (2, 1000, [7, 7]), (3, 1000, [7, 7])], SCHEMA)
    batch = spark.createDataFrame([(1, 2000, [7, 9]), (2, 2000, [7, 7]), (3, 1000, [1, 1]), (4, 5, [1, 2])], SCHEMA)
    got = {r["k"]: (r["status"], r["changes"]) for r in chains.insert(heads, batch, ["k"], "atoms").collect()}
    assert got == {1: ("inserted", 1), 2: ("no_changes", 0), 3: ("older", 0), 4: ("inserted", 2)}


def test_truncate_keeps_head_and_floor(spark):
    s = spark.createDataFrame([(1, t) for t in range(1000, 7000, 1000)] + [(2, 10)], "k int, ts long")
    assert rows(chains.truncate(s, ["k"], 3000)) == [(1, 3000), (1, 4000), (1, 5000), (1, 6000), (2, 10)]
    assert rows(chains.truncate(s, ["k"], 3500, floor=True)) == [(1, 3000), (1, 4000), (1, 5000), (1, 6000), (2, 10)]


def test_states_reject_same_type(spark):
    s = spark.createDataFrame([(1, 1000, "NEW"), (1, 2000, "NEW"), (1, 3000, "OLD")], "k int, ts long, type string")
    assert rows(chains.type_changes(s, ["k"])) == [(1, 1000, "NEW"), (1, 3000, "OLD")]
    assert rows(chains.type_as_of(s, ["k"], 500)) == [(1, "NEW", 500)]


def test_gate(spark):
    scan = spark.createDataFrame([(1, 10), (2, 5), (3, 1)], "k int, header_ts long")
    heads = spark.createDataFrame([(1, 9), (2, 5)], "k int, head_ts long")
    assert rows(chains.gate(scan, heads, ["k"])) == [(1, 10), (3, 1)]


def test_plans_prune_before_reading(spark, sf):
    """A limit per key is applied before the shuffle, and only used columns are read."""
    from loamstone.plans.catalog import QUERIES

    def plan(name):
        return QUERIES[name](spark, sf)._jdf.queryExecution().toString()

    assert "WindowGroupLimit" in plan("depth_limited")
    assert "props" not in plan("asof_state").split("ReadSchema")[-1]
