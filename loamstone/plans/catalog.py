"""Named queries over the supplied tables, each with its SQL statement of the same result.

Every query runs over whole tables. Queries without SQL say why.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loamstone.functions import coords, names, palette
from loamstone.operators import blobs, chains, compare, inspect, registry, retention, tiles
from loamstone.plans import storage  # noqa: F401  (enters its queries)
from loamstone.plans.register import ORACLE, QUERIES, query  # noqa: F401
from loamstone.plans.tables import (
    ATOMS, EARLY, FILES, LATE, QUANTISED, array_states, daily_maps, feed, files, joined, order_points, quantised, registries, ship_points, table, worlds,
)

ORDERS_NOW = 996_710_400  # a day after the last order date
FEED = "(SELECT user_id, epoch_us(ts) AS ts, event_type, value FROM events)"
STATES = f"""(SELECT user_id, ts, atoms FROM (
  SELECT user_id, ts, atoms, lag(atoms) OVER (PARTITION BY user_id ORDER BY ts) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n
  FROM (SELECT user_id, ts, {ATOMS} AS atoms FROM {FEED})) WHERE n = 1 OR p IS DISTINCT FROM atoms)"""
POINTS = "(SELECT (epoch_us(o_orderdate) // 1000000)::BIGINT AS ts FROM orders)"
TEXT = "array_to_string(list_transform({0}, lambda x: coalesce(x::VARCHAR, '-')), ',')"
USER = ["user_id"]


# --- points in time -----------------------------------------------------------------------------------------------


@query("two_point_diff", f"""
SELECT user_id, CASE WHEN a IS NULL THEN 'only_new' WHEN a IS DISTINCT FROM b THEN 'changed' ELSE 'same' END AS status
FROM (SELECT user_id, arg_max(event_type, ts) FILTER (WHERE ts <= {EARLY}) AS a, arg_max(event_type, ts) AS b FROM {FEED} WHERE ts <= {LATE} GROUP BY user_id)""")
def _(spark, sf):
    return inspect.two_points(feed(spark, sf), USER, ["event_type"], EARLY, LATE)


@query("asof_state", f"SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM {FEED} WHERE ts <= {EARLY} GROUP BY user_id")
def _(spark, sf):
    return chains.as_of(feed(spark, sf), USER, ["event_type", "value"], EARLY)


@query("asof_clamped", f"""
SELECT user_id, coalesce(arg_max(event_type, ts) FILTER (WHERE ts <= {EARLY}), arg_min(event_type, ts)) AS event_type FROM {FEED} GROUP BY user_id""")
def _(spark, sf):
    return chains.as_of(feed(spark, sf), USER, ["event_type"], EARLY, clamp=True)


@query("version_history", f"""
SELECT user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM {FEED}) WHERE p IS NULL OR p <> event_type""")
def _(spark, sf):
    return chains.changes(feed(spark, sf), USER, ["event_type"])


@query("reverse_deltas", f"""
SELECT user_id, ts, {TEXT.format("list_transform(range(1, 5), lambda i: CASE WHEN w IS NULL OR atoms[i] <> w[i] THEN atoms[i] END)")} AS delta, w IS NULL AS is_full
FROM (SELECT *, lead(atoms) OVER (PARTITION BY user_id ORDER BY ts) AS w FROM {STATES})""")
def _(spark, sf):
    chain = chains.reverse_deltas(array_states(spark, sf), USER, "atoms")
    return chain.select("user_id", "ts", joined("atoms").alias("delta"), "is_full")


@query("array_asof", f"SELECT user_id, {TEXT.format('arg_max(atoms, ts)')} AS atoms FROM {STATES} WHERE ts <= {LATE} GROUP BY user_id")
def _(spark, sf):
    chain = chains.reverse_deltas(array_states(spark, sf), USER, "atoms")
    return chains.fold(chain, USER, "atoms", LATE, clamp=False).select("user_id", joined("atoms").alias("atoms"))


@query("array_asof_checkpointed", f"""
SELECT user_id, {TEXT.format(f'coalesce(arg_max(atoms, ts) FILTER (WHERE ts <= {EARLY}), arg_min(atoms, ts))')} AS atoms FROM {STATES} GROUP BY user_id""")
def _(spark, sf):
    states = array_states(spark, sf)
    chain = chains.checkpointed(states, USER, "atoms", 8)
    return chains.fold(chain, USER, "atoms", EARLY).select("user_id", joined("atoms").alias("atoms"))


@query("checkpoints", f"""
SELECT user_id, ts, (w IS NULL OR n % 8 = 0) AS is_full,
       {TEXT.format("list_transform(range(1, 5), lambda i: CASE WHEN w IS NULL OR n % 8 = 0 OR atoms[i] <> w[i] THEN atoms[i] END)")} AS delta
FROM (SELECT *, lead(atoms) OVER (PARTITION BY user_id ORDER BY ts) AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM {STATES})""")
def _(spark, sf):
    states = array_states(spark, sf)
    chain = chains.checkpointed(states, USER, "atoms", 8)
    return chain.select("user_id", "ts", "is_full", joined("atoms").alias("delta"))


@query("deltas_since_full", f"""
SELECT user_id, count(*) AS deltas FROM (
  SELECT user_id, sum((n % 8 = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts DESC) AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS d FROM {STATES}) WHERE d > 1)
WHERE seen = 0 GROUP BY user_id""")
def _(spark, sf):
    states = array_states(spark, sf)
    chain = chains.checkpointed(states, USER, "atoms", 8)
    return chains.deltas_since_full(chain, USER)


@query("nearest_ts", f"SELECT user_id, arg_min(ts, abs(ts - {EARLY})) AS nearest_ts FROM {FEED} GROUP BY user_id")
def _(spark, sf):
    return chains.nearest_ts(feed(spark, sf), USER, EARLY)


@query("nearest_state", f"""
SELECT user_id, arg_min(ts, abs(ts - {LATE})) AS ts, arg_min(event_type, abs(ts - {LATE})) AS event_type FROM {FEED} GROUP BY user_id""")
def _(spark, sf):
    return chains.nearest(feed(spark, sf), USER, ["event_type"], LATE)


@query("depth_limited", f"SELECT user_id, ts, event_type FROM {FEED} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 3")
def _(spark, sf):
    return chains.newest(feed(spark, sf).select("user_id", "ts", "event_type"), USER, 3)


@query("prune_chains", f"SELECT user_id, ts, event_type FROM {FEED} QUALIFY ts >= {LATE} OR row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def _(spark, sf):
    return chains.truncate(feed(spark, sf).select("user_id", "ts", "event_type"), USER, LATE)


@query("prune_chains_floor", f"""
SELECT user_id, ts, event_type FROM {FEED} QUALIFY ts >= {LATE} OR coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts) > {LATE}, TRUE)""")
def _(spark, sf):
    return chains.truncate(feed(spark, sf).select("user_id", "ts", "event_type"), USER, LATE, floor=True)


@query("insert_outcomes", f"""
WITH s AS {STATES}, h AS (SELECT user_id, max(ts) AS hts, arg_max(atoms, ts) AS h FROM s WHERE ts <= {LATE} GROUP BY user_id),
b AS (SELECT user_id, max(ts) AS ts, arg_max(atoms, ts) AS atoms FROM (SELECT user_id, ts, {ATOMS} AS atoms FROM {FEED}) GROUP BY user_id),
j AS (SELECT b.*, h.hts, len(list_filter(range(1, 5), lambda i: b.atoms[i] IS DISTINCT FROM h.h[i])) AS d FROM b LEFT JOIN h USING (user_id))
SELECT user_id, ts, CASE WHEN hts IS NULL THEN 'inserted' WHEN ts <= hts THEN 'older' WHEN d = 0 THEN 'no_changes' ELSE 'inserted' END AS status,
       CASE WHEN hts IS NULL THEN 4 WHEN ts <= hts THEN 0 ELSE d END::INTEGER AS changes FROM j""")
def _(spark, sf):
    states = array_states(spark, sf)
    heads = states.filter(F.col("ts") <= LATE).groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("atoms", "ts").alias("atoms"))
    from loamstone.plans.tables import atoms

    batch = feed(spark, sf).select("user_id", "ts", atoms().alias("atoms")).groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("atoms", "ts").alias("atoms"))
    return chains.insert(heads, batch, USER, "atoms").drop("atoms")


@query("section_changes", f"""
WITH f AS (SELECT user_id, event_type, ts, {ATOMS} AS atoms FROM {FEED}),
h AS (SELECT user_id, event_type, max(ts) AS hts, arg_max(atoms, ts) AS h FROM f WHERE ts <= {LATE} GROUP BY ALL),
b AS (SELECT user_id, event_type, max(ts) AS ts, arg_max(atoms, ts) AS atoms FROM f GROUP BY ALL)
SELECT user_id, sum(CASE WHEN hts IS NULL THEN 4 WHEN ts <= hts THEN 0 ELSE len(list_filter(range(1, 5), lambda i: b.atoms[i] IS DISTINCT FROM h.h[i])) END)::BIGINT AS changes
FROM b LEFT JOIN h USING (user_id, event_type) GROUP BY user_id""")
def _(spark, sf):
    from loamstone.plans.tables import atoms

    section = ["user_id", "event_type"]
    f = feed(spark, sf).select(*section, "ts", atoms().alias("atoms"))
    heads, batch = (x.groupBy(*section).agg(F.max("ts").alias("ts"), F.max_by("atoms", "ts").alias("atoms")) for x in (f.filter(F.col("ts") <= LATE), f))
    return chains.section_changes(chains.insert(heads, batch, section, "atoms"), USER)


@query("type_asof", f"SELECT user_id, coalesce(arg_max(event_type, ts) FILTER (WHERE ts <= {EARLY}), arg_min(event_type, ts)) AS type, {EARLY}::BIGINT AS ts FROM {FEED} GROUP BY user_id")
def _(spark, sf):
    states = chains.type_changes(feed(spark, sf).withColumnRenamed("event_type", "type"), USER)
    return chains.type_as_of(states, USER, EARLY)


@query("born_by", f"SELECT user_id, min(ts) AS first_ts FROM {FEED} GROUP BY user_id HAVING min(ts) <= {EARLY}")
def _(spark, sf):
    return chains.born_by(feed(spark, sf), USER, EARLY)


@query("change_gate", f"""
WITH h AS (SELECT user_id, max(ts) AS h FROM {FEED} WHERE ts <= {LATE} GROUP BY user_id)
SELECT user_id, event_type, ts AS header_ts FROM {FEED} LEFT JOIN h USING (user_id) WHERE coalesce(h, 0) = 0 OR ts > h""")
def _(spark, sf):
    scan = feed(spark, sf).select("user_id", "event_type", F.col("ts").alias("header_ts"))
    held = feed(spark, sf).filter(F.col("ts") <= LATE)
    return chains.gate(scan, chains.head_ts([held], USER), USER)


@query("asof_join", f"""
SELECT l.user_id, l.ts, l.value AS paid, r.value AS seen FROM (SELECT * FROM {FEED} WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM {FEED} WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def _(spark, sf):
    f = feed(spark, sf)
    paid = f.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("paid"))
    return chains.as_of_join(paid, f.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen")), USER, ["seen"])


@query("streaming_changes", f"""
SELECT user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM {FEED}) WHERE p IS NULL OR p <> event_type""")
def _(spark, sf):
    from loamstone.streaming.ingest import replayed_changes

    return replayed_changes(spark, f"{sf}/events.parquet")


# --- keyed maps ---------------------------------------------------------------------------------------------------

DAYS = f"(SELECT user_id, ts // 86400000000 AS ts, event_type AS item, count(*) AS n FROM {FEED} GROUP BY ALL)"
CHANGED_DAYS = f"""(SELECT d.* FROM {DAYS} d JOIN (
  SELECT user_id, ts FROM (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM (
    SELECT user_id, ts, list((item, n) ORDER BY item) AS c FROM {DAYS} GROUP BY ALL)) WHERE p IS NULL OR p <> c) v USING (user_id, ts))"""
MAP_DELTAS = f"""
WITH s AS {CHANGED_DAYS}, t AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS w FROM (SELECT DISTINCT user_id, ts FROM s)),
o AS (SELECT s.*, w FROM s JOIN t USING (user_id, ts)), n AS (SELECT t.user_id, t.ts, item, s.n FROM t JOIN s ON s.user_id = t.user_id AND s.ts = t.w)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.ts, n.ts) AS ts, coalesce(o.item, n.item) AS item,
       CASE WHEN o.item IS NULL THEN 'erase' ELSE 'put' END AS op, o.n AS n
FROM o FULL JOIN n ON o.user_id = n.user_id AND o.ts = n.ts AND o.item = n.item
WHERE o.item IS NULL OR o.w IS NULL OR o.n IS DISTINCT FROM n.n"""
DAY = EARLY // 86_400_000_000 + 5


def _map_deltas(spark, sf):
    return tiles.map_deltas(tiles.map_changes(daily_maps(spark, sf), USER, "item", "n"), USER, "item", "n")


@query("map_deltas", MAP_DELTAS)
def _(spark, sf):
    return _map_deltas(spark, sf)


MAP_AS_OF = f"""
WITH s AS {CHANGED_DAYS}, f AS (SELECT user_id, coalesce(max(ts) FILTER (WHERE ts <= {DAY}), min(ts)) AS ts FROM s GROUP BY user_id)
SELECT user_id, item, n FROM s JOIN f USING (user_id, ts)"""


@query("map_asof", MAP_AS_OF)
def _(spark, sf):
    return tiles.map_as_of(_map_deltas(spark, sf), USER, "item", "n", DAY)


@query("map_asof_checkpointed", MAP_AS_OF)
def _(spark, sf):
    deltas = tiles.map_checkpoint(_map_deltas(spark, sf), USER, "item", "n", DAY + 3)
    return tiles.map_as_of(deltas, USER, "item", "n", DAY)


@query("map_truncate", f"WITH d AS ({MAP_DELTAS}) SELECT * FROM d QUALIFY ts >= {DAY} OR ts = max(ts) OVER (PARTITION BY user_id)")
def _(spark, sf):
    return tiles.map_truncate(_map_deltas(spark, sf), USER, DAY)


@query("map_nearest", f"WITH d AS ({MAP_DELTAS}) SELECT user_id, arg_min(ts, (abs(ts - {DAY}), -ts)) AS nearest_ts FROM d GROUP BY user_id")
def _(spark, sf):
    return tiles.map_nearest(_map_deltas(spark, sf), USER, DAY)


@query("diff_chunks", f"""
WITH f AS (SELECT user_id, event_type, ts, {ATOMS} AS atoms FROM {FEED}),
a AS (SELECT user_id, event_type, arg_max(atoms, ts) AS v FROM f WHERE ts <= {EARLY} GROUP BY ALL), b AS (SELECT user_id, event_type, arg_max(atoms, ts) AS v FROM f WHERE ts <= {LATE} GROUP BY ALL),
x AS (SELECT user_id, list((event_type, v) ORDER BY event_type) AS v FROM a GROUP BY ALL), y AS (SELECT user_id, list((event_type, v) ORDER BY event_type) AS v FROM b GROUP BY ALL)
SELECT user_id, CASE WHEN x.v IS NULL THEN 'only_new' WHEN y.v IS NULL THEN 'only_old' ELSE 'changed' END AS status FROM x FULL JOIN y USING (user_id) WHERE x.v IS DISTINCT FROM y.v""")
def _(spark, sf):
    from loamstone.plans.tables import atoms

    section = ["user_id", "kind", "section"]
    f = feed(spark, sf).select("user_id", F.lit("block").alias("kind"), F.col("event_type").alias("section"), "ts", atoms().alias("atoms"))
    chain = chains.reverse_deltas(chains.changes(f, section, ["atoms"]), section, "atoms")
    return inspect.diff_chunks(chain, None, EARLY, LATE, USER)


# --- content-addressed files --------------------------------------------------------------------------------------

HISTORY = f"""(SELECT path, ts, hash FROM (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY ts) AS p FROM (SELECT path, ts, sha256(content) AS hash FROM {FILES})) WHERE p IS NULL OR p <> hash)"""
STORE = f"(SELECT DISTINCT sha256(content) AS hash, content FROM {FILES})"
MID, CUT = 500, 600


@query("blob_history", f"SELECT * FROM {HISTORY}")
def _(spark, sf):
    return blobs.history(files(spark, sf))


@query("blob_dedup", f"SELECT hash, strlen(content)::BIGINT AS bytes FROM {STORE}")
def _(spark, sf):
    return blobs.blobs(files(spark, sf)).select("hash", F.octet_length("content").cast("long").alias("bytes"))


@query("blob_asof", f"SELECT path, arg_max(hash, ts) AS hash FROM {HISTORY} WHERE ts <= {MID} GROUP BY path")
def _(spark, sf):
    return blobs.files_as_of(blobs.history(files(spark, sf)), MID)


@query("blob_restore_filtered", f"""
SELECT path, hash, content FROM (SELECT path, arg_max(hash, ts) AS hash FROM {HISTORY} WHERE ts <= {MID} AND contains(lower(path), '.txt') GROUP BY path) JOIN {STORE} USING (hash)""")
def _(spark, sf):
    f = files(spark, sf)
    return blobs.restored(blobs.history(f), blobs.blobs(f), MID, ".txt").select("path", "hash", "content")


@query("blob_refcount", f"SELECT hash, count(*) AS refs FROM {HISTORY} GROUP BY hash")
def _(spark, sf):
    return blobs.reference_counts(blobs.history(files(spark, sf)))


@query("blob_orphans", f"SELECT hash FROM {STORE} WHERE hash NOT IN (SELECT hash FROM {HISTORY} WHERE ts <= {MID})")
def _(spark, sf):
    f = files(spark, sf)
    return blobs.orphans(blobs.blobs(f), blobs.history(f).filter(F.col("ts") <= MID)).select("hash")


@query("blob_missing", f"SELECT hash, count(*) AS refs FROM {HISTORY} WHERE hash NOT IN (SELECT sha256(content) FROM {FILES} WHERE ts <= {MID}) GROUP BY hash")
def _(spark, sf):
    f = files(spark, sf)
    return blobs.missing(blobs.blobs(f.filter(F.col("ts") <= MID)), blobs.history(f))


PRUNED = f"(SELECT * FROM {HISTORY} QUALIFY ts >= {CUT} OR row_number() OVER (PARTITION BY path ORDER BY ts DESC) = 1)"


@query("blob_prune", f"SELECT * FROM {PRUNED}")
def _(spark, sf):
    f = files(spark, sf)
    return blobs.prune(blobs.history(f), blobs.blobs(f), CUT)[0]


@query("blob_gc", f"SELECT hash FROM {STORE} WHERE hash IN (SELECT hash FROM {PRUNED})")
def _(spark, sf):
    f = files(spark, sf)
    return blobs.prune(blobs.history(f), blobs.blobs(f), CUT)[1].select("hash")


@query("blob_totals", f"""
SELECT (SELECT count(DISTINCT path) FROM {HISTORY}) AS tracked_files, (SELECT count(*) FROM {HISTORY}) AS entries, (SELECT min(ts) FROM {HISTORY}) AS oldest_ts,
       (SELECT max(ts) FROM {HISTORY}) AS newest_ts, (SELECT count(*) FROM {STORE}) AS blobs, (SELECT sum(strlen(content))::BIGINT FROM {STORE}) AS blob_bytes""")
def _(spark, sf):
    f = files(spark, sf)
    return blobs.totals(blobs.history(f), blobs.blobs(f))


@query("file_diff", f"""
SELECT path, a AS old_hash, b AS new_hash FROM (SELECT path, arg_max(hash, ts) FILTER (WHERE ts <= {MID}) AS a, arg_max(hash, ts) FILTER (WHERE ts <= {CUT}) AS b FROM {HISTORY} GROUP BY path)
WHERE a IS DISTINCT FROM b""")
def _(spark, sf):
    return blobs.diff_files(blobs.history(files(spark, sf)), MID, CUT)


@query("blob_verify", f"""
WITH s AS (SELECT hash, CASE WHEN hash LIKE '0%' THEN content || '?' ELSE content END AS content FROM {STORE} WHERE hash NOT LIKE 'f%'), e AS (SELECT * FROM {HISTORY} WHERE ts > 100)
SELECT hash AS place, 'orphan blob' AS problem FROM s WHERE hash NOT IN (SELECT hash FROM e)
UNION ALL SELECT hash, 'missing blob, references: ' || count(*) FROM e WHERE hash NOT IN (SELECT hash FROM s) GROUP BY hash
UNION ALL SELECT hash, 'corrupt blob, content is ' || sha256(content) FROM s WHERE hash IN (SELECT hash FROM e) AND sha256(content) <> hash""")
def _(spark, sf):
    f = files(spark, sf)
    damaged = blobs.blobs(f).filter("hash not like 'f%'").withColumn("content", F.when(F.col("hash").startswith("0"), F.concat("content", F.lit("?"))).otherwise(F.col("content")))
    return inspect.problems(entries=blobs.history(f).filter("ts > 100"), store=damaged)


# --- restore points and retention ---------------------------------------------------------------------------------

SHIPS = "(SELECT (epoch_us(l_shipdate) // 1000000)::BIGINT AS ts FROM lineitem)"


@query("restore_points", f"SELECT ts FROM {POINTS} UNION SELECT ts FROM {SHIPS}")
def _(spark, sf):
    return retention.restore_points(order_points(spark, sf), ship_points(spark, sf))


@query("list_window", f"""
SELECT DISTINCT ts FROM {POINTS} WHERE {ORDERS_NOW} - ts BETWEEN 2 * 86400 AND 900 * 86400 ORDER BY ts DESC LIMIT 50 OFFSET 10""")
def _(spark, sf):
    return retention.listing(order_points(spark, sf), ORDERS_NOW, 2, 900, skip=10, keep=50)


@query("list_since", f"SELECT DISTINCT ts FROM {POINTS} WHERE ts >= {ORDERS_NOW} - 400 * 86400")
def _(spark, sf):
    return retention.listing_since(order_points(spark, sf), ORDERS_NOW, 400)


@query("nth_newest", f"SELECT min(ts) AS cutoff FROM (SELECT DISTINCT ts FROM {POINTS} ORDER BY ts DESC LIMIT 25)")
def _(spark, sf):
    return retention.nth_newest(order_points(spark, sf), 25)


@query("cutoff", f"SELECT greatest(min(ts), {ORDERS_NOW} - 30 * 86400)::BIGINT AS cutoff FROM (SELECT DISTINCT ts FROM {POINTS} ORDER BY ts DESC LIMIT 25)")
def _(spark, sf):
    return retention.cutoff(order_points(spark, sf), retention.RetentionPolicy(30, 25), ORDERS_NOW)


@query("point_bounds", f"SELECT min(ts) AS oldest_ts, max(ts) AS newest_ts FROM {POINTS}")
def _(spark, sf):
    return retention.bounds(order_points(spark, sf))


@query("points_per_key", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT epoch_us(o_orderdate) // 1000000)), ',') AS points FROM orders GROUP BY o_custkey")
def _(spark, sf):
    from loamstone.plans.tables import micros

    history = table(spark, sf, "orders").select("o_custkey", F.floor(micros("o_orderdate") / 1_000_000).cast("long").alias("ts"))
    return retention.points_per_key(history, ["o_custkey"]).select("o_custkey", joined("points").alias("points"))


@query("prune_dry_run", f"""
SELECT user_id, count(*) AS removed FROM (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id) AS m FROM {FEED}) WHERE ts < {LATE} AND ts < m GROUP BY user_id""")
def _(spark, sf):
    return retention.removals(feed(spark, sf), USER, LATE)


# --- statistics and verification ----------------------------------------------------------------------------------


@query("chain_stats", f"""
SELECT count(*) AS chains, sum(n)::BIGINT AS entries, min(n) AS min_chain, max(n) AS max_chain, avg(n) AS avg_chain FROM (SELECT user_id, count(*) AS n FROM {STATES} GROUP BY user_id)""")
def _(spark, sf):
    return inspect.chain_stats(array_states(spark, sf), USER)


@query("palette_stats", f"""
WITH p AS (SELECT list_sort(list_distinct(atoms)) AS p FROM {STATES} WHERE len(list_distinct(atoms)) > 1)
SELECT count(*) AS refs, count(DISTINCT p) AS distinct_palettes, count(DISTINCT p)::DOUBLE / count(*) AS dedup_ratio FROM p""")
def _(spark, sf):
    states = array_states(spark, sf).filter(~palette.is_single("atoms"))
    return inspect.palette_stats(states.select(palette.palette("atoms").alias("palette")))


@query("chain_order", f"""
SELECT DISTINCT user_id FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ordinal) AS p
  FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 250 THEN 0 ELSE 1 END, ts DESC) AS ordinal FROM {FEED})) WHERE ts > p""")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.when(F.col("value") > 250, 0).otherwise(1), F.desc("ts"))
    return inspect.unordered(feed(spark, sf).withColumn("ordinal", F.row_number().over(w)), USER)


@query("state_counts", f"SELECT event_type, count(*) AS n FROM (SELECT user_id, arg_max(event_type, ts) AS event_type FROM {FEED} WHERE ts <= {LATE} GROUP BY user_id) GROUP BY event_type")
def _(spark, sf):
    return inspect.state_counts(feed(spark, sf), USER, ["event_type"], LATE)


@query("atom_summary", f"""
SELECT user_id, count(*) AS entries, sum(len(list_filter(atoms, lambda x: x <> 0)))::BIGINT AS nonzero, max(list_max(atoms)) AS max_atom FROM {STATES} GROUP BY user_id""")
def _(spark, sf):
    return inspect.atom_summary(array_states(spark, sf), USER)


# --- palettes -----------------------------------------------------------------------------------------------------


@query("palette_canonical", f"SELECT vec_id, array_to_string(list_sort(list_distinct(atoms)), ',') AS palette, len(list_distinct(atoms)) = 1 AS single FROM {QUANTISED}")
def _(spark, sf):
    return quantised(spark, sf).select("vec_id", joined(palette.palette("atoms")).alias("palette"), palette.is_single("atoms").alias("single"))


@query("palette_sizes", f"""
WITH n AS (SELECT vec_id, len(list_distinct(atoms))::INT AS n FROM {QUANTISED}), b AS (SELECT *, CASE WHEN n <= 16 THEN 4 WHEN n <= 256 THEN 8 ELSE 16 END AS bits FROM n)
SELECT vec_id, bits, (64 // bits)::INT AS per_long, ceil(64.0 / (64 // bits))::INT AS longs, greatest(4, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END)::INT AS disc_bits FROM b""")
def _(spark, sf):
    n = quantised(spark, sf).select("vec_id", F.size(F.array_distinct("atoms")).alias("n"))
    bits = palette.bits_per_entry("n")
    return n.select("vec_id", bits.alias("bits"), palette.values_per_long(bits).alias("per_long"), palette.packed_length(F.lit(64), bits).alias("longs"), palette.bits_on_disc("n", True).cast("int").alias("disc_bits"))


@query("pack_round_trip", f"SELECT vec_id, array_to_string(atoms, ',') AS atoms, (CASE WHEN len(list_distinct(atoms)) <= 16 THEN 4 ELSE 16 END)::INT AS cells FROM {QUANTISED}".replace("ELSE 16 END)", "ELSE 8 END)"))
def _(spark, sf):
    packed = quantised(spark, sf).select("vec_id", palette.packed("atoms").alias("data"))
    return packed.select("vec_id", joined(palette.unpacked("data", 64)).alias("atoms"), F.size("data.cells").alias("cells"))


@query("palette_table", f"""
SELECT dense_rank() OVER (ORDER BY p)::INT AS palette_id, array_to_string(p, ',') AS palette FROM (SELECT DISTINCT list_sort(list_distinct(atoms)) AS p FROM {STATES} WHERE len(list_distinct(atoms)) > 1)""")
def _(spark, sf):
    packed = array_states(spark, sf).select(palette.packed("atoms").alias("data"))
    return palette.palette_table(packed).select("palette_id", joined("palette").alias("palette"))


@query("concat_sections", f"SELECT vec_id // 24 AS chunk, array_to_string(flatten(list(atoms ORDER BY vec_id)), ',') AS atoms FROM {QUANTISED} GROUP BY vec_id // 24")
def _(spark, sf):
    sections = quantised(spark, sf).select(F.floor(F.col("vec_id") / 24).alias("chunk"), (F.col("vec_id") % 24).alias("section"), "atoms")  # a chunk has 24
    return palette.concat_sections(sections, ["chunk"]).select("chunk", joined("atoms").alias("atoms"))


@query("section_digest", f"""
WITH a AS (SELECT vec_id, unnest(range(0, 64)) AS i, 'b' || unnest(atoms) AS name FROM {QUANTISED}),
r AS (SELECT vec_id, i, dense_rank() OVER (PARTITION BY vec_id ORDER BY name) - 1 AS k FROM a)
SELECT vec_id, sha1(unhex(string_agg(printf('%02x%02x', k % 256, k // 256), '' ORDER BY i))) AS digest FROM r GROUP BY vec_id""")
def _(spark, sf):
    q = quantised(spark, sf).withColumn("p", palette.palette("atoms"))
    entries = q.select("vec_id", F.transform("p", lambda x: F.concat(F.lit("b"), x.cast("string"))).alias("names"), F.transform("atoms", lambda a: F.array_position("p", a).cast("int") - 1).alias("index"))
    return entries.select("vec_id", palette.section_digest("names", "index").alias("digest"))


# --- registries ---------------------------------------------------------------------------------------------------

MAPPING = """(SELECT 'block' AS kind, o.n_nationkey::INT AS old_id, coalesce(b.id, s.id)::INT AS new_id, o.n_name AS name, b.id IS NULL AS missing
  FROM nation o LEFT JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS id FROM nation WHERE n_nationkey <> 7) b USING (n_name),
       (SELECT row_number() OVER (ORDER BY n_name) - 1 AS id, n_name AS spare FROM nation WHERE n_nationkey <> 7) s WHERE s.spare = 'NATION_0')"""


def _mapping(spark, sf):
    old, new = registries(spark, sf)
    return registry.id_map(old, new, {"block": "NATION_0"})


@query("id_map", f"SELECT * FROM {MAPPING}")
def _(spark, sf):
    return _mapping(spark, sf)


@query("remap_rows", f"SELECT c_custkey, m.new_id AS atom FROM customer JOIN {MAPPING} m ON m.old_id = c_nationkey")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.lit("block").alias("kind"), F.col("c_nationkey").cast("int").alias("atom"))
    return registry.remap_rows(rows, _mapping(spark, sf), "atom").drop("kind")


NATION_ARRAYS = "(SELECT c_custkey, [c_nationkey::INT, NULL, (c_custkey % 25)::INT] AS atoms FROM customer)"


@query("remap_arrays", f"""
WITH m AS (SELECT list(new_id ORDER BY old_id) AS m FROM {MAPPING}) SELECT c_custkey, {TEXT.format("list_transform(atoms, lambda x: m[x + 1])")} AS atoms FROM {NATION_ARRAYS}, m""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.lit("block").alias("kind"), F.array(F.col("c_nationkey").cast("int"), F.lit(None).cast("int"), (F.col("c_custkey") % 25).cast("int")).alias("atoms"))
    return registry.remap_arrays(rows, _mapping(spark, sf), "atoms").select("c_custkey", joined("atoms").alias("atoms"))


@query("missing_names", f"SELECT 'block' AS kind, count(*) AS missing FROM customer JOIN {MAPPING} m ON m.old_id = c_nationkey WHERE m.missing HAVING count(*) > 0")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(F.lit("block").alias("kind"), F.col("c_nationkey").cast("int").alias("atom"))
    return registry.missing_counts(rows, _mapping(spark, sf))


@query("name_index", "SELECT 'block' AS kind, p_name AS name, min(p_partkey)::INT AS id FROM part GROUP BY p_name")
def _(spark, sf):
    return registry.name_index(table(spark, sf, "part").select(F.lit("block").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("id")))


@query("registry_fingerprint", f"""
WITH names AS (SELECT 'a' AS epoch, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'b', row_number() OVER (ORDER BY n_name), n_name FROM nation WHERE n_nationkey <> 7)
SELECT epoch, sha256(unhex(hex('{inspect.PROTOCOL}') || string_agg('00' || hex(name), '' ORDER BY id) || 'FF')) AS fingerprint FROM names GROUP BY epoch""")
def _(spark, sf):
    old, new = registries(spark, sf)
    return names.registry_fingerprint(old.unionByName(new), inspect.PROTOCOL)


# --- comparison ---------------------------------------------------------------------------------------------------

WORLDS = """
WITH live AS (SELECT c_custkey % 40 AS cx, c_custkey // 40 AS cz, c_name || '|' || c_mktsegment AS content, CASE WHEN c_custkey % 5 = 0 THEN 'minecraft:noise' ELSE 'minecraft:full' END AS status, c_custkey AS k FROM customer),
moved AS (SELECT cx + CASE WHEN k % 13 = 0 THEN 100 ELSE 0 END AS cx, cz, CASE WHEN k % 11 = 0 THEN content || '!' ELSE content END AS content, status, k FROM live WHERE k % 7 <> 0),
restored AS (SELECT m.cx, m.cz, CASE WHEN m.k % 17 = 0 AND n.content IS NOT NULL THEN n.content ELSE m.content END AS content, m.status, m.k FROM moved m LEFT JOIN live n ON n.cx - 1 = m.cx AND n.cz = m.cz),
classified AS (SELECT coalesce(l.cx, r.cx) AS cx, coalesce(l.cz, r.cz) AS cz, l.content AS live, r.content AS restored,
  CASE WHEN r.k IS NULL AND l.status = 'minecraft:full' THEN 'missing' WHEN r.k IS NULL THEN 'missing_not_full' WHEN l.k IS NULL THEN 'extra' WHEN l.content = r.content THEN 'equal' ELSE 'mismatched' END AS outcome
  FROM live l FULL JOIN restored r ON l.cx = r.cx AND l.cz = r.cz),
placed AS (SELECT c.cx, c.cz, l.cx AS at_cx, l.cz AS at_cz FROM classified c JOIN live l ON l.content = c.restored AND (l.cx, l.cz) <> (c.cx, c.cz) WHERE c.outcome = 'mismatched'
  QUALIFY row_number() OVER (PARTITION BY c.cx, c.cz ORDER BY l.cx, l.cz) = 1)"""
PLACE = ["cx", "cz"]


@query("compare_chunks", WORLDS + "SELECT cx, cz, outcome FROM classified")
def _(spark, sf):
    live, restored = worlds(spark, sf)
    return compare.classify(live, restored, PLACE, status="status").select(*PLACE, "outcome")


@query("compare_outcomes", WORLDS + "SELECT outcome, count(*) AS n FROM classified GROUP BY outcome")
def _(spark, sf):
    live, restored = worlds(spark, sf)
    return inspect.outcome_counts(compare.classify(live, restored, PLACE, status="status"), "outcome")


@query("misplaced_content", WORLDS + "SELECT * FROM placed")
def _(spark, sf):
    live, restored = worlds(spark, sf)
    return compare.misplaced(compare.classify(live, restored, PLACE, status="status"), live, PLACE)


@query("offset_histogram", WORLDS + "SELECT cx - at_cx AS dx, cz - at_cz AS dz, count(*) AS n FROM placed GROUP BY ALL ORDER BY n DESC, dx, dz LIMIT 15")
def _(spark, sf):
    live, restored = worlds(spark, sf)
    return compare.offset_histogram(compare.misplaced(compare.classify(live, restored, PLACE, status="status"), live, PLACE))


@query("missing_regions", WORLDS + """
SELECT cz, bool_or(status = 'minecraft:full') AS counts FROM live WHERE cz NOT IN (SELECT cz FROM restored WHERE cz % 3 <> 0) GROUP BY cz""")
def _(spark, sf):
    live, restored = worlds(spark, sf)
    return compare.missing_regions(live, restored.filter("cz % 3 != 0"), ["cz"])


@query("misplaced_headers", WORLDS + "SELECT cx, cz, k % 40 AS x_pos, k // 40 AS z_pos FROM restored WHERE cx <> k % 40 OR cz <> k // 40")
def _(spark, sf):
    restored = worlds(spark, sf)[1]
    return compare.misplaced_headers(restored.select(*PLACE, (F.col("k") % 40).alias("x_pos"), F.floor(F.col("k") / 40).cast("long").alias("z_pos")))


@query("verdict", WORLDS + """
SELECT count(*) FILTER (WHERE outcome IN ('missing', 'extra', 'mismatched')) > 0 AS chunk_problems, FALSE AS aux_problems, count(*) FILTER (WHERE outcome IN ('missing', 'extra', 'mismatched')) = 0 AS passed FROM classified""")
def _(spark, sf):
    live, restored = worlds(spark, sf)
    return compare.verdict(compare.classify(live, restored, PLACE, status="status"))


ARRAYS_CHANGED = "(SELECT vec_id, list_transform(atoms, lambda x, i: CASE WHEN (vec_id + i - 1) % 9 = 0 THEN x + 1 ELSE x END) AS atoms FROM " + QUANTISED + ")"


@query("position_differences", f"""
WITH d AS (SELECT l.vec_id, list_filter(range(0, 64), lambda i: l.atoms[i + 1] <> r.atoms[i + 1]) AS p, l.atoms AS a, r.atoms AS b FROM {QUANTISED} l JOIN {ARRAYS_CHANGED} r USING (vec_id))
SELECT vec_id, len(p)::INT AS differing, q::INT AS position, a[q + 1] AS live, b[q + 1] AS restored FROM (SELECT *, unnest(p[1:8]) AS q FROM d)""")
def _(spark, sf):
    live = quantised(spark, sf).select("vec_id", "atoms")
    restored = live.select("vec_id", F.transform("atoms", lambda x, i: F.when((F.col("vec_id") + i) % 9 == 0, x + 1).otherwise(x)).alias("atoms"))
    return compare.position_differences(live, restored, ["vec_id"])


@query("section_differences", f"""
WITH l AS (SELECT vec_id, list_sort(list_distinct(atoms)) AS n, md5(array_to_string(atoms, ',')) AS d FROM {QUANTISED}),
r AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_sort(list_distinct(atoms[1:3])) ELSE list_sort(list_distinct(atoms)) END AS n, md5(CASE WHEN vec_id % 2 = 0 THEN array_to_string(list_reverse(atoms), ',') ELSE array_to_string(atoms, ',') END) AS d FROM {QUANTISED} WHERE vec_id % 10 <> 3)
SELECT vec_id, CASE WHEN r.n IS NULL THEN 'only_live' WHEN len(l.n) = 1 OR len(r.n) = 1 THEN 'uniform_differs' WHEN l.n = r.n THEN 'positions_differ' ELSE 'names_differ' END AS difference
FROM l LEFT JOIN r USING (vec_id) WHERE r.n IS NULL OR l.n <> r.n OR l.d <> r.d""")
def _(spark, sf):
    q = quantised(spark, sf)
    live = q.select("vec_id", palette.palette("atoms").alias("names"), F.md5(joined("atoms")).alias("digest"))
    some = F.when(F.col("vec_id") % 4 == 0, palette.palette(F.slice("atoms", 1, 3))).otherwise(palette.palette("atoms"))
    turned = F.when(F.col("vec_id") % 2 == 0, F.reverse("atoms")).otherwise(F.col("atoms"))
    restored = q.withColumn("turned", turned).filter("vec_id % 10 != 3").select("vec_id", some.alias("names"), F.md5(joined("turned")).alias("digest"))
    return compare.section_differences(live, restored, ["vec_id"])


@query("aux_differences", f"""
WITH a AS (SELECT path, arg_max(hash, ts) AS hash FROM {HISTORY} WHERE ts <= {MID} GROUP BY path), b AS (SELECT path, arg_max(hash, ts) AS hash FROM {HISTORY} WHERE ts BETWEEN 50 AND {CUT} GROUP BY path)
SELECT path, CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' ELSE 'changed' END AS outcome FROM a FULL JOIN b USING (path) WHERE a.hash IS DISTINCT FROM b.hash""")
def _(spark, sf):
    h = blobs.history(files(spark, sf))
    return compare.aux_differences(blobs.files_as_of(h, MID), blobs.files_as_of(h.filter("ts >= 50"), CUT))


@query("chunk_fingerprint", """
SELECT l_orderkey AS k, sha1('[' || string_agg('{"y":' || l_linenumber || ',"block":"' || l_returnflag || '","biome":"' || l_linestatus || '"}', ',' ORDER BY l_linenumber, l_returnflag, l_linestatus) || ']') AS fingerprint
FROM lineitem GROUP BY l_orderkey""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    sections = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("y"), F.col("l_returnflag").alias("block"), F.col("l_linestatus").alias("biome"))
    return compare.chunk_fingerprint(sections, None, ["k"])


@query("run_batches", """
WITH RECURSIVE c AS (SELECT DISTINCT o_orderkey // 1024 AS region, (o_orderkey % 1024 // 32)::INT AS z, (o_orderkey % 32)::INT AS x FROM orders WHERE o_orderkey % 32 % 7 <> 3),
runs AS (SELECT region, z, min(x) AS x0, max(x) AS x1, max(x) - min(x) + 1 AS size, row_number() OVER (PARTITION BY region ORDER BY z, min(x)) AS n
  FROM (SELECT *, x - row_number() OVER (PARTITION BY region, z ORDER BY x) AS island FROM c) GROUP BY region, z, island),
packed AS (SELECT *, size AS filled, 0 AS batch FROM runs WHERE n = 1 UNION ALL
  SELECT r.*, CASE WHEN filled + r.size > 256 THEN r.size ELSE filled + r.size END, batch + (filled + r.size > 256)::INT FROM packed p JOIN runs r ON r.region = p.region AND r.n = p.n + 1)
SELECT region, z, x0, x1, batch FROM packed""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 1024).cast("long").alias("region"), F.floor(F.col("o_orderkey") % 1024 / 32).cast("int").alias("z"), (F.col("o_orderkey") % 32).cast("int").alias("x"))
    return compare.run_batches(o.filter("x % 7 != 3"), ["region"], 256)


# --- scalars ------------------------------------------------------------------------------------------------------


@query("coordinates", """
WITH c AS (SELECT o_orderkey, (o_orderkey % 20011 - 9000)::INT AS rx, (o_custkey * 7 % 9973 - 5000)::INT AS rz, (o_orderkey % 3)::INT AS dim, (o_orderkey % 32)::INT AS x, (o_custkey % 32)::INT AS z FROM orders),
i AS (SELECT *, (dim::BIGINT << 42) | ((rx::BIGINT & 2097151) << 21) | (rz::BIGINT & 2097151) AS id FROM c)
SELECT o_orderkey, floor(rx / 32.0)::INT AS sector_x, floor(rz / 32.0)::INT AS sector_z, id, rx AS back_x, rz AS back_z, dim AS back_dim, (x * 32 + z)::INT AS segment, (x + z * 32)::INT AS header,
       (x::BIGINT * 4294967296) | z AS chunk, ((300 << 16) | (z << 8) | x)::INT AS tile, x AS tile_x, z AS tile_z, 300 AS tile_y FROM i""")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = table(spark, sf, "orders").select("o_orderkey", (k % 20011 - 9000).cast("int").alias("rx"), (c * 7 % 9973 - 5000).cast("int").alias("rz"), (k % 3).cast("int").alias("dim"), (k % 32).cast("int").alias("x"), (c % 32).cast("int").alias("z"))
    coded = base.withColumn("id", coords.region_id("rx", "rz", "dim")).withColumn("r", coords.region_of_id("id")).withColumn("p", coords.tile_position("x", "z", F.lit(300))).withColumn("q", coords.tile_of_position("p"))
    return coded.select(
        "o_orderkey", coords.floor_div32("rx").alias("sector_x"), coords.floor_div32("rz").alias("sector_z"), "id", F.col("r.rx").alias("back_x"), F.col("r.rz").alias("back_z"), F.col("r.dim").alias("back_dim"),
        coords.segment_index("x", "z").alias("segment"), coords.header_index("x", "z").alias("header"), coords.chunk_key("x", "z").alias("chunk"), F.col("p").alias("tile"), F.col("q.x").alias("tile_x"), F.col("q.z").alias("tile_z"), F.col("q.y").alias("tile_y"),
    )


@query("atom_places", f"""
WITH a AS (SELECT vec_id, unnest(range(0, 64))::INT AS i, unnest(atoms) AS atom FROM {QUANTISED})
SELECT vec_id, i, atom, i & 15 AS bx, (i >> 8) & 15 AS by, (i >> 4) & 15 AS bz, i & 3 AS mx, (i >> 4) & 3 AS my, (i >> 2) & 3 AS mz FROM a""")
def _(spark, sf):
    a = quantised(spark, sf).select("vec_id", F.posexplode("atoms").alias("i", "atom"))
    b, m = coords.block_place("i"), coords.biome_place("i")
    return a.select("vec_id", "i", "atom", b["x"].alias("bx"), b["y"].alias("by"), b["z"].alias("bz"), m["x"].alias("mx"), m["y"].alias("my"), m["z"].alias("mz"))


@query("local_tiles", """
WITH t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 300)::INT - 16 AS x, (l_suppkey % 40)::INT - 20 AS z, (l_quantity * 8)::INT - 80 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, x + 32 AS lx, z + 16 AS lz, y + 64 AS ly FROM t WHERE x + 32 BETWEEN 0 AND 255 AND z + 16 BETWEEN 0 AND 255 AND y + 64 BETWEEN 0 AND 65535""")
def _(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") % 300).cast("int") - 16).alias("x"), ((F.col("l_suppkey") % 40).cast("int") - 20).alias("z"), ((F.col("l_quantity") * 8).cast("int") - 80).alias("y"))
    placed = t.withColumn("p", coords.local_tile("x", "y", "z", F.lit(-2), F.lit(-1), F.lit(-64))).filter("p is not null")
    return placed.select("l_orderkey", "l_linenumber", F.col("p.x").alias("lx"), F.col("p.z").alias("lz"), F.col("p.y").alias("ly"))


@query("human_ages", f"""
WITH a AS (SELECT o_orderkey, {ORDERS_NOW} - (epoch_us(o_orderdate) // 1000000 - o_custkey * 37 % 100000) - CASE WHEN o_orderkey % 97 = 0 THEN 1000000000 ELSE 0 END AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 0 THEN 'in the future' WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h ago' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ago'
       WHEN s >= 60 THEN (s // 60) || 'm ago' ELSE s || 's ago' END AS age FROM a""")
def _(spark, sf):
    from loamstone.plans.tables import micros

    ts = F.floor(micros("o_orderdate") / 1_000_000).cast("long") - F.col("o_custkey") * 37 % 100_000
    s = F.lit(ORDERS_NOW) - ts - F.when(F.col("o_orderkey") % 97 == 0, 1_000_000_000).otherwise(0)
    return table(spark, sf, "orders").select("o_orderkey", names.human_age(s).alias("age"))


@query("canonical_states", """
SELECT p_partkey, 'minecraft:' || lower(p_brand) || '[brand=' || p_brand || ',size=' || p_size || ',type=' || p_type || ']' AS state, lower(p_brand) AS bare, contains(lower(p_type), 'a') AS has_a, sha256(p_name) AS hash FROM part""")
def _(spark, sf):
    full = F.concat(F.lit("minecraft:"), F.lower("p_brand"))
    properties = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", names.canonical_state(full, properties).alias("state"), names.strip_namespace(full).alias("bare"), names.contains_ignoring_case("p_type", F.lit("A")).alias("has_a"), names.sha256_hex("p_name").alias("hash"))


@query("region_files", """
WITH f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'r.' || s_suppkey || '.x.zvcr3d' ELSE 'overworld/' || floor((s_suppkey - 40) / 32.0)::INT || '/0/r.' || (s_suppkey - 40) || '.' || s_nationkey || '.zvcr3d' END AS path FROM supplier)
SELECT s_suppkey, path, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey - 40)::INT END AS rx, CASE WHEN s_suppkey % 4 <> 0 THEN split_part(path, '.', 3)::INT END AS rz FROM f""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") - 40).cast("int").alias("x"), "s_nationkey")
    path = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("r."), F.col("s_suppkey").cast("string"), F.lit(".x.zvcr3d"))).otherwise(coords.region_path(F.lit("overworld"), "x", "s_nationkey", "zvcr3d"))
    named = s.withColumn("path", path).withColumn("r", coords.region_of_file("path", "zvcr3d"))
    return named.select("s_suppkey", "path", F.col("r.rx").alias("rx"), F.col("r.rz").alias("rz"))
