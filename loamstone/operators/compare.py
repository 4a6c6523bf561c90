"""Comparison of two datasets of keyed content: what is missing, extra, different or in the wrong place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Files that change while a world runs, and files that are no world data
VOLATILE = r"(^|/)level\.dat[^/]*$"
SKIPPED = r"(^|/)(session\.lock$|\.git/|\.fastback/)|^\.git(attributes|ignore)$"


def classify(live: DataFrame, restored: DataFrame, keys: list[str], content: str = "content", status: str | None = None) -> DataFrame:
    """keys, outcome, live and restored content: 'missing', 'missing_not_full', 'extra', 'mismatched' or 'equal'.

    With a status column a missing row only counts as 'missing' if it was fully generated (null: it was).
    """
    a = live.select(*keys, F.col(content).alias("live"), (F.col(status) if status else F.lit(None).cast("string")).alias("live_status"), F.lit(True).alias("_a"))
    b = restored.select(*keys, F.col(content).alias("restored"), F.lit(True).alias("_b"))
    full = F.col("live_status").isNull() | (F.regexp_replace("live_status", "^[^:]*:", "") == "full")
    outcome = (
        F.when(F.col("_b").isNull() & full, "missing")
        .when(F.col("_b").isNull(), "missing_not_full")
        .when(F.col("_a").isNull(), "extra")
        .when(F.col("live").eqNullSafe(F.col("restored")), "equal")
        .otherwise("mismatched")
    )
    return a.join(b, keys, "full").select(*keys, outcome.alias("outcome"), "live", "restored", "live_status")


def misplaced(classified: DataFrame, live: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Mismatched keys whose restored content is that of another live key (the first of them), as at_<key>."""
    place = F.struct(*keys)
    wanted = classified.filter("outcome = 'mismatched'").select(*keys, F.col("restored").alias(content))
    # two smallest places per content suffice, as one of them is another key: no pair of equal contents is listed
    order = W.partitionBy(content).orderBy(*keys)
    first = live.select(content, place.alias("_at"), F.row_number().over(order).alias("_n")).filter("_n <= 2").groupBy(content).agg(F.array_sort(F.collect_list("_at")).alias("_ats"))
    found = wanted.join(first, content).withColumn("_at", F.get(F.filter("_ats", lambda p: p != place), F.lit(0))).filter("_at is not null")
    return found.select(*keys, *[F.col(f"_at.{k}").alias(f"at_{k}") for k in keys])


def offset_histogram(placed: DataFrame, x: str = "cx", z: str = "cz", top: int = 15) -> DataFrame:
    """dx, dz, n: the most frequent offsets between where content is and where it should be."""
    dx, dz = F.col(x) - F.col(f"at_{x}"), F.col(z) - F.col(f"at_{z}")
    return placed.groupBy(dx.alias("dx"), dz.alias("dz")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dx", "dz").limit(top)


def misplaced_headers(chunks: DataFrame) -> DataFrame:
    """Chunks that name another place than the one they are at (cx, cz against x_pos, z_pos)."""
    return chunks.filter((F.col("cx") != F.col("x_pos")) | (F.col("cz") != F.col("z_pos")))


def missing_regions(live: DataFrame, restored: DataFrame, region: list[str], status: str = "status") -> DataFrame:
    """Live regions without any restored chunk, and whether one of their chunks was fully generated."""
    full = F.max((F.col(status).isNull() | (F.regexp_replace(status, "^[^:]*:", "") == "full")).cast("int")) == 1
    return live.groupBy(*region).agg(full.alias("counts")).join(restored.select(*region).distinct(), region, "left_anti")


def section_differences(live: DataFrame, restored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind of difference per section: rows are keys, names (sorted array), digest."""
    a = live.select(*keys, F.struct("names", "digest").alias("a"))
    b = restored.select(*keys, F.struct("names", "digest").alias("b"))
    uniform = (F.size("a.names") == 1) | (F.size("b.names") == 1)
    kind = (
        F.when(F.col("a").isNull(), "only_restored")
        .when(F.col("b").isNull(), "only_live")
        .when(F.col("a").eqNullSafe(F.col("b")), None)
        .when(uniform, "uniform_differs")
        .when(F.col("a.names") == F.col("b.names"), "positions_differ")
        .otherwise("names_differ")
    )
    return a.join(b, keys, "full").select(*keys, kind.alias("difference")).filter("difference is not null")


def position_differences(live: DataFrame, restored: DataFrame, keys: list[str], atoms: str = "atoms", limit: int = 8) -> DataFrame:
    """keys, differing (how many positions), and the first `limit` positions with both values."""
    b = restored.select(*keys, F.col(atoms).alias("_b"))
    pairs = F.zip_with(F.col(atoms), F.col("_b"), lambda x, y: F.struct(x.alias("live"), y.alias("restored")))
    placed = F.transform(pairs, lambda p, i: F.struct(i.alias("position"), p["live"].alias("live"), p["restored"].alias("restored")))
    differing = F.filter(placed, lambda p: ~p["live"].eqNullSafe(p["restored"]))
    out = live.join(b, keys).select(*keys, differing.alias("_d")).filter(F.size("_d") > 0)
    return out.select(*keys, F.size("_d").alias("differing"), F.explode(F.slice("_d", 1, limit)).alias("_p")).select(*keys, "differing", "_p.position", "_p.live", "_p.restored")


def aux_differences(live: DataFrame, restored: DataFrame) -> DataFrame:
    """path, outcome of auxiliary files (path, hash): 'missing', 'extra', 'changed' or 'volatile'; tool state is skipped."""
    kept = ~F.col("path").rlike(SKIPPED) & ~F.concat(F.lit("/"), F.col("path")).contains("/region/")
    found = classify(live.filter(kept), restored.filter(kept), ["path"], "hash")
    outcome = F.when(F.col("outcome") != "mismatched", F.col("outcome")).when(F.col("path").rlike(VOLATILE), "volatile").otherwise("changed")
    return found.select("path", outcome.alias("outcome")).filter("outcome != 'equal'")


def verdict(chunks: DataFrame, headers: DataFrame | None = None, aux: DataFrame | None = None) -> DataFrame:
    """One row: chunk_problems, aux_problems, passed. Changed auxiliary content is reported, but no failure."""
    def any_of(df: DataFrame | None, bad: Column) -> DataFrame:
        return df.agg(F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("n")) if df is not None else chunks.sparkSession.range(1).select(F.lit(0).alias("n"))

    c = any_of(chunks, F.col("outcome").isin("missing", "extra", "mismatched"))
    h = any_of(headers, F.lit(True))
    a = any_of(aux, F.col("outcome").isin("missing", "extra"))
    parts = c.select(F.col("n").alias("c")).crossJoin(h.select(F.col("n").alias("h"))).crossJoin(a.select(F.col("n").alias("a")))  # one row each
    return parts.select((F.col("c") + F.col("h") > 0).alias("chunk_problems"), (F.col("a") > 0).alias("aux_problems"), (F.col("c") + F.col("h") + F.col("a") == 0).alias("passed"))


def canonical_entry(name: Column, properties: Column, defaults: Column) -> Column:
    """name[k=v,...]; an entry without properties of its own takes the block's defaults (a map, null if it has none)."""
    from loamstone.functions.names import canonical_state

    return F.when(properties.isNull() & defaults.isNotNull(), F.concat(canonical_state(name, defaults), F.when(F.size(defaults) == 0, "[]").otherwise(""))).when(properties.isNull(), name).otherwise(
        F.concat(canonical_state(name, properties), F.when(F.size(properties) == 0, "[]").otherwise(""))
    )


def chunk_fingerprint(sections: DataFrame, tiles: DataFrame | None, keys: list[str]) -> DataFrame:
    """keys, fingerprint over the sections (y, block, biome; empty ones dropped) and the tiles (type, x, y, z) in order."""
    real = sections.filter(~((F.col("block") == "minecraft:air") & F.col("biome").isNull()))
    s = real.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("y", "block", "biome")))).alias("_s"))
    if tiles is None:
        return s.select(*keys, F.sha1("_s").alias("fingerprint"))
    t = tiles.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("type", "x", "y", "z")))).alias("_t"))
    return s.join(t, keys, "full").select(*keys, F.sha1(F.concat_ws("|", F.coalesce("_s", F.lit("[]")), F.coalesce("_t", F.lit("[]")))).alias("fingerprint"))


def run_batches(chunks: DataFrame, keys: list[str], limit: int = 256) -> DataFrame:
    """keys, z, x0, x1, batch: runs of neighbouring chunks (x, z) of a region, packed in order into batches of `limit` chunks.

    Runs are islands of consecutive x; batching is greedy and so sequential, per key: a region has 1,024 chunks at most.
    """
    import pandas as pd

    w = W.partitionBy(*keys, "z").orderBy("x")
    runs = chunks.select(*keys, "z", "x").distinct().withColumn("_g", F.col("x") - F.row_number().over(w)).groupBy(*keys, "z", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "x0"])
        batch, count, out = 0, 0, []
        for n in (pdf["x1"] - pdf["x0"] + 1).tolist():
            if count and count + n > limit:
                batch, count = batch + 1, 0
            count += n
            out.append(batch)
        return pdf.assign(batch=out)

    types = dict(chunks.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"z {types['z']}", f"x0 {types['x']}", f"x1 {types['x']}", "batch int"])
    return runs.groupBy(*keys).applyInPandas(pack, schema)
