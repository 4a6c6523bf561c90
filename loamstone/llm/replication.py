"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean repetition rate: the share that the target weights give it, over the share that it has.
A document's copy count is a Poisson variable of that mean, found by inverting the distribution function at
uniforms hashed from (seed, doc_id, draw), so it depends on nothing but the row and can be recomputed anywhere.
The document is exploded by its count and all copies are dealt out by a hash of (seed, doc_id, copy), and sorted
by it inside each partition: a global shuffle that needs no sampling pass and has no hot key.

Rates above `STEP` are drawn as a sum of several Poisson variables, so the inversion's table stays short and
exact. Rows with the same doc_id and source get the same count. Null sources are a source of their own and null
texts have size 0. A source without size has rate 1. Weights default to the square root of a source's size. Very
long texts are rows like any other, moved once. Ties of the shuffle key are copies of rows with equal ids. Empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import exploding_columns, join_bounded

QUERY = "op7_poisson_mix"

STEP = 4.0
TERMS = 40  # the chance of more at a mean of 4 is below 1e-25
SEED = "17"


def _uniform(*parts: Column) -> Column:
    """Uniform over (0, 1) on a grid of 2^-52, from the md5 of the parts."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson(rate: Column, *key: Column) -> Column:
    """Smallest k with P(X <= k) >= u, summed over ceil(rate / STEP) draws of equal mean."""
    draws = F.greatest(F.lit(1), F.ceil(rate / STEP)).cast("int")

    def one(mean: Column, u: Column) -> Column:
        def step(acc, k):
            p = acc["p"] * mean / k
            more = acc["c"] < u
            return F.struct(F.when(more, p).otherwise(acc["p"]).alias("p"), F.when(more, acc["c"] + p).otherwise(acc["c"]).alias("c"), (acc["n"] + more.cast("int")).alias("n"))

        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["n"])

    # the mean of each draw and its uniform are bound once by the lambda's variable
    pairs = F.transform(F.sequence(F.lit(0), draws - 1), lambda i: F.struct((rate / draws).alias("m"), _uniform(*key, i.cast("string")).alias("u")))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + one(x["m"], x["u"]))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total_rate: float = 1.0) -> DataFrame:
    """source_key, rate. Sizes are characters; weights name sources (sources without a weight get 0)."""
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    sizes = docs.groupBy(_source_key().alias("source_key")).agg(F.sum(size).alias("size"))
    if weights is None:
        weight = F.sqrt(F.col("size").cast("double"))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source_key") == f"s:{name}", float(w)).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    totals = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.col("all_weight") * F.col("all_size") * total_rate
    rate = F.when((F.col("size") > 0) & (F.col("all_weight") > 0), share / F.col("size")).otherwise(1.0)
    return weighed.join(F.broadcast(totals)).select("source_key", rate.alias("rate"))  # totals: one row


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, total_rate: float = 1.0, seed: str = SEED) -> DataFrame:
    """Columns of docs, and copy_index (from 0), n_copies, shuffle_key, in globally shuffled order.

    Columns of docs that bear one of these names, or `source_key` or `rate`, in any case, are left out.
    """
    own = ["copy_index", "n_copies", "shuffle_key", "source_key", "rate"]
    columns = exploding_columns(docs, own)
    rated = join_bounded(docs.select(*columns, _source_key().alias("source_key")), source_rates(docs, weights, total_rate), ["source_key"], "left")
    n = poisson(F.coalesce("rate", F.lit(1.0)), F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    copies = rated.withColumn("n_copies", n).filter("n_copies > 0").select(*columns, "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy_index"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy_index").cast("string")))
    keyed = copies.withColumn("shuffle_key", key)
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replicate(docs).select("doc_id", "text", "lang", "source", "n_chars", "copy_index", "n_copies", "shuffle_key")


ORACLE = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 AND sum(sqrt(size)) OVER () > 0
         THEN sqrt(size) / (sum(sqrt(size)) OVER ()) * (sum(size) OVER ()) / size ELSE 1.0 END AS rate FROM sizes),
draws AS (
  SELECT source, rate, greatest(1, ceil(rate / 4.0))::INTEGER AS n FROM rates),
terms(source, k, p, c) AS (
  SELECT source, 0, exp(-rate / n), exp(-rate / n) FROM draws
  UNION ALL
  SELECT t.source, k + 1, p * (rate / n) / (k + 1), c + p * (rate / n) / (k + 1)
  FROM terms t JOIN draws d ON t.source IS NOT DISTINCT FROM d.source WHERE k < 40),
steps AS (SELECT source, list(c ORDER BY k) AS cs FROM terms GROUP BY source),
counted AS (
  SELECT d.*, list_sum(list_transform(range(s.n), lambda i: len(list_filter(t.cs[1:40],
         lambda c: c < (('0x' || substr(md5('17|' || d.doc_id || '|' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0))))::INTEGER AS n_copies
  FROM documents d JOIN draws s ON d.source IS NOT DISTINCT FROM s.source JOIN steps t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, text, lang, source, n_chars, copy_index, n_copies, md5('17|order|' || doc_id || '|' || copy_index) AS shuffle_key
FROM (SELECT *, unnest(range(n_copies))::INTEGER AS copy_index FROM counted WHERE n_copies > 0)
"""
