"""Host-level quality rules, in DataFrame functions only.

Every document gets the base rules (word and symbol counts, repeated lines, repeated 5-word windows). Failures
are summed per host, each host's failure rate is shrunk towards the rate of all hosts with a beta prior whose
strength is estimated from the hosts themselves (moments, weighted by documents), and the verdict of a host is
joined back to its documents: a document is kept if it passes the base rules and its host is not rejected.

Null text has no words and fails `n_words < min_words`. A null host is a host of its own. Empty tables give
empty results. Very long texts are worked on whole, as one value of one row. Repeated rows count as documents of their own. The join's small side is broadcast only after it
has been counted; with more hosts Spark shuffles it and splits a host with many documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import SPACE, Scratch, exploding_columns, join_bounded

QUERY = "op8_host_rules"

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5
ADDED = ["rules", "host_docs", "host_rate", "host_rejected", "kept", "host_key"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column, width: int) -> Column:
    """Words in windows of `width` words that are found twice or more."""

    def windows(w):
        starts = F.sequence(F.lit(0), F.size(w) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def covered(pairs):  # sorted (hash, start)
        def twin(x, j):
            return (F.get(pairs, j - 1)["h"] == x["h"]) | (F.get(pairs, j + 1)["h"] == x["h"])

        starts = F.sort_array(F.transform(F.filter(pairs, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"]))
        total = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + width - F.greatest(acc["end"], i)).alias("n"), (i + width).alias("end")),
        )
        return total["n"]

    def count(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(pairs, covered))

    return F.when(F.size(words) < width, 0).otherwise(_let(windows(words), count))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `rules`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def per_text(t):
        words = F.filter(F.split(t, SPACE), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
        return F.struct(words.alias("words"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    def counts(x):
        n = F.size(x["words"])
        return F.struct(
            n.cast("long").alias("n_words"),
            x["dup"].cast("long").alias("n_dup_lines"),
            _repeated_words(x["words"], 5).cast("long").alias("n_repeat_words"),
        )

    def rules(c):
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        return F.struct(
            c["n_words"].alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            c["n_dup_lines"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
        )

    return docs.withColumn("rules", _let(_let(per_text(t), counts), rules))


def host_verdicts(ruled: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host_key, host_docs, host_rate (shrunk), host_rejected for each host."""
    hosts = ruled.groupBy(F.coalesce(F.concat(F.lit("h:"), F.col(host).cast("string")), F.lit("null")).alias("host_key")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("rules.base_failed").cast("long")).alias("failures")
    )
    n, k = F.col("host_docs").cast("double"), F.col("failures").cast("double")
    moments = hosts.agg(
        F.count(F.lit(1)).cast("double").alias("m"), F.sum(n).alias("n1"), F.sum(n * n).alias("n2"), F.sum(k).alias("k1"), F.sum(k * k / n).alias("kk")
    )
    p = F.col("k1") / F.col("n1")
    within = p * (1 - p)
    # weighted between-host sum of squares, and the part of it that binomial noise explains
    between = (F.col("kk") - F.col("n1") * p * p - (F.col("m") - 1) * within) / F.greatest(F.col("n1") - F.col("n2") / F.col("n1"), F.lit(1e-9))
    # strength = p(1-p)/variance - 1, held to 1 .. 10000 documents
    strength = F.when(between > within / 10001, F.greatest(F.lit(1.0), within / between - 1)).otherwise(F.lit(10000.0))
    prior = moments.select(p.alias("p"), strength.alias("s"))
    rate = (F.col("failures") + F.col("p") * F.col("s")) / (F.col("host_docs") + F.col("s"))
    # one row of moments, so this is no cross product
    return hosts.join(F.broadcast(prior)).select("host_key", "host_docs", rate.alias("host_rate"), (rate > max_rate).alias("host_rejected"))


def apply_rules(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs with `rules`, `host_docs`, `host_rate`, `host_rejected` and `kept`. Texts are not shuffled.

    Columns of docs that bear one of these names, in any case, are left out.
    """
    ruled = base_rules(docs.select(*exploding_columns(docs, ADDED)), text)
    verdicts = host_verdicts(ruled, host, max_rate)
    keyed = ruled.withColumn("host_key", F.coalesce(F.concat(F.lit("h:"), F.col(host).cast("string")), F.lit("null")))
    joined = join_bounded(keyed, verdicts, ["host_key"], "left").drop("host_key")
    return joined.withColumn("kept", ~F.col("rules.base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    # the rules of a document are computed once and kept; only their few numbers are read again
    ruled = Scratch(spark, "hosts").keep(base_rules(docs).drop("text"), "rules")
    verdicts = host_verdicts(ruled, "source")
    keyed = ruled.withColumn("host_key", F.coalesce(F.concat(F.lit("h:"), F.col("source").cast("string")), F.lit("null")))
    out = join_bounded(keyed, verdicts, ["host_key"], "left")
    kept = ~F.col("rules.base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines", "rules.n_repeat_words", "rules.base_failed", kept.alias("kept"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
base AS (
  SELECT doc_id, source, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM words),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
ruled AS (
  SELECT b.*, coalesce(r.n, 0) AS n_repeat_words,
         (n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words) AS base_failed
  FROM base b LEFT JOIN repeated r USING (doc_id)),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS k FROM ruled GROUP BY source),
moments AS (SELECT count(*)::DOUBLE AS m, sum(n) AS n1, sum(n * n) AS n2, sum(k) AS k1, sum(k * k / n) AS kk FROM hosts),
shape AS (
  SELECT k1 / n1 AS p, (kk - n1 * (k1 / n1) * (k1 / n1) - (m - 1) * (k1 / n1) * (1 - k1 / n1)) / greatest(n1 - n2 / n1, 1e-9) AS b FROM moments),
prior AS (
  SELECT p, CASE WHEN b > p * (1 - p) / 10001 THEN greatest(1.0, p * (1 - p) / b - 1) ELSE 10000.0 END AS s FROM shape),
verdicts AS (SELECT source, (k + p * s) / (n + s) > 0.5 AS rejected FROM hosts, prior)
SELECT r.doc_id, r.n_words::BIGINT AS n_words, r.word_chars::BIGINT AS word_chars, r.n_symbols::BIGINT AS n_symbols,
       r.n_dup_lines::BIGINT AS n_dup_lines, r.n_repeat_words::BIGINT AS n_repeat_words, r.base_failed,
       (NOT r.base_failed AND NOT v.rejected) AS kept
FROM ruled r JOIN verdicts v ON r.source IS NOT DISTINCT FROM v.source
"""
