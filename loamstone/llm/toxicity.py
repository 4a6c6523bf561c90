"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased and stripped of outer punctuation. A text's features are the distinct hashes, cut to
2^BITS buckets, of its words, of neighbouring pairs, and of pairs with one word between. Training goes through
the rows once per epoch with per-coordinate learning rates; the L1 term keeps most weights at exactly 0, so what
is broadcast is a short list of buckets and weights (2^BITS entries at most, whatever the corpus).

Training uses `max_rows` labelled rows at most (those of smallest hashed id), and of these such with `MAX_GRAMS`
features at most, so that the one task that trains is of bounded size; null labels are left out. Whole texts are scored,
however long. Null or empty text has no features and gets the score of the bias. Without usable labels every score is
0.5. Equal texts have equal scores and repeated rows are scored each; a null doc_id is carried, is not held out and
trains nothing. Empty tables give no rows. Labels, language, source, id and any other columns are never features.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import mix, rows

QUERY = "op10_ftrl_toxicity"
ORACLE = None  # a trained model; tests measure held-out accuracy

BITS = 20
MAX_ROWS = 12_000
MAX_GRAMS = 1 << 16  # 256 KB a row
CUTOFF = 0.3
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_KNOWN: dict[str, int] = {}


def _word_hash(word: str) -> int:
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) > 500_000:
            _KNOWN.clear()
        bare = word.lower().strip(_OUTER)
        found = _KNOWN[word] = xxhash.xxh64_intdigest((bare or word).encode("utf-8", "surrogatepass"), 1)
    return found


def buckets(texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """For a pyarrow string array: the text and the bucket of every feature occurrence."""
    import pyarrow.compute as pc

    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    per_text = np.diff(np.asarray(words.offsets).astype(np.int64))
    flat = words.flatten()
    coded = pc.dictionary_encode(flat)
    hashes = np.array([_word_hash(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = hashes[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.uint64)
    real = np.asarray(pc.binary_length(flat)) > 0  # splitting leaves an empty word at outer white space
    text = np.repeat(np.arange(len(per_text)), per_text)[real]
    h = h[real]
    out_text, out = [text], [mix(h)]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = text[gap:] == text[:-gap]
        out_text.append(text[gap:][same])
        out.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
    return np.concatenate(out_text), (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(text: np.ndarray, bucket: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((text << bits) | bucket)
    return both >> bits, both & ((1 << bits) - 1)


def ftrl(docs: list[np.ndarray], y: np.ndarray, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias. The bias is a coordinate of its own without L1."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(docs)):
            k = docs[i]
            zk, nk = z[k], n[k]
            root = np.sqrt(nk)
            w = np.where(np.abs(zk) > l1, -(zk - np.sign(zk) * l1) / ((beta + root) / alpha + l2), 0.0)
            bias = -zb / ((beta + nb**0.5) / alpha + 0.01)
            g = 1 / (1 + np.exp(-min(30.0, max(-30.0, w.sum() + bias)))) - y[i]
            z[k] = zk + g - (np.sqrt(nk + g * g) - root) / alpha * w
            n[k] = nk + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int = MAX_ROWS, **parameters) -> dict[str, np.ndarray]:
    """bucket, weight (bucket -1: the bias); empty without labels of both kinds."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter(learn & F.col("y").isin(0.0, 1.0))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)

    def grams(doc_id, y, text):
        texts, found = distinct(*buckets(text))
        cuts = np.searchsorted(texts, np.arange(len(text) + 1))
        return doc_id, y, [found[s:e].astype("<u4").tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]

    schema = "doc_id long, y double, grams binary"
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")  # max_rows rows at most
    bags = labelled.mapInArrow(rows(grams, schema), schema).filter(F.octet_length("grams") <= 4 * MAX_GRAMS).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def fit(batches):
        import pyarrow as pa

        bags, y = [], []
        for b in batches:
            y += b["y"].to_pylist()
            bags += [np.frombuffer(x.as_py(), "<u4").astype(np.int32) for x in b["grams"]]
        if len(set(y)) == 2:
            w, bias = ftrl(bags, np.array(y), **parameters)
            k = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1).astype(np.int64)), pa.array(np.append(w[k], bias))], ["bucket", "weight"])

    table = bags.coalesce(1).mapInArrow(fit, "bucket long, weight double").toArrow()
    return {"bucket": np.asarray(table["bucket"]), "weight": np.asarray(table["weight"])}


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", max_rows: int = MAX_ROWS, **parameters) -> DataFrame:
    """doc_id, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, learn, max_rows, **parameters))

    def run(doc_id, text):
        model = shared.value
        if not len(model["bucket"]):
            return doc_id, np.full(len(text), 0.5)
        dense = np.zeros((1 << BITS) + 1)
        dense[model["bucket"]] = model["weight"]
        raw = np.full(len(text), dense[-1])
        for i in range(0, len(text), 512):
            texts, found = buckets(text[i : i + 512])
            heavy = dense[found] != 0
            texts, found = distinct(texts[heavy], found[heavy])
            part = raw[i : i + 512]
            part += np.bincount(texts, dense[found], len(part))
        return doc_id, 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    schema = "doc_id long, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows(run, schema), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.gam import fold

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold(folds=4) == 2
    out = classify(docs, labels, ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
