"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few counts and shares (no labels, language, source or id among them), each binned at quantiles
of the training rows. Boosting goes round the features: every step fits a shallow tree to the current gradient of
one feature's bins and adds it, damped, to that feature's lookup table. The pairs whose joint tree explains most
of what is left then get two-dimensional tables in the same way. A score is a sum of table entries, looked up for
whole columns at once.

Texts are read once; their features are kept and serve both training and scoring. The model is fitted on the driver
on `max_rows` labelled rows at most (those of smallest hashed id), whatever the corpus; null labels are left out.
Null text counts as empty and is scored like any other; without usable labels every score is 0.5. A very long text is
read whole, in one row of a task. Equal texts have equal scores. Documents that repeat are scored each; a null doc_id is
carried, is not held out and trains nothing. Empty tables give no rows. Columns besides `doc_id` and `text` are not read
by `classify`, and carried by `keep_good` whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import Scratch, rows

QUERY = "op5_gam_quality"
ORACLE = None  # a trained model; tests measure held-out accuracy

MAX_ROWS = 30_000
CUTOFF = 0.3
NAMES = [
    "words", "word_length", "longest_word", "upper", "digits", "symbols", "bangs", "stops", "commas", "other_marks", "high_bytes", "lines", "line_length",
    "repeated_lines", "distinct_words", "top_word", "short_words", "long_words", "marked_words", "upper_words", "digit_words", "repeated_pairs", "brackets", "links",
]
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_ALNUM = bytes(range(97, 123)) + _UPPER + _DIGITS + bytes(range(128, 256))


def features(text: str | None) -> list[float]:
    """One row of NAMES; time and memory grow with the text's length only."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = len(b.translate(None, _SPACE))
    lines = [x for x in b.split(b"\n") if x.strip()]
    m = len(lines)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1

    def share(delete: bytes) -> float:
        return (len(b) - len(b.translate(None, delete))) / chars

    kinds = list(counts.items())
    marked = sum(c for w, c in kinds if w[-1:] in b"#*$%&|<>!?~^_=+@")
    upper = sum(c for w, c in kinds if len(w) > 1 and w.isupper())
    digit = sum(c for w, c in kinds if not w.isalpha() and w.translate(None, _DIGITS) != w)
    links = sum(c for w, c in kinds if b"http" in w or b"www." in w or b"@" in w)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), chars / n, float(np.log1p(lengths.max())), share(_UPPER), share(_DIGITS), share(b"#*$%&|<>"), share(b"!?"), share(b"."), share(b",;:"),
        1 - share(_ALNUM) - share(b"#*$%&|<>!?.,;:"), share(bytes(range(128, 256))), float(np.log1p(m)), float(np.log1p(chars / m)), 1 - len(set(lines)) / m,
        len(counts) / n, max(counts.values()) / n, float((lengths <= 2).mean()), float((lengths > 12).mean()), marked / n, upper / n, digit / n,
        1 - pairs / max(1, n - 1), share(b"()[]{}"), links / n,
    ]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, f array<float>."""
    import pyarrow as pa

    def run(doc_id, text):
        f = np.array([features(t.as_py()) for t in text], np.float32)
        offsets = np.arange(0, f.size + 1, len(NAMES), dtype=np.int32)
        return doc_id, pa.ListArray.from_arrays(pa.array(offsets), pa.array(f.ravel()), type=pa.list_(pa.field("element", pa.float32())))

    schema = "doc_id long, f array<float>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows(run, schema), schema)


def _split_1d(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """Leaf values per bin of a tree over one feature's bins, grown where the gain is largest."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]

    def best(s: int, e: int) -> tuple[float, int]:
        if e - s < 2:
            return 0.0, -1
        k = np.arange(s + 1, e)
        gl, hl = cg[k] - cg[s], ch[k] - ch[s]
        gr, hr = cg[e] - cg[k], ch[e] - ch[k]
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (cg[e] - cg[s]) ** 2 / (ch[e] - ch[s] + l2)
        gain[(hl < least) | (hr < least)] = 0
        i = int(np.argmax(gain))
        return float(gain[i]), int(k[i])

    while len(cuts) <= leaves:
        gain, at = max(best(s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True))
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        out[s:e] = -(cg[e] - cg[s]) / (ch[e] - ch[s] + l2)
    return out


def _split_2d(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, float]:
    """Best cut of one axis and, in each half, of the other: four leaves at most. Values and gain."""
    best = (0.0, np.zeros_like(g))
    whole = g.sum() ** 2 / (h.sum() + l2)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        values, score = None, 0.0
        first = _split_1d(a.sum(1), b.sum(1), 2, l2, least)
        change = np.flatnonzero(np.diff(first))
        cut = int(change[0]) + 1 if len(change) else len(a) // 2
        out = np.zeros_like(a)
        for part in (slice(0, cut), slice(cut, len(a))):
            ga, ha = a[part].sum(0), b[part].sum(0)
            values = _split_1d(ga, ha, 2, l2, least)
            out[part] = values
            score += float(-2 * (values * ga).sum() - ((ha + 0) * values**2).sum())
        if score - whole > best[0]:
            best = (score - whole, out if axis == 0 else out.T)
    return best[1], best[0]


class Model:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, leaves: int = 4, pairs: int = 8, l2: float = 2.0, least: float = 1.0):
        self.bias, self.edges, self.tables, self.pairs = 0.0, [], [], []
        self.fitted = len(y) > 0 and 0 < y.mean() < 1
        if not self.fitted:
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for c in x.T]
        at = self.binned(x)
        sizes = [len(e) + 1 for e in self.edges]
        self.tables = [np.zeros(k) for k in sizes]
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        raw = np.full(len(y), self.bias)
        for _ in range(rounds):
            for k, n in enumerate(sizes):
                p = 1 / (1 + np.exp(-raw))
                step = rate * _split_1d(np.bincount(at[k], p - y, n), np.bincount(at[k], p * (1 - p), n), leaves, l2, least)
                self.tables[k] += step
                raw += step[at[k]]
        p = 1 / (1 + np.exp(-raw))
        coarse = [np.minimum(a * 8 // n, 7) for a, n in zip(at, sizes, strict=True)]

        def grid(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            cell = coarse[i] * 8 + coarse[j]
            return cell, np.bincount(cell, p - y, 64).reshape(8, 8), np.bincount(cell, p * (1 - p), 64).reshape(8, 8)

        gains = sorted(((_split_2d(*grid(i, j, p)[1:], l2, least)[1], i, j) for i, j in combinations(range(len(sizes)), 2)), reverse=True)[:pairs]
        self.pairs = [(i, j, np.zeros((8, 8))) for gain, i, j in gains if gain > 0]
        for _ in range(rounds // 3):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-raw))
                cell, g, h = grid(i, j, p)
                step = rate * _split_2d(g, h, l2, least)[0]
                table += step
                raw += step.ravel()[cell]

    def binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T.astype(np.float32), strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        at = self.binned(x)
        raw = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            raw += table[at[k]]
        for i, j, table in self.pairs:
            a, b = (np.minimum(at[k] * 8 // (len(self.edges[k]) + 1), 7) for k in (i, j))
            raw += table[a, b]
        return 1 / (1 + np.exp(-raw))


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def train(features_table: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int = MAX_ROWS) -> Model:
    """Model of labels[label] on the rows for which `learn` (a condition on doc_id) holds."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter(learn & F.col("y").isin(0.0, 1.0))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    joined = features_table.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows on either side
    table = joined.select("f", "y").toArrow()
    y = np.asarray(table["y"])
    x = np.asarray(table["f"].combine_chunks().flatten() if len(y) else [], np.float32).reshape(len(y), len(NAMES))
    return Model(x, y)


def scored(features_table: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    shared = features_table.sparkSession.sparkContext.broadcast(model)

    def run(doc_id, f):
        return doc_id, shared.value.score(np.asarray(f.flatten()).reshape(len(f), len(NAMES)))

    schema = "doc_id long, score double"
    return features_table.mapInArrow(rows(run, schema), schema)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, score for every row of docs."""
    table = Scratch(docs.sparkSession, "gam").keep(featured(docs), "features")
    return scored(table, train(table, labels, label, learn, max_rows))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", cutoff: float = CUTOFF, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of docs with a score of `cutoff` or more. Only the training rows' features are kept; texts are not shuffled."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter(learn & F.col("y").isin(0.0, 1.0))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows).select("doc_id").distinct()
    table = Scratch(docs.sparkSession, "gam").keep(featured(docs.join(F.broadcast(chosen), "doc_id", "left_semi")), "training")  # max_rows ids at most
    shared = docs.sparkSession.sparkContext.broadcast(train(table, labels, label, learn, max_rows))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([features(t) for t in text], np.float32).reshape(len(text), len(NAMES))))

    return docs.filter(score(F.col("text").cast("string")) >= cutoff)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, labels, fold() != 0)
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
