"""Substring deduplication by level-wise doubling.

To find the windows of `width` words that occur twice, shorter windows are looked at first: a long window can only
repeat if the short ones inside it do. Level by level the length doubles (9, 18, 35 for 35), and only the stretches of
text whose windows were found twice at one length go on to the next, until no stretch survives or the full length is
reached. At the shorter lengths one window in a long window is enough, the one with the smallest hash (it depends on
the long window's content only), so equal long windows look at equal short ones, and nothing is lost. At the full
length every surviving window is looked at.

Removed is each word that a repeated window covers, at every place where it occurs. Windows of the full length are told
apart by 128 bits, two independent hashes of their words; the shorter ones, which only choose what is looked at, by 64. Null text has no words; texts shorter than `width` lose nothing. Rows with equal id and text are
documents of their own and repeat each other. Empty tables give no rows. Very long texts are handled in pieces of memory
proportional to the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import Scratch, rows
from loamstone.llm.repeats import anchors, doubled, repeated, runs, string_hashes

QUERY = "op4_window_doubling"
ORACLE = None  # DuckDB takes minutes for the windows of whole tables; tests compare with brute force

WIDTH = 35
NO_ID = -(1 << 63)


def word_hashes(texts, function: int = 0) -> list[np.ndarray]:
    """One array of 64-bit word hashes per text of a pyarrow string array; two functions are independent."""
    import pyarrow.compute as pc

    words = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(words.offsets).astype(np.int64)
    flat = words.flatten()
    h = string_hashes(flat, function)
    real = np.asarray(pc.binary_length(flat)) > 0  # outer white space leaves empty words
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    h = h[real]
    return [h[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]


def levels(width: int, least: int = 8) -> list[int]:
    """Lengths from a short one up to width, each at most twice the one before."""
    out = [width]
    while out[0] > 2 * least:
        out.insert(0, -(-out[0] // 2))
    return out


def _repeated(stretches: DataFrame, ids: list[str], length: int, width: int, scratch: Scratch) -> DataFrame:
    """ids, hits: the repeated ones of the anchors of each stretch; at the full length of all windows, told apart by two hashes."""
    whole = length == width

    def run(**columns):
        out = [[] for _ in range(1 + whole)]
        text = columns.pop("text")
        for i in range(0, len(text), 256):
            for function, keys in enumerate(out):
                for h in word_hashes(text[i : i + 256], function):
                    g = doubled(h, length) if len(h) >= width else h[:0]
                    keys.append((g if whole else g[anchors(g, width - length + 1)[0]]).tobytes())
        return *columns.values(), *out

    schema = ", ".join(f"{c} long" for c in ids) + ", keys binary" + ", checks binary" * whole
    return repeated(stretches.select(*ids, "text"), ids, scratch, rows(run, schema), whole)


def _survivors(joined: DataFrame, length: int, width: int) -> DataFrame:
    """The stretches whose windows' anchors were hit: doc, tag, start (in words of the document), text."""

    def run(doc, tag, start, text, hits):
        out = [[], [], [], []]
        owner = list(zip(doc.to_pylist(), tag.to_pylist(), start.to_pylist(), strict=True))
        for i in range(0, len(text), 256):
            part = text[i : i + 256]
            for j, (h, t) in enumerate(zip(word_hashes(part), part.to_pylist(), strict=True), i):
                _, of_window = anchors(doubled(h, length), width - length + 1)
                hit = np.zeros(of_window[-1] + 1, bool)
                hit[np.frombuffer(hits[j].as_buffer(), np.uint32)] = True
                words = t.encode("utf-8", "surrogatepass").split()
                for s, e in zip(*runs(hit[of_window]), strict=True):
                    for column, value in zip(out, (*owner[j][:2], owner[j][2] + int(s), b" ".join(words[s : e + width - 1]).decode("utf-8", "surrogatepass")), strict=True):
                        column.append(value)
        return out

    schema = "doc long, tag long, start long, text string"
    return joined.mapInArrow(rows(run, schema), schema)


def repeated_windows(docs: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """doc, tag, starts, ends: the stretches of words that repeated windows cover, per distinct (doc, tag).

    docs: doc and tag (longs, not null) and text (not null); rows with equal doc and tag hold equal texts.
    """
    ids = ["doc", "tag", "start"]
    stretches = docs.withColumn("start", F.lit(0).cast("long"))
    steps = levels(width)
    before = None
    for length in steps[:-1]:
        hits = _repeated(stretches, ids, length, width, scratch)
        after = scratch.keep(_survivors(stretches.join(hits.hint("shuffle_hash"), ids).select(*ids, "text", "hits"), length, width), f"level-{length}")
        if before is not None:
            scratch.drop(before)
        scratch.drop(hits)
        stretches = before = after
    hits = _repeated(stretches, ids, width, width, scratch)
    if before is not None:
        scratch.drop(before)

    def run(doc, tag, start, hits):
        starts, ends = [], []
        for s, h in zip(start.to_pylist(), hits, strict=True):
            at = np.frombuffer(h.as_buffer(), np.uint32).astype(np.int64)
            new = np.concatenate([[True], np.diff(at) > width])
            starts.append((at[new] + s).tolist())
            ends.append((at[np.append(new[1:], True)] + s + width).tolist())
        return doc, tag, starts, ends

    schema = "doc long, tag long, starts array<long>, ends array<long>"
    covers = hits.mapInArrow(rows(run, schema), schema)
    return covers.groupBy("doc", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def keyed_documents(docs: DataFrame) -> DataFrame:
    """doc, tag, text without nulls; equal doc and tag mean equal text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def mask_of(n: int, starts, ends) -> np.ndarray:
    """True where one of the stretches covers."""
    edge = np.zeros(n + 1, np.int64)
    if starts is not None:
        np.add.at(edge, np.asarray(starts, np.int64), 1)
        np.add.at(edge, np.asarray(ends, np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and text: the kept words) for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "windows")
    keyed = keyed_documents(docs)
    covers = scratch.keep(repeated_windows(keyed, scratch, width), "covers")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text

    def run(doc, text, starts, ends):
        out = [[], [], [], []] + [[]] * keep_text
        for d, t, s, e in zip(doc.to_pylist(), text.to_pylist(), starts, ends, strict=True):
            words = t.encode("utf-8", "surrogatepass").split()
            kept = words
            if s.is_valid:
                kept = [w for w, gone in zip(words, mask_of(len(words), s.values, e.values).tolist(), strict=True) if not gone]
            joined = b" ".join(kept)
            row = (None if d == NO_ID else d, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass"))
            for column, value in zip(out, row, strict=False):
                column.append(value)
        return out

    return keyed.join(covers.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "text", "starts", "ends").mapInArrow(rows(run, schema), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
