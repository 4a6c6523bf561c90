"""Mixture-controlled packing of tokenised documents by deficit round robin over source queues.

Every source is a queue of tokens (its documents one after another). The output is one stream of windows of
`window_sequences * length` tokens. In each window every active source is served its quantum, its target share of
the window; the fraction of a token that it is owed is carried to the next window, across partitions too. A source
that runs dry leaves the round and the others share its part, so every token is packed and every window but the
last is full. The stream is cut into sequences of `length` tokens: only the last one can need padding.

The carried deficit has a closed form: with cumulative shares Q_1 <= Q_2 <= ... a source has been served
floor(w * Q_j / P) - floor(w * Q_(j-1) / P) tokens after w windows, which is within one token of its target at
every window. So a document's pieces follow from its place in its queue alone, and partitions need no talk.

The `MAX_QUEUES` - 1 sources of largest target have queues of their own. However many others there are, they stand
one after another in one shared queue that is owed the sum of their targets, so every document is packed and what the
driver plans and broadcasts is bounded (a source of less than a hundredth of a window would else be cut into crumbs).

Documents are tokenised once; ids are kept as 32-bit little-endian bytes. Null text is empty text and has only
the final id; a very long one is many pieces. A null source is a source of its own, null ids are carried. Repeated rows
are packed as often as they occur, ties in target go by name. An empty table packs to no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.llm.common import Scratch, join_bounded, rows

QUERY = "op6_mixture_packing"
ORACLE = None  # BPE ids are not in SQL

PERIOD = 4096
MAX_QUEUES = 128
REST = "*"  # the shared queue; keys of sources begin in another way
BUCKETS = 1024
CACHED_WORDS = 100_000
BATCH = 2048
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ENCODERS: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts by a tokenizer whose pieces never span ASCII white space; words are encoded once and remembered.

    A word that ends in a letter and ASCII marks is the letters' ids and the marks' ids, and ASCII case makes no difference,
    so words are remembered without either. Two generations are kept: what is not met again is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each of some different words."""
        known, older = self.known, self.older
        out = list(map(known.get, words))
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            found = older.get(words[i])
            if found is None:
                new.append(i)
            else:
                out[i] = known[words[i]] = found
        for k in range(0, len(new), 10_000):  # many words in one call, each encoded for itself
            at = new[k : k + 10_000]
            part = [words[i] for i in at]
            coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(coded.ids, "<u4").tobytes()
            ends = 4 * np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(part) + 1))
            for i, w, s, e in zip(at, part, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[i] = known[w] = raw[s:e]
        if len(known) > CACHED_WORDS:
            self.known, self.older = {}, known
        return out

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a pyarrow string array, end_id after each, and the number of ids of each text."""
        import pyarrow.compute as pc

        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per_text = np.diff(np.asarray(words.offsets).astype(np.int64))
        coded = words.flatten().dictionary_encode()
        unique = coded.dictionary
        bare = pc.utf8_rtrim(unique, characters=MARKS)
        # special tokens hold |>, and marks after another kind of sign would join it
        apart = pc.and_(pc.match_substring_regex(bare, r"[\p{L}\p{N}]$"), pc.invert(pc.match_substring(unique, "|>")))
        bare = pc.if_else(apart, pc.ascii_lower(bare), unique)
        tail = pc.if_else(apart, pc.struct_field(pc.extract_regex(unique, f"(?P<tail>[{re.escape(MARKS)}]*)$"), "tail"), "")
        heads, tails = bare.dictionary_encode(), tail.dictionary_encode()
        blobs = self._ids(heads.dictionary.to_pylist()) + self._ids(tails.dictionary.to_pylist())
        sizes = np.fromiter(map(len, blobs), np.int32, len(blobs)) // 4
        pool = np.frombuffer(b"".join(blobs), np.uint32)
        pairs = np.stack([np.asarray(heads.indices), np.asarray(tails.indices) + np.int32(len(heads.dictionary))], axis=1).ravel()
        pool = _gathered(pool, sizes, pairs)  # ids of the unique words
        sizes = sizes[pairs].reshape(-1, 2).sum(axis=1, dtype=np.int32)
        index = np.asarray(coded.indices)
        ids = _gathered(pool, sizes, index)
        at = np.concatenate([[0], np.cumsum(sizes[index], dtype=np.int64)])[np.concatenate([[0], np.cumsum(per_text)])]
        return np.insert(ids, at[1:], np.uint32(end_id)), np.diff(at) + 1


def _gathered(pool: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The stretches of pool, of these sizes one after another, in the order of index."""
    starts = np.cumsum(sizes, dtype=np.int32) - sizes
    n = sizes[index]
    before = np.cumsum(n, dtype=np.int32) - n
    return pool[np.repeat(starts[index] - before, n) + np.arange(n.sum(dtype=np.int64), dtype=np.int32)]


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenised(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """pid, doc_id, source_key, doc_tokens, place (tokens before it of its source in its partition), ids."""
    schema = "pid long, doc_id long, source_key string, doc_tokens long, place long, ids binary"
    served: dict = {}

    def run(doc_id, source_key, text):
        pid = TaskContext.get().partitionId()
        if served.get("pid") != pid:
            served.clear()
            served["pid"] = pid
        encoder = _encoder(path)
        out = [[], [], []]
        for i in range(0, len(text), BATCH):
            ids, lengths = encoder.encode(text[i : i + BATCH], end_id)
            raw, at = memoryview(ids.astype("<u4").tobytes()), 0
            for source, n in zip(source_key[i : i + BATCH].to_pylist(), lengths.tolist(), strict=True):
                out[0].append(n)
                out[1].append(served.get((source,), 0))
                served[source,] = out[1][-1] + n
                out[2].append(bytes(raw[4 * at : 4 * (at + n)]))
                at += n
        return [pid] * len(text), doc_id, source_key, *out

    key = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("source_key"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(rows(run, schema), schema)


def plan(sizes: dict[str, int], weights: dict[str, float], window: int) -> list[dict]:
    """Phases of the round robin: in each, a fixed set of sources with fixed shares.

    A phase has `first` (its first window), `at` (per source: tokens served before), and either `upto` (per source:
    cumulative shares, the part of PERIOD * window below and up to it) or `given` (one window: place and tokens).
    """
    left = {s: n for s, n in sorted(sizes.items()) if n > 0}
    done = dict.fromkeys(left, 0)
    phases, first = [], 0
    while left:
        active = list(left)
        share = np.array([max(0.0, weights.get(s, 0.0)) for s in active])
        if share.sum() <= 0:
            share = np.array([float(left[s]) for s in active])
        edges = [0, *(int(x) for x in np.round(np.cumsum(share) / share.sum() * PERIOD * window))]
        edges[-1] = PERIOD * window
        upto = {s: (edges[i], edges[i + 1]) for i, s in enumerate(active)}
        n = min((left[s] - 1) * PERIOD // (b - a) for s, (a, b) in upto.items() if b > a)
        if n > 0:
            phases.append({"first": first, "at": {s: done[s] for s in active if upto[s][1] > upto[s][0]}, "upto": upto})
            served = {s: n * b // PERIOD - n * a // PERIOD for s, (a, b) in upto.items()}
        else:
            n, room = 1, window
            served = {s: min(left[s], b // PERIOD - a // PERIOD) for s, (a, b) in upto.items()}
            room -= sum(served.values())
            for s in sorted(active, key=lambda s: left[s] - served[s]):  # those that are nearly dry first
                more = min(room, left[s] - served[s])
                served[s] += more
                room -= more
            place, given = 0, {}
            for s in active:
                given[s] = (place, served[s])
                place += served[s]
            phases.append({"first": first, "at": {s: done[s] for s in active if served[s]}, "given": given})
        for s in active:
            done[s] += served[s]
            left[s] -= served[s]
            if not left[s]:
                del left[s]
        first += n
    return phases


def pieces_of(phases: list[tuple], x: int, n: int, window: int) -> list[tuple[int, int, int]]:
    """(place in the output, place in the queue, tokens) of the queue's tokens x .. x + n - 1.

    phases: those of the queue's source, as (at, first, None or (a, b), None or (place, tokens)).
    """
    out, end = [], x + n
    i = bisect_right(phases, x, key=lambda p: p[0]) - 1
    while x < end:
        at, first, edge, given = phases[i]
        stop = min(end, phases[i + 1][0]) if i + 1 < len(phases) else end
        if given:
            out.append((first * window + given[0] + x - at, x, stop - x))
            x = stop
        else:
            a, b = edge
            w = (x - at) * PERIOD // (b - a)
            while w * b // PERIOD - w * a // PERIOD > x - at:
                w -= 1
            while (w + 1) * b // PERIOD - (w + 1) * a // PERIOD <= x - at:
                w += 1
            while x < stop:
                low, high = w * b // PERIOD - w * a // PERIOD, (w + 1) * b // PERIOD - (w + 1) * a // PERIOD
                upto = min(stop, at + high)
                if upto > x:
                    before = (w + 1) * a // PERIOD - w * a // PERIOD
                    out.append(((first + w) * window + before + x - at - low, x, upto - x))
                    x = upto
                w += 1
        i += 1
    return out


def _queues(parts: DataFrame, weights: dict[str, float] | None, scratch: Scratch) -> tuple[DataFrame, dict[str, int], dict[str, float]]:
    """source_key, queue, base (tokens of other sources before it in its queue); tokens and target of each queue."""
    spark = parts.sparkSession
    sizes = parts.groupBy("source_key").agg(F.sum("n").alias("n"))
    if weights:
        named = spark.createDataFrame([(f"s:{k}", float(w)) for k, w in weights.items()], "source_key string, target double")
        sizes = join_bounded(sizes, named, ["source_key"], "left").withColumn("target", F.greatest(F.coalesce("target", F.lit(0.0)), F.lit(0.0)))
    else:
        sizes = sizes.withColumn("target", F.col("n").cast("double"))
    sizes = scratch.keep(sizes, "sizes")
    first = sizes.orderBy(F.desc("target"), "source_key").limit(MAX_QUEUES - 1).collect()
    own = spark.createDataFrame([(r["source_key"],) for r in first], "source_key string")  # MAX_QUEUES - 1 rows at most
    others = sizes.join(F.broadcast(own), "source_key", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("source_key"), F.lit(BUCKETS)))
    per_bucket = others.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("target").alias("target")).orderBy("bucket").collect()  # BUCKETS rows at most
    bases, at = [], 0
    for r in per_bucket:
        bases.append((r["bucket"], at))
        at += r["n"]
    earlier = W.partitionBy("bucket").orderBy("source_key").rowsBetween(W.unboundedPreceding, -1)
    within = others.select("source_key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("within"))
    shared = within.join(F.broadcast(spark.createDataFrame(bases, "bucket long, start long")), "bucket").select("source_key", F.lit(REST).alias("queue"), (F.col("start") + F.col("within")).cast("long").alias("base"))
    queues = own.select("source_key", F.col("source_key").alias("queue"), F.lit(0).cast("long").alias("base")).unionByName(shared)
    total = {r["source_key"]: r["n"] for r in first} | ({REST: at} if at else {})
    target = {r["source_key"]: r["target"] for r in first} | ({REST: sum(r["target"] for r in per_bucket)} if at else {})
    return queues, total, target


def pack(docs: DataFrame, path: str, weights: dict[str, float] | None = None, length: int = 2048, window_sequences: int = 16, end_id: int = 1, carry_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_key, padded_to (and ids).

    weights: target token shares by source; by default the share that each source has of all tokens.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokens = scratch.keep(tokenised(docs, path, end_id), "tokens")
    parts = scratch.keep(tokens.groupBy("source_key", "pid").agg(F.sum("doc_tokens").alias("n")), "parts")
    queues, sizes, target = _queues(parts, weights, scratch)
    window = length * window_sequences
    own: dict[str, list[tuple]] = {q: [] for q in sizes}
    for p in plan(sizes, target, window):
        for s, at in p["at"].items():
            own[s].append((at, p["first"], p["upto"][s] if "upto" in p else None, p.get("given", {}).get(s)))
    total = sum(sizes.values())
    last, rest = divmod(total, length)
    last_pad = 1 << (rest - 1).bit_length() if rest else length
    shared = spark.sparkContext.broadcast(own)
    earlier = W.partitionBy("source_key").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long")
    offsets = join_bounded(parts.select("source_key", "pid", before.alias("before")), queues, ["source_key"], "inner").select("source_key", "pid", "queue", (F.col("before") + F.col("base")).alias("before"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_key string, padded_to long" + ", ids binary" * carry_ids

    def run(doc_id, source_key, queue, doc_tokens, x, ids):
        out = [[] for _ in range(9 + carry_ids)]
        for doc, source, q, n, x0, blob in zip(doc_id.to_pylist(), source_key.to_pylist(), queue.to_pylist(), doc_tokens.to_pylist(), x.to_pylist(), ids, strict=True):
            raw = memoryview(blob.as_buffer())
            for place, at, count in pieces_of(shared.value[q], x0, n, window):
                while count:
                    sequence, offset = divmod(place, length)
                    k = min(count, length - offset)
                    part = raw[4 * (at - x0) : 4 * (at - x0 + k)]
                    row = (doc, at - x0, k, zlib.crc32(part), n, sequence, offset, source, last_pad if sequence == last else length)
                    for column, value in zip(out, row + (bytes(part),) * carry_ids, strict=True):
                        column.append(value)
                    place, at, count = place + k, at + k, count - k
        return out

    placed = join_bounded(tokens, offsets, ["source_key", "pid"], "inner").select("doc_id", "source_key", "queue", "doc_tokens", (F.col("before") + F.col("place")).alias("x"), "ids")
    return placed.mapInArrow(rows(run, schema), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return pack(docs, tokenizer_path()).drop("source_key")
