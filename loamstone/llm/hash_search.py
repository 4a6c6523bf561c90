"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A bounded sample fixes a mean, principal axes and several rotations that make the signs of the rotated axes fit the data
(iterative quantisation); every vector gets the code of those signs. Codes are cut into m substrings of 16 bits and each
substring is indexed inside each block of the index. A code within Hamming radius r of a query agrees with it up to
floor(r / m) bits on one of the m substrings at least (pigeonhole), so probing the lists of all nearby substring values
finds every code within r. Every query is answered by probing, whatever the lengths of the lists. What is found goes on
to the exact Euclidean distance of the original vectors if its whole code is within `reach`, which is r or wider.

The radius is the smallest m * (t + 1) - 1 whose lists hold `target` of the sample's own nearest neighbours, and the
reach holds all but a few of them; as the whole table is denser than the sample, both hold more there. A query that finds
fewer than k neighbours is searched again at twice the radius, up to all bits, so a query gets k results whenever there are
as many candidates.

Every row is indexed. Queries go out in blocks of `QUERY_BLOCK` at most, which bounds what is broadcast; every block
of the index returns its k best per query and never a list of candidates. Null or zero vectors, vectors with a null
or non-finite component, and vectors of another length than most of the sample take no part. Rows that share the
query's id are the query's own; where several rows have it, the smallest vector asks, once. Other repeated rows are
candidates of their own. Ties go to the smaller id. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.llm.common import Scratch

QUERY = "op2_multi_index_hashing"
ORACLE = None  # an approximate search; tests compare with brute force

SAMPLE = 8_000
QUERY_BLOCK = 4_096
INDEX_BLOCK = 65_536
SUBSTRING = 16
_WEIGHTS = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16))
RESULT = "query_id long, vec_id long, score double"


class Codes:
    """Mean, axes and rotations; code() gives one row of bytes per vector."""

    def __init__(self, sample: np.ndarray, tables: int = 2, steps: int = 40, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred / max(1, len(sample)))
        dim = sample.shape[1]
        width = -(-dim // SUBSTRING) * SUBSTRING  # codes are whole substrings
        projections = []
        z = np.pad(centred @ axes[:, ::-1], ((0, 0), (0, width - dim)))
        for _ in range(tables):
            r = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(steps):
                u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
                r = (u @ v).T
            projections.append(axes[:, ::-1] @ r[:dim])
        self.projection = np.hstack(projections)
        self.bits = self.projection.shape[1]
        self.parts = self.bits // SUBSTRING

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.projection > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int32)


def values_near(bits: int) -> np.ndarray:
    """All differences between substrings that are at most `bits` bits apart."""
    return np.flatnonzero(_WEIGHTS <= bits)


class Block:
    """Index of one block: for each substring the rows in order of its value, and where each value's list starts."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        substrings = self.codes.view(np.uint16).T
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in substrings]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << SUBSTRING))]).astype(np.int32) for c in substrings]

    def probed(self, code: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Rows in the lists of the substring values that differ from the code's own by one of `near`."""
        found = np.zeros(len(self.codes), bool)
        for order, starts, own in zip(self.order, self.starts, code.view(np.uint16).astype(np.int64), strict=True):
            values = near ^ own
            first = starts[values]
            n = starts[values + 1] - first
            some = n > 0
            first, n = first[some], n[some]
            found[order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return np.flatnonzero(found)

    def within(self, code: np.ndarray, radius: int, reach: int | None = None, near: np.ndarray | None = None) -> np.ndarray:
        """All rows whose code is at most `radius` bits away, and of the others probed those within `reach`."""
        if near is None:
            near = values_near(radius // len(self.order))
        rows = self.probed(code, near)
        return rows[distances(self.codes[rows], code) <= max(radius, reach or 0)]


def _valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _calibrated(codes: Codes, sample: np.ndarray, k: int, target: float) -> tuple[int, int]:
    """Radius whose lists hold `target` of the k nearest of up to 400 sample rows, and the reach that holds 99.5 % of them."""
    own = codes.code(sample)
    substrings = own.view(np.uint16)
    lists, whole = [], []
    for i in range(min(400, len(sample))):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1))[:k]
        lists.append(np.bitwise_count(substrings[near] ^ substrings[i]).min(axis=1))
        whole.append(distances(own[near], own[i]))
    near = int(np.quantile(np.concatenate(lists), target, method="higher"))
    radius = min(codes.bits, codes.parts * (near + 1) - 1)
    return radius, max(radius, int(np.quantile(np.concatenate(whole), 0.995)))


def search(vectors: DataFrame, query_ids, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE, target: float = 0.97, tables: int = 6) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each id for which query_ids (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hashing")
    table = scratch.keep(_valid(vectors, id_column, vector_column), "vectors")
    few = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    lengths = np.diff(np.asarray(few["v"].combine_chunks().offsets)) if few.num_rows else np.zeros(0, int)
    if not len(lengths):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(np.bincount(lengths).argmax())
    rows = few["v"].combine_chunks().filter(lengths == dim)
    fitted = _matrix(rows, dim)
    codes = Codes(fitted, tables)
    radius, reach = _calibrated(codes, fitted, k, target)
    model = spark.sparkContext.broadcast(codes)

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                c = model.value.code(_matrix(b["v"], dim))
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array([r.tobytes() for r in c], pa.binary())], ["vec_id", "v", "code"])

    index = scratch.keep(table.filter(F.size("v") == dim).mapInArrow(encode, "vec_id long, v array<double>, code binary"), "index")
    asking = index.filter(query_ids).groupBy("vec_id").agg(F.min(F.struct("v", "code")).alias("q"))
    queries = scratch.keep(asking.select("vec_id", "q.v", "q.code"), "queries")
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    results = []
    for block in range(blocks):
        # a block is bounded: range of the query ids' hash, split until no block exceeds QUERY_BLOCK
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks)).isin(2 * block, 2 * block + 1))
        results.append(_search_block(spark, scratch, index, mine, codes.bits, (radius, reach), k, dim))
    scratch.drop(table)
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return found


def _search_block(spark, scratch: Scratch, index: DataFrame, queries: DataFrame, bits: int, radii: tuple[int, int], k: int, dim: int) -> DataFrame:
    radius, reach = radii
    asked = queries.select("vec_id", "v", "code").limit(2 * QUERY_BLOCK + 1).toArrow()
    if asked.num_rows > 2 * QUERY_BLOCK:
        parts = [queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(radius)), F.lit(2)) == i) for i in (0, 1)]
        a, b = (_search_block(spark, scratch, index, p, bits, radii, k, dim) for p in parts)
        return a.unionByName(b)
    ids = np.asarray(asked["vec_id"])
    vectors = np.asarray(asked["v"].combine_chunks().flatten()).reshape(-1, dim) if len(ids) else np.zeros((0, dim))
    codes = np.array([np.frombuffer(c.as_py(), np.uint8) for c in asked["code"]]) if len(ids) else np.zeros((0, bits // 8), np.uint8)
    left = np.arange(len(ids))
    done = []
    while True:
        shared = spark.sparkContext.broadcast((ids[left], vectors[left], codes[left]))
        top = _pass(index, shared, radius, reach, k, dim)
        order = W.partitionBy("query_id").orderBy("score", "vec_id")
        ranked = scratch.keep(top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")
        full = ranked.filter(F.col("rank") == k).select("query_id").toArrow()["query_id"].to_numpy() if len(left) else np.zeros(0)
        short = left[~np.isin(ids[left], full)]
        if not len(short) or radius >= bits:
            return _union([*done, ranked])
        done.append(ranked.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids[short]], "query_id long")), "query_id", "left_anti"))
        left, radius, reach = short, min(bits, max(1, 2 * radius)), min(bits, 2 * reach)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pass(index: DataFrame, shared, radius: int, reach: int, k: int, dim: int) -> DataFrame:
    """The k best of each query in each block of the index, among what `within` finds."""

    def run(batches):
        import pyarrow as pa

        ids, vectors, codes = shared.value

        def flush(parts):
            own = np.concatenate([np.asarray(p["vec_id"]) for p in parts])
            x = np.concatenate([_matrix(p["v"], dim) for p in parts])
            c = np.concatenate([np.frombuffer(b"".join(p["code"].to_pylist()), np.uint8).reshape(p.num_rows, -1) for p in parts])
            block, near = Block(c), values_near(radius // (c.shape[1] * 8 // SUBSTRING))
            out = [[], [], []]
            for q, v, code in zip(ids, vectors, codes, strict=True):
                rows = block.within(code, radius, reach, near)
                rows = rows[own[rows] != q]
                d = np.sqrt(((x[rows] - v) ** 2).sum(axis=1))
                if len(rows) > k:
                    edge = np.partition(d, k - 1)[k - 1]
                    best = d <= edge
                    rows, d = rows[best], d[best]
                best = np.lexsort((own[rows], d))[:k]
                out[0].append(np.full(len(best), q))
                out[1].append(own[rows[best]])
                out[2].append(d[best])
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score"])

        parts, n = [], 0
        for b in batches:
            parts.append(b)
            n += b.num_rows
            if n >= INDEX_BLOCK:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    return index.mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
