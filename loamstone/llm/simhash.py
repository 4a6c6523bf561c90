"""SimHash near-duplicate detection with pigeonhole blocks.

A 64-bit fingerprint is cut into 8 blocks of 8 bits. Two fingerprints at a distance of 2 or less agree on
at least 6 blocks, so they share one of the 28 keys "which 6 blocks, and their 48 bits". Fingerprints (not
documents) are joined on those keys, and the Hamming distance is verified inside each key's group. A group
has 2^16 members at most, whatever the corpus, as only 16 bits are free; its links leave it as a spanning
forest, never as all pairs. Components are then found over the links of distinct fingerprints.

Null text counts as empty; an empty text has fingerprint 0 and is linked like any other. Texts are whole, however
long: the bits are counted in pieces. A bit that is set in just half of the hashes is 0. Rows with the same doc_id are
separate rows, and equal texts are one fingerprint with one class; of several doc_ids the smallest names the component.
A null doc_id is carried and names none unless all doc_ids of its component are null. Empty tables give no rows. Columns
besides `doc_id` and `text` are not read by `components_of` and are carried by `near_duplicates` untouched, whatever
their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import Scratch, join_bounded, rows, trim
from loamstone.llm.repeats import repeated

QUERY = "op9_simhash_dedup"
ORACLE = None  # 64-bit XXH64 and components over links are not in DuckDB's SQL

BITS = 64
BLOCKS = 8
CELLS = 2048


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 (big-endian) of the lower-cased text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        shingles = [b" ".join(words)] * bool(words)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, seed) for s in shingles]), ">u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the big-endian hashes."""
    n = len(hashes)
    packed = hashes.view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(packed[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of the lower-cased text's word shingles."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(doc_id, text):
        prints = np.array([fingerprint(t, width, seed) for t in text.to_pylist()], np.uint64)
        return doc_id, prints.view(np.int64)

    schema = "doc_id long, fp long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows(run, schema), schema)


def _forest(fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph "at most `radius` bits apart" over one group."""
    n = len(fps)
    left = np.arange(n)
    a, b = [], []
    todo = np.arange(n)
    seen = np.zeros(n, bool)
    for start in range(n):  # breadth first; each member is compared with those not reached yet
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        left = todo[~seen[todo]]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
            found = left[near]
            if len(found):
                seen[found] = True
                a.append(np.full(len(found), nodes[x]))
                b.append(nodes[found])
                queue.extend(found.tolist())
                left = left[~near]
        todo = left
        if not len(todo):
            break
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def pigeonhole_masks(radius: int) -> list[int]:
    """Bits of every choice of 8 - radius blocks: fingerprints within `radius` agree on one of them at least."""
    size = BITS // BLOCKS
    return [sum(((1 << size) - 1) << (size * k) for k in kept) for kept in combinations(range(BLOCKS), BLOCKS - radius)]


def _forests(keyed: DataFrame, radius: int) -> DataFrame:
    """a, b: forest edges of the groups of keyed (t, k, node, fp), which lies sorted by group."""
    import pyarrow as pa

    def found(m):
        starts = np.flatnonzero(np.r_[True, (m[0, 1:] != m[0, :-1]) | (m[1, 1:] != m[1, :-1])])
        sizes = np.diff(np.r_[starts, m.shape[1]])
        two = starts[sizes == 2]
        two = two[np.bitwise_count((m[3, two] ^ m[3, two + 1]).view(np.uint64)) <= radius]
        out = [(m[2, two], m[2, two + 1])]
        out += [_forest(m[3, s : s + n].view(np.uint64), m[2, s : s + n], radius) for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True)]
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        parts = []  # of the group at the end, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.array([c.to_numpy().astype(np.int64) for c in batch.columns])
            if parts and (m[:2, -1] == parts[0][:2, 0]).all():
                parts.append(m)
                continue
            m = np.concatenate([*parts, m], axis=1)
            other = np.flatnonzero((m[:2] != m[:2, -1:]).any(axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            parts = [m[:, cut:]]
            if cut:
                yield found(m[:, :cut])
        if parts:
            yield found(np.concatenate(parts, axis=1))
        del parts
        trim()

    return keyed.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links between distinct fingerprints, as a spanning forest per key. prints: node, fp, both unique; those of null nodes get none."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in pigeonhole_masks(radius)]
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])).alias("key")
    keyed = prints.filter("node IS NOT NULL").select("node", "fp", key).select("key.t", "key.k", "node", "fp")
    return _forests(keyed.repartition("t", "k").sortWithinPartitions("t", "k"), radius).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component: the smallest node reachable, for every node that has a link.

    Alternating stars: large-star hooks larger neighbours to the smallest one, small-star the smaller ones. The
    number of rounds grows with the logarithm of the component size; each round is a stored table.
    """
    edges = scratch.keep(edges.filter("a != b").select("a", "b"), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        down = large.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        low2 = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low2, "x").select(F.explode(F.array(F.struct(F.col("y").alias("b"), F.col("m").alias("a")), F.struct(F.col("x").alias("b"), F.col("m").alias("a")))).alias("e"))
        after = scratch.keep(small.select("e.a", "e.b").filter("a != b").distinct(), "edges")
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        scratch.drop(edges)
        edges = after
        if not changed:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def components_of(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, width, seed), "fingerprints")
    return prints.join(_components_of_prints(prints, radius, scratch), "fp").select("doc_id", "fp", "component_id")


def _components_of_prints(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """fp, component_id for every fingerprint of prints (doc_id, fp)."""
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = scratch.keep(components(links(classes, radius), scratch), "components")
    return classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc, cls, fp, shingles: the sorted shingle hashes of each row with a doc_id, one hash over them all, and the fingerprint (of three words)."""

    def run(doc, text):
        sets, prints = [], []
        for t in text.to_pylist():
            prints.append(fingerprint(t))
            sets.append(np.unique(shingle_hashes(t, width).astype(np.uint64)).tobytes())
        return doc, np.array([xxhash.xxh64_intdigest(s, 7) for s in sets], np.uint64).view(np.int64), np.array(prints, np.uint64).view(np.int64), sets

    schema = "doc long, cls long, fp long, shingles binary"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    return texts.filter(F.col("doc").isNotNull()).mapInArrow(rows(run, schema), schema)


def _frequent(sets: DataFrame, most: int = 300_000, chunk: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts, which only set an order: counted in chunks of all sets.

    A shingle is counted in the chunks in which two sets have it, so little leaves a chunk, and none that is frequent
    everywhere is missed.
    """

    def count(batches):
        import pyarrow as pa

        def flush(parts):
            s, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s[n > 1]), pa.array(n[n > 1])], ["s", "n"])

        parts, size = [], 0
        for b in batches:
            for raw in b["shingles"]:
                parts.append(np.frombuffer(raw.as_py(), np.int64))
                size += len(parts[-1])
                if size >= chunk:
                    yield flush(parts)
                    parts, size = [], 0
        if size:
            yield flush(parts)
        del parts
        trim()

    counts = sets.select("shingles").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "s").limit(most).toArrow()
    hashes, counts = found["s"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _prefixes(sets: DataFrame, similarity: float, often, width: int = 128) -> DataFrame:
    """doc, cls, n, lo, hi, cells, keys: the shingles of each set's prefix, frequent shingles last.

    Two sets of n and o shingles that are similar share one in their first n - ceil(similarity n) + 1, whatever the order.
    lo and hi are the parities of the set's shingles in 128 cells; cells those in CELLS cells.
    """

    def run(doc, cls, shingles):
        hashes, counts = often.value
        keys, sizes, parity, fine = [], [], [], []
        for raw in shingles:
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            n = len(s)
            take = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0  # empty sets are one class already
            first = s[:take]
            if len(hashes) and n:
                at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                weight = np.where(hashes[at] == s, counts[at], 0)
                if weight.any():
                    first = s[np.argsort(weight, kind="stable")[:take]]
            keys.append(first.tobytes())
            sizes.append(n)
            cells = np.bincount((s % np.uint64(width)).astype(np.int64), minlength=width) & 1
            parity.append(np.packbits(cells.astype(np.uint8)).view(np.int64))
            cells = np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 1
            fine.append(np.packbits(cells.astype(np.uint8)).tobytes())
        bits = np.array(parity).reshape(-1, 2)
        return doc, cls, np.array(sizes, np.int32), bits[:, 0], bits[:, 1], fine, keys

    schema = "doc long, cls long, n int, lo long, hi long, cells binary, keys binary"
    return sets.select("doc", "cls", "shingles").mapInArrow(rows(run, schema), schema)


def _postings(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """k, doc, cls, n, pos, lo, hi: a row for each shingle of a prefix that another prefix has too.

    Which these are is found by exchanging the hashes alone, so what only one document has is never sorted.
    """
    hits = repeated(prefixes.select("doc", "cls", "keys"), ["doc", "cls"], scratch)

    def run(doc, cls, n, lo, hi, keys, hits):
        at = [np.frombuffer(h.as_buffer(), np.uint32) for h in hits]
        found = [np.frombuffer(k.as_buffer(), np.int64)[i] for k, i in zip(keys, at, strict=True)]
        each = np.array([len(i) for i in at])
        wide = [np.repeat(c.to_numpy(), each) for c in (doc, cls, n, lo, hi)]
        return [np.concatenate(found), *wide[:3], np.concatenate(at).astype(np.int32), *wide[3:]]

    schema = "k long, doc long, cls long, n int, pos int, lo long, hi long"
    joined = prefixes.join(hits.hint("shuffle_hash"), ["doc", "cls"]).select("doc", "cls", "n", "lo", "hi", "keys", "hits")
    return joined.mapInArrow(rows(run, schema, 512), schema)


def _candidates(postings: DataFrame, similarity: float, every: bool) -> DataFrame:
    """a, b: classes that may be similar, a the one of smaller doc. No similar pair fails the tests of size, place and parity.

    With every, all pairs; else those of members that no smaller one of their key meets, and one pair at least for each
    other member, so that a cluster of g near copies gives g pairs.
    """
    import pyarrow as pa

    def may(x, y):
        total, least = x[3] + y[3], similarity / (1 + similarity) * (x[3] + y[3]) - 1e-6
        sized = np.minimum(x[3], y[3]) >= similarity * np.maximum(x[3], y[3]) - 1e-6
        placed = np.minimum(x[3] - x[4], y[3] - y[4]) >= least
        apart = np.bitwise_count((x[5] ^ y[5]).view(np.uint64)).astype(np.int64) + np.bitwise_count((x[6] ^ y[6]).view(np.uint64))
        return sized & placed & (apart <= total - 2 * least) & (x[2] != y[2])

    def group(m):
        met = np.zeros(m.shape[1], bool)
        for i in range(m.shape[1] - 1):
            to = np.arange(i + 1, m.shape[1])
            if met[i] and not every:
                to = to[~met[to]]
            if not len(to):
                continue
            to = to[may(m[:, i : i + 1], m[:, to])]
            met[to] = True
            if len(to):
                yield np.full(len(to), m[2, i]), m[2, to]

    def found(m):
        starts = np.flatnonzero(np.r_[True, m[0, 1:] != m[0, :-1]])
        sizes = np.diff(np.r_[starts, m.shape[1]])
        two = starts[sizes == 2]
        two = two[may(m[:, two], m[:, two + 1])]
        out = [(m[2, two], m[2, two + 1])]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            out.extend(group(m[:, s : s + n]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        parts = []  # of the key at the end, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.array([c.to_numpy().astype(np.int64) for c in batch.columns])
            if parts and m[0, -1] == parts[0][0, 0]:
                parts.append(m)
                continue
            m = np.concatenate([*parts, m], axis=1)
            cut = int(np.searchsorted(m[0], m[0, -1]))
            parts = [m[:, cut:]]
            if cut:
                yield found(m[:, :cut])
        if parts:
            yield found(np.concatenate(parts, axis=1))

    return postings.repartition("k").sortWithinPartitions("k", "doc", "cls").mapInArrow(run, "a long, b long").distinct()


def _plausible(pairs: DataFrame, prefixes: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs whose sets may be similar by the parities in their cells: sets that differ in d shingles differ in d cells at most."""
    sketch = scratch.keep(prefixes.select("cls", "n", "cells").dropDuplicates(["cls"]), "cells")

    def run(a, b, n, o, x, y):
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, CELLS // 64) for c in (x, y))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        total = n.to_numpy().astype(np.int64) + o.to_numpy()
        keep = apart <= total - 2 * (similarity / (1 + similarity) * total - 1e-6)
        return a.to_numpy()[keep], b.to_numpy()[keep]

    first, second = (sketch.select(F.col("cls").alias(side), F.col("n").alias(n), F.col("cells").alias(x)) for side, n, x in (("a", "n", "x"), ("b", "o", "y")))
    sided = pairs.join(first, "a").join(second, "b").select("a", "b", "n", "o", "x", "y")
    out = scratch.keep(sided.mapInArrow(rows(run, "a long, b long"), "a long, b long"), "plausible")
    scratch.drop(sketch)
    return out


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs whose shingle sets are similar."""
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    few = scratch.keep(join_bounded(sets, needed, ["cls"], "left_semi", 200_000).select("cls", "shingles").dropDuplicates(["cls"]), "sets")

    def run(a, b, x, y):
        keep = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= similarity * (len(p) + len(q) - both))
        keep = np.array(keep, bool)
        return a.to_numpy()[keep], b.to_numpy()[keep]

    sided = pairs.join(few.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(few.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    out = scratch.keep(sided.select("a", "b", "x", "y").mapInArrow(rows(run, "a long, b long", 256), "a long, b long"), "alike")
    scratch.drop(few)
    return out


def _settled(pairs: DataFrame, alike: DataFrame) -> DataFrame:
    """cls: what leaves for good, as it is like one that no smaller one is paired with."""
    return alike.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select(F.col("b").alias("cls")).distinct()


def _covered(firsts: DataFrame, similarity: float, radius: int, scratch: Scratch) -> DataFrame:
    """a, b: classes that are similar to the smallest one of their component of fingerprints, and that one as a."""
    prints = scratch.keep(firsts.select(F.col("doc").alias("doc_id"), "cls", "fp"), "prints")
    members = scratch.keep(prints.join(_components_of_prints(prints, radius, scratch), "fp").select("doc_id", "cls", "component_id"), "members")
    least = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "cls")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = scratch.keep(members.join(least, "component_id").select(F.col("least.cls").alias("a"), F.col("cls").alias("b")).filter("a != b").distinct(), "linked")
    return _alike(pairs, firsts, similarity, scratch)


def _leaving(firsts: DataFrame, similarity: float, often, scratch: Scratch) -> DataFrame:
    """cls: of the classes in firsts (doc, cls, shingles), those similar to one that stays before them.

    Candidates are drawn by the prefix filter and compared exactly. Two rounds settle clusters by their first member alone;
    then all pairs of the rest are drawn.
    """
    rest, gone = firsts, []
    for every in (False, False, True):
        prefixes = scratch.keep(_prefixes(rest, similarity, often), "prefixes")
        pairs = scratch.keep(_candidates(_postings(prefixes, scratch), similarity, every), "pairs")
        alike = _alike(_plausible(pairs, prefixes, similarity, scratch), rest, similarity, scratch)
        scratch.drop(prefixes)
        if every:
            while alike.limit(1).count():
                gone.append(scratch.keep(_settled(alike, alike), "gone"))
                before = alike.select("a").distinct().join(alike.select(F.col("b").alias("a")), "a", "left_anti")
                left = alike.join(before, "a", "left_anti").join(gone[-1].select(F.col("cls").alias("a")), "a", "left_anti")
                alike = scratch.keep(left.join(gone[-1].select(F.col("cls").alias("b")), "b", "left_anti").select("a", "b"), "alike")
            break
        gone.append(scratch.keep(_settled(pairs, alike), "gone"))
        open_ = scratch.keep(pairs.select(F.col("b").alias("cls")).distinct().join(gone[-1], "cls", "left_anti"), "open")
        if not open_.limit(1).count():
            break
        rest = scratch.keep(join_bounded(firsts, open_, ["cls"], "left_semi", 200_000), "rest")
    away = gone[0]
    for more in gone[1:]:
        away = away.unionByName(more)
    return away


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """Rows of docs without those whose word shingles have a Jaccard similarity of `similarity` or more with one that stays.

    Documents go by rising doc_id: one stays if it is similar to none that stays before it. So no two that stay are similar
    and each that leaves is similar to one that stays. Equal shingle sets are one class. Classes are linked by fingerprint as in
    `components_of`, but at `radius` bits (4: 70 keys of 32 bits), and each that is similar, by exact comparison, to the smallest
    one of its component is covered by it. Similar pairs may be more bits apart than any radius with selective keys, so what is
    not covered goes through the prefix filter, which misses none at any size, and is compared exactly. What a class that leaves had covered is then taken up
    too, and if again a covering class leaves, everything is: what is covered at the end leaves by a class that stays, so
    the fingerprints decide how much is compared and never who stays. Pairs can be many only where thousands of documents
    consist of the same frequent shingles for four fifths and are still not similar. Rows with the same doc_id stay or leave
    together; null doc_ids stay. Empty texts are similar.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sets = scratch.keep(_shingle_sets(docs, width), "shingles")
    classes = scratch.keep(sets.groupBy("cls").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    several = classes.filter("copies > 1").select("cls", "first")
    firsts = join_bounded(sets, several, ["cls"], "left", 200_000).filter("first IS NULL OR first = doc").select("doc", "cls", "fp", "shingles")
    covers = _covered(firsts, similarity, radius, scratch)
    often = docs.sparkSession.sparkContext.broadcast(_frequent(firsts))
    for last in (False, True, True):
        covered = covers.select(F.col("b").alias("cls"))
        away = _leaving(join_bounded(firsts, covered, ["cls"], "left_anti", 200_000), similarity, often, scratch)
        lost = covers.join(away.select(F.col("cls").alias("a")), "a", "left_semi")
        if not lost.limit(1).count():
            break
        covers = covers.limit(0) if last else scratch.keep(covers.join(away.select(F.col("cls").alias("a")), "a", "left_anti").select("a", "b"), "covers")
    away = away.unionByName(covers.select(F.col("b").alias("cls")))
    staying = classes.join(away, "cls", "left_anti").select(F.col("first").alias("doc")).distinct()
    leaving = scratch.keep(sets.select("doc").distinct().join(staying, "doc", "left_anti").select(F.col("doc").alias("doc_id")), "leaving")
    return docs.join(leaving.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = components_of(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
