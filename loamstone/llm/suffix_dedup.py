"""Suffix-array deduplication by a distributed merge sort that knows common prefixes.

A string of `length` bytes (400) is repeated if it starts at two places. Sorting suffixes brings equal strings
together; sorting the suffixes of all places would move the corpus many times over, so the sort is given

1. Suffixes at anchors only. Every string of 400 bytes has one anchor, the place of its 200-byte gram of smallest hash.
   It depends on the string's content only, so equal strings have it at the same offset.
2. Suffixes that can matter only. Grams that occur once in the corpus are filtered out by exchanging their hashes.

Each task sorts its suffixes (with the bytes before the anchor as baggage) into a run, front-codes it (length of the
prefix shared with the suffix before, and the rest), cuts it at splitters sampled from all suffixes, and sends the parts
to their ranges. A range merges its parts with a loser tree whose nodes hold the length of the prefix shared with the last
winner: most matches are decided by comparing two numbers, and the others look at bytes behind the known prefix only.
The merged order gives the common prefix of neighbours for free. Suffixes that share their gram form a group; for each
member the bytes shared to the right are the smallest common prefix on the way to the other one, and those shared to the
left come from the baggage. Members that no neighbour explains completely are compared with the distinct members of a
small group, or by counting hashes (128 bits) of the strings of a large one, so groups are never compared pair by pair.
Splitters are cut to the gram, so a group lies in one range unless it is larger than a range; the parts of such a hot
group exchange the hashes of their strings, so that it is never gathered in one task.

All bytes of all repeated strings are removed, at each place. Null text is empty text; texts under 400 bytes lose
nothing. Rows with equal id and text are documents of their own and repeat each other. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loamstone.llm.common import Scratch, mix, rows, trim
from loamstone.llm.repeats import BLOCK, BYTES, anchors, ordered, owners_of, powers, repeated, runs
from loamstone.llm.window_dedup import NO_ID, keyed_documents, mask_of

QUERY = "op3_suffix_merge"
ORACLE = None  # byte windows of whole tables are out of reach for SQL; tests compare with brute force

LENGTH = 400
SMALL_GROUP = 32
RUN_BYTES = 12 << 20
SAMPLES = 16
CUT_ROWS = 256
SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def gram_hashes(b: np.ndarray, size: int, function: int = 0) -> np.ndarray:
    """Hashes of all grams of `size` bytes of a uint8 array; equal grams have equal hashes wherever they are."""
    n = len(b) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > BLOCK:
        return np.concatenate([gram_hashes(b[i : i + BLOCK + size - 1], size, function) for i in range(0, n, BLOCK)])
    up, down = powers(function)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTES[function][b] * up[: len(b)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n])


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            k = min(len(x), len(y))
            diff = int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")
            return known + k - (diff.bit_length() + 7) // 8 if diff else known + k
        known += 64
    return n


def shared_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = a[len(a) - n :], b[len(b) - n :]
    if x == y:
        return n
    diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return ((diff & -diff).bit_length() - 1) // 8


def front_coded(sorted_strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For each string the length shared with the one before, and the rest."""
    shared, rest, last = [], [], b""
    for s in sorted_strings:
        k = shared_prefix(last, s)
        shared.append(k)
        rest.append(s[k:])
        last = s
    return shared, rest


def merge(parts: list[tuple[list[bytes], list[int]]]):
    """Merges sorted lists of (strings, length shared with the one before) by a loser tree.

    Yields (part, index, length shared with the string yielded before).
    """
    k = 1
    while k < max(1, len(parts)):
        k *= 2
    strings = [p[0] for p in parts] + [[]] * (k - len(parts))
    lengths = [p[1] for p in parts] + [[]] * (k - len(parts))
    at = [0] * k
    now = [s[0] if s else None for s in strings]
    shared = [0 if s else -1 for s in strings]  # with the winner that beat it; -1: dry
    tree = [0] * k

    def beaten(c: int, j: int) -> tuple[int, int]:
        """Winner and loser of c and j."""
        hc, hj = shared[c], shared[j]
        if hc > hj:
            return c, j
        if hc < hj:
            return j, c
        if hc < 0:
            return c, j
        a, b = now[c], now[j]
        known = shared_prefix(a, b, hc)
        if known == len(a) or (known < len(b) and a[known] < b[known]):
            shared[j] = known
            return c, j
        shared[c] = known
        return j, c

    winners = list(range(k)) * 2
    for node in range(k - 1, 0, -1):
        a, b = (winners[2 * node], winners[2 * node + 1]) if 2 * node < k else (2 * node - k, 2 * node + 1 - k)
        winners[node], tree[node] = beaten(a, b)
    c = winners[1] if k > 1 else 0
    while now[c] is not None:
        yield c, at[c], shared[c]
        at[c] += 1
        i = at[c]
        if i < len(strings[c]):
            now[c] = strings[c][i]
            shared[c] = lengths[c][i]
        else:
            now[c] = None
            shared[c] = -1
        node = (k + c) >> 1
        while node:
            j = tree[node]
            if shared[c] <= shared[j]:
                c, tree[node] = beaten(c, j)
            node >>= 1


def _sizes(length: int) -> tuple[int, int]:
    """Bytes of a gram, and grams in a string."""
    return length // 2, length - length // 2 + 1


def _repeated(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """doc, tag, hits: the anchors of each text whose grams are found twice or more."""
    gram, width = _sizes(length)

    def run(doc, tag, text):
        out = []
        for t in text:
            b = np.frombuffer(t.as_buffer(), np.uint8)
            if len(b) < length:
                out.append(b"")
                continue
            h = gram_hashes(b, gram)
            out.append(h[anchors(h, width)[0]].tobytes())
        return doc, tag, out

    schema = "doc long, tag long, keys binary"
    return repeated(docs.select("doc", "tag", "text"), ["doc", "tag"], scratch, rows(run, schema))


def _survivors(joined: DataFrame, length: int) -> DataFrame:
    """doc, tag, start, bytes: stretches whose strings' grams were hit."""
    gram, width = _sizes(length)

    def run(doc, tag, text, hits):
        out = [[], [], [], []]
        for d, g, t, h in zip(doc.to_pylist(), tag.to_pylist(), text, hits, strict=True):
            raw = t.as_buffer()
            b = np.frombuffer(raw, np.uint8)
            _, of_string = anchors(gram_hashes(b, gram), width)
            hit = np.zeros(of_string[-1] + 1, bool)
            hit[np.frombuffer(h.as_buffer(), np.uint32)] = True
            for s, e in zip(*runs(hit[of_string]), strict=True):
                for column, value in zip(out, (d, g, int(s), b[s : e + length - 1].tobytes()), strict=True):
                    column.append(value)
        return out

    schema = "doc long, tag long, start long, bytes binary"
    return joined.mapInArrow(rows(run, schema), schema)


def _suffixes(raw: bytes, length: int) -> list[tuple[int, bytes, bytes]]:
    """(anchor, bytes before it, suffix at it) for each anchor of a stretch, as far as its strings reach."""
    gram, width = _sizes(length)
    at, of_string = anchors(gram_hashes(np.frombuffer(raw, np.uint8), gram), width)
    first = np.searchsorted(of_string, np.arange(len(at)))
    last = np.append(first[1:], len(of_string)) - 1
    return [(a, raw[s:a], raw[a : e + length]) for a, s, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]


def _splitters(stretches: DataFrame, ranges: int, length: int) -> list[bytes]:
    """Cuts between ranges from a hashed sample of about ranges * SAMPLES suffixes, which is all that the driver gets."""
    total = stretches.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    rate = min(1.0, ranges * SAMPLES * _sizes(length)[1] / 2 / max(1, total))  # an anchor stands in every width / 2 bytes

    def run(doc, tag, start, **columns):
        out = []
        for t, s, b in zip(tag.to_pylist(), start.to_pylist(), columns["bytes"], strict=True):
            found = _suffixes(b.as_py(), length)
            place = mix(np.array([(t ^ (s + a) * 0x2545F4914F6CDD1D) & ((1 << 64) - 1) for a, _, _ in found], np.uint64))
            out += [found[i][2] for i in np.flatnonzero(place.astype(np.float64) <= rate * 2.0**64)]
        return [out]

    sample = sorted(bytes(r["suffix"]) for r in stretches.mapInArrow(rows(run, "suffix binary"), "suffix binary").collect())
    gram, _ = _sizes(length)
    picked = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    hot = {a[:gram] for a, b in zip(picked, picked[1:], strict=False) if a[:gram] == b[:gram]}
    return sorted({c if c[:gram] in hot else c[:gram] for c in picked} | hot)


PART = "range int, doc binary, shared binary, rest_size binary, rest binary, left_size binary, left binary, low int, high int"


def _sorted_runs(stretches: DataFrame, splitters, length: int) -> DataFrame:
    """Front-coded parts of sorted runs. Entries before `low` and from `high` on belong to neighbouring ranges."""

    def run(batches):
        import pyarrow as pa

        cuts = splitters.value

        def flush(found: list[tuple[bytes, bytes, int, int, int]]):
            found.sort()
            keys = [f[0] for f in found]
            edges = [0, *(bisect_left(keys, c) for c in cuts), len(found)]
            out = []
            for r, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                low, high = max(0, s - 1), min(len(found), e + 1)  # with one neighbour on either side
                part = found[low:high]
                if not part:
                    continue
                shared, rest = front_coded([p[0] for p in part])
                out.append((
                    r, np.array([p[2:] for p in part], np.int64).tobytes(), np.array(shared, np.uint32).tobytes(), np.array([len(x) for x in rest], np.uint32).tobytes(), b"".join(rest),
                    np.array([len(p[1]) for p in part], np.uint32).tobytes(), b"".join(p[1] for p in part), s - low, e - low,
                ))
            types = [pa.int32(), *[pa.binary()] * 6, pa.int32(), pa.int32()]
            names = [x.split()[0] for x in PART.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        found, size = [], 0
        for b in batches:
            for doc, tag, start, raw in zip(b["doc"].to_pylist(), b["tag"].to_pylist(), b["start"].to_pylist(), b["bytes"], strict=True):
                for a, left, suffix in _suffixes(raw.as_py(), length):
                    found.append((suffix, left, doc, tag, start + a))
                    size += len(left) + len(suffix) + 200
                if size >= RUN_BYTES:
                    yield flush(found)
                    found, size = [], 0
        if found:
            yield flush(found)
        del found
        trim()

    return stretches.mapInArrow(run, PART)


def _counted(kinds: dict[tuple[bytes, bytes], list[int]], length: int) -> dict[tuple[bytes, bytes], np.ndarray]:
    """For each kind of member of a group, which of its strings another kind has too."""
    strings = [np.frombuffer(left + suffix, np.uint8) for suffix, left in kinds]
    hashes = [gram_hashes(b, length) for b in strings]
    order, same = ordered(np.concatenate(hashes), np.concatenate([gram_hashes(b, length, 1) for b in strings]))
    same = np.concatenate([[False], same, [False]])
    twice = np.empty(len(order), bool)
    twice[order] = same[:-1] | same[1:]
    ends = np.cumsum([len(h) for h in hashes])
    return {k: twice[e - len(h) : e] for k, h, e in zip(kinds, hashes, ends, strict=True)}


class Group:
    """Suffixes that share their gram, in order; edge: whether the group goes on in another range."""

    def __init__(self):
        self.members: list[tuple[bytes, bytes, int, int, int, bool]] = []  # suffix, left, doc, tag, at, own
        self.shared: list[int] = []
        self.edge = False

    def add(self, member, shared: int) -> None:
        self.members.append(member)
        self.shared.append(shared)

    def settle(self, length: int, covers: list, open_: list) -> None:
        """Adds (doc, tag, start, end) to covers, and to open_ what needs the exact check."""
        m = self.members
        n = len(m)
        if n < 2:
            return
        if self.edge:  # the other range may hold what proves a member, and the other way round
            open_ += [x for x in m if x[5]]
            return
        proven: list[list[tuple[int, int]]] = [[] for _ in m]  # (bytes to the left, bytes to the right)
        for i in range(1, n):
            left, right = shared_suffix(m[i - 1][1], m[i][1]), self.shared[i]
            if left + right >= length:
                proven[i - 1].append((left, right))
                proven[i].append((left, right))
        doubtful = [i for i in range(n) if n > 2 and self._doubtful(i, proven[i], length)]
        if doubtful:
            kinds: dict[tuple[bytes, bytes], list[int]] = {}  # one member of each kind, and how many there are
            for i, x in enumerate(m):
                kinds.setdefault((x[0], x[1]), [i, 0])[1] += 1
            counted = _counted(kinds, length) if len(kinds) > SMALL_GROUP else None
            for i in doubtful:
                kind = m[i][:2]
                if kinds[kind][1] > 1:
                    proven[i].append((len(kind[1]), len(kind[0])))
                elif counted is not None:
                    for s, e in zip(*runs(counted[kind]), strict=True):
                        proven[i].append((len(kind[1]) - int(s), int(e) - 1 + length - len(kind[1])))
                else:
                    for j, _ in kinds.values():
                        if j != i:
                            right = shared_prefix(kind[0], m[j][0], length // 2)
                            left = shared_suffix(kind[1], m[j][1])
                            if left + right >= length:
                                proven[i].append((left, right))
        for x, found in zip(m, proven, strict=True):
            if x[5] and found:  # all that is proven holds the anchor, so it is one stretch
                covers.append((x[2], x[3], x[4] - max(a for a, _ in found), x[4] + max(b for _, b in found)))

    def _doubtful(self, i: int, proven: list[tuple[int, int]], length: int) -> bool:
        """Whether some string of the member that its right side allows is not proven."""
        suffix, left = self.members[i][:2]
        reach = max(self.shared[i], self.shared[i + 1] if i + 1 < len(self.shared) else 0)
        at, stop = -len(left), min(reach, len(suffix)) - length  # places of strings, relative to the anchor
        for lo, hi in sorted((-a, b - length) for a, b in proven):
            if lo <= at:
                at = max(at, hi + 1)
        return at <= stop


def _merged(parts: DataFrame, length: int) -> DataFrame:
    gram, _ = _sizes(length)

    def run(pdf):
        import pandas as pd

        streams, more, owned = [], [], []
        for p in pdf.itertuples(index=False):
            shared = np.frombuffer(p.shared, np.uint32).tolist()
            ends = np.cumsum(np.frombuffer(p.rest_size, np.uint32)).tolist()
            strings, last, at = [], b"", 0
            for k, e in zip(shared, ends, strict=True):
                last = last[:k] + p.rest[at:e]
                strings.append(last)
                at = e
            streams.append((strings, shared))
            left_ends = np.cumsum(np.frombuffer(p.left_size, np.uint32)).tolist()
            more.append((np.frombuffer(p.doc, np.int64).reshape(-1, 3).tolist(), [0, *left_ends], p.left))
            owned.append((p.low, p.high))
        covers, open_ = [], []
        group = Group()
        for part, i, shared in merge(streams):
            ids, ends, left = more[part]
            own = owned[part][0] <= i < owned[part][1]
            if shared < gram:
                group.settle(length, covers, open_)
                group, shared = Group(), 0
            group.add((streams[part][0][i], left[ends[i] : ends[i + 1]], *ids[i], own), shared)
            group.edge |= not own
        group.settle(length, covers, open_)
        del streams, more
        out = [(0, d, t, s, e, None, None) for d, t, s, e in covers]
        for suffix, left, d, t, at, _ in open_:
            whole = np.frombuffer(left + suffix, np.uint8)
            out.append((1, d, t, at - len(left), 0, gram_hashes(whole, length).tobytes(), gram_hashes(whole, length, 1).tobytes()))
        del covers, open_, group
        trim()
        return pd.DataFrame(out, columns=["kind", "doc", "tag", "start", "end", "keys", "checks"])

    return parts.groupBy("range").applyInPandas(run, "kind int, doc long, tag long, start long, end long, keys binary, checks binary")


def repeated_strings(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """doc, tag, starts, ends: bytes that repeated strings cover, per distinct (doc, tag). docs as in keyed_documents, text as binary."""
    ranges = owners_of(docs)
    hits = _repeated(docs, length, scratch)
    stretches = scratch.keep(_survivors(docs.join(hits.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "hits"), length), "stretches")
    scratch.drop(hits)
    splitters = docs.sparkSession.sparkContext.broadcast(_splitters(stretches, ranges, length))
    found = scratch.keep(_merged(_sorted_runs(stretches, splitters, length), length), "merged")
    scratch.drop(stretches)
    listed = found.filter("kind = 1").groupBy("doc", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "keys", "checks"))).alias("p"))

    def concatenated(doc, tag, starts, keys, checks):
        out = [[], [], []]
        for s, k, c in zip(starts.to_pylist(), keys, checks, strict=True):
            blobs = k.as_py()
            out[0].append(np.array([(x, len(b) // 8) for x, b in zip(s, blobs, strict=True)], np.int64).tobytes())
            out[1].append(b"".join(blobs))
            out[2].append(b"".join(c.as_py()))
        return doc, tag, *out

    schema = "doc long, tag long, places binary, keys binary, checks binary"
    columns = [F.col(f"p.{c}").alias(a) for c, a in (("start", "starts"), ("keys", "keys"), ("checks", "checks"))]
    strings = scratch.keep(listed.select("doc", "tag", *columns).mapInArrow(rows(concatenated, schema), schema), "strings")
    hits = repeated(strings.select("doc", "tag", "keys", "checks"), ["doc", "tag"], scratch, checked=True)

    def run(doc, tag, places, hits):
        out = [[], [], [], []]
        for d, t, p, h in zip(doc.to_pylist(), tag.to_pylist(), places, hits, strict=True):
            starts, sizes = np.frombuffer(p.as_buffer(), np.int64).reshape(-1, 2).T
            first = np.cumsum(sizes) - sizes
            i = np.frombuffer(h.as_buffer(), np.uint32).astype(np.int64)
            stretch = np.searchsorted(first, i, side="right") - 1
            at = np.unique(starts[stretch] + i - first[stretch])
            new = np.concatenate([[True], np.diff(at) > length])
            for a, b in zip(at[new].tolist(), at[np.append(new[1:], True)].tolist(), strict=True):
                for column, value in zip(out, (d, t, a, b + length), strict=True):
                    column.append(value)
        return out

    schema = "doc long, tag long, start long, end long"
    exact = strings.select("doc", "tag", "places").join(hits, ["doc", "tag"]).select("doc", "tag", "places", "hits").mapInArrow(rows(run, schema), schema)
    both = found.filter("kind = 0").select("doc", "tag", "start", "end").unionByName(exact)
    return both.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, tag, kept (the remaining bytes), n_bytes, n_removed, n_spans for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    keyed = keyed_documents(docs).withColumn("text", F.col("text").cast("binary"))
    covers = scratch.keep(repeated_strings(keyed, scratch, length), "covers")

    def run(doc, tag, text, starts, ends):
        out = [[], [], [], []]
        for t, s, e in zip(text, starts, ends, strict=True):
            b = np.frombuffer(t.as_buffer(), np.uint8)
            mask = mask_of(len(b), s.values, e.values) if s.is_valid else np.zeros(len(b), bool)
            row = (b[~mask].tobytes(), len(b), int(mask.sum()), len(runs(mask)[0]))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return doc, tag, *out

    schema = "doc long, tag long, kept binary, n_bytes long, n_removed long, n_spans long"
    joined = keyed.join(covers.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "tag", "text", "starts", "ends")
    return joined.mapInArrow(rows(run, schema), schema).withColumn("doc", F.nullif("doc", F.lit(NO_ID)))


def long_runs(b: np.ndarray, mask: np.ndarray, least: int) -> np.ndarray:
    """mask without its runs that hold fewer than `least` whole words."""
    gap = np.concatenate([[True], np.isin(b, SPACES), [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])  # of the words
    mask = mask.copy()
    for s, e in zip(*runs(mask), strict=True):
        if np.searchsorted(ends, e, side="right") - np.searchsorted(starts, s) < least:
            mask[s:e] = False
    return mask


def without_repeats(docs: DataFrame, length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """docs (its columns, among them doc_id and text) without the repeated bytes; n_chars, if there, counts the new text.

    With `least_words`, a repeated run of bytes goes only if it holds so many whole words. A character of which a byte is
    removed goes whole. Rows all stay, with empty text at least; null text stays null.
    """
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession, "suffixes")
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the other columns travel as one value, so that none of them can clash with those of the join
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")
    keyed = docs.select(others, F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(own).alias("tag"))
    covers = scratch.keep(repeated_strings(keyed_documents(docs).withColumn("text", F.col("text").cast("binary")), scratch, length), "covers")

    def cut(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, CUT_ROWS):
                batch = whole.slice(i, CUT_ROWS)
                out = []
                for t, s, e in zip(batch["text"], batch["starts"], batch["ends"], strict=True):
                    if t.is_valid and s.is_valid:
                        b = np.frombuffer(t.as_buffer(), np.uint8)
                        mask = mask_of(len(b), s.values, e.values)
                        if least_words:
                            mask = long_runs(b, mask, least_words)
                        t = b[~mask].tobytes().decode("utf-8", "ignore")
                    else:
                        t = t.as_py()
                    out.append(t)
                yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.string())], ["row", "left"])
        trim()

    joined = keyed.join(covers.hint("shuffle_hash"), ["doc", "tag"], "left").select("row", "text", "starts", "ends")
    left = joined.mapInArrow(cut, StructType([joined.schema["row"], StructField("left", StringType())]))
    new = {"text": F.col("left"), "n_chars": F.length("left").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return left.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
