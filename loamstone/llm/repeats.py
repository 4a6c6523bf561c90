"""Which keys occur twice or more in a whole corpus, told back to the rows that hold them.

Rows hold arrays of 64-bit keys. Each task sorts the keys of a chunk of rows. A key that is found twice in the chunk
is already known as repeated, so its places stay where they are and the key alone goes on; every other key goes on
with one place. Keys go to owners by value, so an owner sees each key once per chunk at most, however frequent it is:
no key is hot. Owners reply to each chunk with the places whose keys another chunk holds too.

Where a repeat decides what is removed, rows hold a second, independent hash of each string too (`checks`), and two keys
are equal only if both hashes are: 128 bits. Without it a rare false repeat costs work further on and changes no result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import Scratch, mix, trim

CHUNK = 1 << 19
KNOWN = np.uint32(0xFFFFFFFF)
BLOCK = 1 << 20
#: A 64-bit number per byte value; a string's hash is their sum weighted with powers of an odd base. Two independent sets.
BYTES = np.random.default_rng(2024).integers(1, 1 << 63, (2, 256), np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, list[np.ndarray]] = {}
SENT = "kind int, chunk long, owner int, ids binary, keys binary, checks binary, places binary"


def powers(function: int = 0) -> list[np.ndarray]:
    """Powers of the function's base and of its inverse modulo 2^64, for blocks of BLOCK bytes and some more."""
    if function not in _POWERS:
        found = _POWERS[function] = []
        for base in (BASES[function], pow(BASES[function], -1, 1 << 64)):
            p = np.full(BLOCK + 4096, base, np.uint64)
            p[0] = 1
            found.append(np.multiply.accumulate(p))
    return _POWERS[function]


def string_hashes(strings, function: int = 0) -> np.ndarray:
    """64-bit hashes of the strings of a pyarrow string array, whole blocks at a time."""
    n = len(strings)
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8) if n and strings.buffers()[2] is not None else np.zeros(0, np.uint8)
    up, down = powers(function)
    out, i = np.empty(n, np.uint64), 0
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + BLOCK, side="right")) - 1
        if j <= i:  # longer than a block
            out[i] = xxhash.xxh64_intdigest(data[ends[i] : ends[i + 1]], function)
            i += 1
            continue
        part = data[ends[i] : ends[j]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[function][part] * up[: len(part)], out=sums[1:])
        s, e = ends[i:j] - ends[i], ends[i + 1 : j + 1] - ends[i]
        out[i:j] = mix((sums[e] - sums[s]) * down[s])
        i = j
    return out


def ordered(keys: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and for it whether each is equal to the one before."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    if checks is not None:
        c = checks[order]
        apart = c[1:] != c[:-1]
        if (same & apart).any():
            order = np.lexsort((checks, keys))
            k, c = keys[order], checks[order]
            same, apart = k[1:] == k[:-1], c[1:] != c[:-1]
        same &= ~apart
    return order, same


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the string a + b from the hashes of its halves."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))


def doubled(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of `length` items, built by doubling the length."""
    size = 1
    while size < length:
        step = min(size, length - size)  # the last step overlaps
        if len(h) <= step:
            return h[:0]
        h = combine(h[:-step], h[step:])
        size += step
    return h


def least(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` hashes the place of its smallest one, leftmost at ties. Depends on the window's content only."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    block = (1 << 22) - width
    if n > block:  # places need to fit the low bits
        return np.concatenate([least(h[i : i + block + width - 1], width) + i for i in range(0, n, block)])
    low = np.uint64((1 << 22) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    pad = -len(v) % width
    v = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors (smallest hashes of windows) and for every window the index of its anchor."""
    at = least(h, width)
    if not len(at):
        return at, at
    new = np.concatenate([[True], at[1:] != at[:-1]])
    return at[new], np.cumsum(new) - 1


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def owners_of(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def repeated(rows: DataFrame, ids: list[str], scratch: Scratch, keyed=None, checked: bool = False) -> DataFrame:
    """ids, hits: for each distinct id with one the places (32-bit) of its keys that occur twice or more.

    rows: the id columns (longs, not null), keys (64-bit, one binary) and, if `checked`, checks (likewise); or what `keyed`, a
    function of Arrow batches, makes these of, in the same worker. Rows with equal ids must hold equal keys.
    """
    n_ids, owners = len(ids), owners_of(rows)

    def send(batches):
        import pyarrow as pa

        partition, chunk = TaskContext.get().partitionId(), 0

        def flush(own: list[np.ndarray], arrays: list[np.ndarray], seconds: list[np.ndarray]):
            sizes = np.array([len(a) for a in arrays])
            keys, checks = np.concatenate(arrays), np.concatenate(seconds) if checked else None
            row = np.repeat(np.arange(len(arrays), dtype=np.uint32), sizes)
            place = (np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
            order, same = ordered(keys, checks)
            keys, places = keys[order], np.stack([row[order], place[order]], axis=1)
            same = np.concatenate([[False], same, [False]])
            first, twice = ~same[:-1], same[:-1] | same[1:]
            known = places[twice]
            places[twice] = KNOWN
            keys, places = keys[first], places[first]
            checks = checks[order][first] if checked else np.zeros(0, np.uint64)
            at = ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(at, np.arange(owners + 1))
            name = (partition << 24) + chunk
            out = [(0, name, -1, np.stack(own, axis=1).tobytes(), b"", b"", known.tobytes())]
            out += [(1, name, o, b"", keys[s:e].tobytes(), checks[s:e].tobytes(), places[s:e].tobytes()) for o, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
            types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["kind", "chunk", "owner", "ids", "keys", "checks", "places"])

        own, arrays, seconds, n = [[] for _ in ids], [], [], 0
        for b in keyed(batches) if keyed else batches:
            columns = [np.asarray(b[c]) for c in ids]
            for i, k in enumerate(b["keys"]):
                a = np.frombuffer(k.as_buffer(), np.uint64)
                if not len(a):
                    continue
                for o, c in zip(own, columns, strict=True):
                    o.append(c[i])
                arrays.append(a)
                if checked:
                    seconds.append(np.frombuffer(b["checks"][i].as_buffer(), np.uint64))
                n += len(a)
                if n >= CHUNK:
                    yield flush([np.array(o, np.int64) for o in own], arrays, seconds)
                    own, arrays, seconds, n, chunk = [[] for _ in ids], [], [], 0, chunk + 1
        if n:
            yield flush([np.array(o, np.int64) for o in own], arrays, seconds)
        del own, arrays, seconds
        trim()

    sent = scratch.keep(rows.mapInArrow(send, SENT), "keys")

    def reply(pdf):
        import pandas as pd

        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in pdf["keys"]])
        checks = np.concatenate([np.frombuffer(k, np.uint64) for k in pdf["checks"]]) if checked else None
        places = np.concatenate([np.frombuffer(p, np.uint32).reshape(-1, 2) for p in pdf["places"]])
        sizes = [len(k) // 8 for k in pdf["keys"]]
        order, same = ordered(keys, checks)
        same = np.concatenate([[False], same, [False]])
        hit = np.zeros(len(keys), bool)
        hit[order] = same[:-1] | same[1:]
        hit &= places[:, 0] != KNOWN
        ends = np.cumsum(sizes)
        out = [(c, places[s:e][hit[s:e]].tobytes()) for c, s, e in zip(pdf["chunk"], ends - sizes, ends, strict=True) if hit[s:e].any()]
        del keys, checks, places, order, same, hit
        trim()
        return pd.DataFrame(out, columns=["chunk", "places"])

    replies = sent.filter("kind = 1").select("owner", "chunk", "keys", "checks", "places").groupBy("owner").applyInPandas(reply, "chunk long, places binary")
    known = sent.filter("kind = 0").select("chunk", "ids", "places")
    schema = ", ".join(f"{c} long" for c in ids) + ", hits binary"

    def gather(pdf):
        import pandas as pd

        own = np.frombuffer(next(x for x in pdf["ids"] if x is not None), np.int64).reshape(-1, n_ids)
        places = np.concatenate([np.frombuffer(p, np.uint32).reshape(-1, 2) for p in pdf["places"]])
        places = places[np.lexsort((places[:, 1], places[:, 0]))]
        rows, starts = np.unique(places[:, 0], return_index=True)
        ends = np.append(starts, len(places))[1:]  # none, where nothing of the chunk repeats
        out = pd.DataFrame({c: own[rows, i] for i, c in enumerate(ids)})
        out["hits"] = [places[s:e, 1].tobytes() for s, e in zip(starts, ends, strict=True)]
        return out

    both = known.unionByName(replies.withColumn("ids", F.lit(None).cast("binary")))
    found = both.groupBy("chunk").applyInPandas(gather, schema)
    out = scratch.keep(found.groupBy(*ids).agg(F.first("hits").alias("hits")), "hits")
    scratch.drop(sent)
    return out
