"""World files: region files of chunks, and the tagged binary trees inside them."""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.functions.palette import unpack_indices

SECTOR = 4096
NUMBERS = {1: (">b", 1), 2: (">h", 2), 3: (">i", 4), 4: (">q", 8), 5: (">f", 4), 6: (">d", 8)}
ARRAYS = {7: "b", 11: "i", 12: "q"}
MAX_DEPTH = 512


class TreeError(ValueError):
    """The bytes are not a tree that can be read."""


class Typed:
    """A value of a tree with its tag, so that trees can be written back."""

    __slots__ = ("tag", "value")

    def __init__(self, tag: int, value):
        self.tag, self.value = tag, value

    def __eq__(self, other) -> bool:
        return isinstance(other, Typed) and (self.tag, self.value) == (other.tag, other.value)


def read_tree(data: bytes) -> Typed:
    """The root of a big-endian tagged tree: numbers, text, arrays, lists and compounds."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n < 0 or at + n > len(data):
            raise TreeError(f"truncated at {at}: {n} bytes wanted")
        at += n
        return data[at - n : at]

    def text() -> str:
        return take(struct.unpack(">H", take(2))[0]).decode("utf-8", "replace")

    def value(tag: int, depth: int) -> Typed:
        if depth > MAX_DEPTH:
            raise TreeError("nested too deeply")
        if tag in NUMBERS:
            form, n = NUMBERS[tag]
            return Typed(tag, struct.unpack(form, take(n))[0])
        if tag == 8:
            return Typed(tag, text())
        if tag in ARRAYS:
            form = ARRAYS[tag]
            n = struct.unpack(">i", take(4))[0]
            return Typed(tag, list(struct.unpack(f">{n}{form}", take(n * struct.calcsize(form if form != "q" else ">q")))))
        if tag == 9:
            inner, n = struct.unpack(">bi", take(5))
            return Typed(tag, [value(inner, depth + 1) for _ in range(n)])
        if tag == 10:
            out = {}
            while inner := take(1)[0]:
                name = text()
                out[name] = value(inner, depth + 1)
            return Typed(tag, out)
        raise TreeError(f"unknown tag {tag}")

    tag = take(1)[0]
    text()
    return value(tag, 0)


def plain(node: Typed):
    """Python values of a tree."""
    if node.tag == 9:
        return [plain(x) for x in node.value]
    if node.tag == 10:
        return {k: plain(v) for k, v in node.value.items()}
    return node.value


def tree_bytes(root: Typed) -> bytes:
    """The tree as read_tree takes it, with an unnamed root."""
    raw = canonical_bytes(root)
    return raw[:1] + b"\0\0" + raw[1:]


def canonical_bytes(node: Typed) -> bytes:
    """Tag and payload with the keys of compounds in order, so that equal content has equal bytes."""

    def payload(n: Typed) -> bytes:
        if n.tag in NUMBERS:
            return struct.pack(NUMBERS[n.tag][0], n.value)
        if n.tag == 8:
            raw = n.value.encode()
            return struct.pack(">H", len(raw)) + raw
        if n.tag in ARRAYS:
            return struct.pack(f">i{len(n.value)}{ARRAYS[n.tag]}", len(n.value), *n.value)
        if n.tag == 9:
            return struct.pack(">bi", n.value[0].tag if n.value else 0, len(n.value)) + b"".join(payload(x) for x in n.value)
        out = b""
        for name in sorted(n.value):
            raw = name.encode()
            out += struct.pack(">BH", n.value[name].tag, len(raw)) + raw + payload(n.value[name])
        return out + b"\0"

    return bytes([node.tag]) + payload(node)


def decompressed(tag: int, raw: bytes) -> bytes:
    """Chunk payload by its compression tag: 1 gzip, 2 zlib, 3 none, 4 zstd; others are refused."""
    if tag == 1:
        return gzip.decompress(raw)
    if tag == 2:
        return zlib.decompress(raw)
    if tag == 3:
        return raw
    if tag == 4:
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise TreeError(f"unknown compression {tag}")


def compressed(tag: int, raw: bytes) -> bytes:
    """What decompressed() undoes; the same input gives the same bytes."""
    if tag == 1:
        return gzip.compress(raw, mtime=0)
    if tag == 2:
        return zlib.compress(raw)
    if tag == 3:
        return raw
    if tag == 4:
        return zstandard.ZstdCompressor().compress(raw)
    raise TreeError(f"unknown compression {tag}")


def region_bytes(chunks: dict[tuple[int, int], tuple[int, int, bytes]]) -> bytes:
    """A region file of (lx, lz) -> (time, compression tag, compressed tree). Chunks stand in order of their header index."""
    head, body = bytearray(2 * SECTOR), bytearray()
    for (lx, lz), (ts, tag, raw) in sorted(chunks.items(), key=lambda c: c[0][::-1]):
        if not (0 <= lx < 32 and 0 <= lz < 32):
            raise ValueError(f"chunk ({lx}, {lz}) is outside the region")
        sectors = -(-(len(raw) + 5) // SECTOR)
        if sectors > 0xFF:
            raise ValueError(f"chunk ({lx}, {lz}) is larger than a region file can tell")
        i = 4 * (lx + 32 * lz)
        head[i : i + 4] = (2 + len(body) // SECTOR).to_bytes(3, "big") + bytes([sectors])
        head[SECTOR + i : SECTOR + i + 4] = struct.pack(">i", ts)
        body += struct.pack(">IB", len(raw) + 1, tag) + raw
        body += bytes(-len(body) % SECTOR)
    return bytes(head + body)


def chunk_headers(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(lx, lz, time, offset) of each chunk that is there; the index runs x first."""
    if len(data) < 2 * SECTOR:
        return
    for i in range(1024):
        offset = int.from_bytes(data[4 * i : 4 * i + 3], "big")
        if offset:
            yield i & 31, i >> 5, int.from_bytes(data[SECTOR + 4 * i : SECTOR + 4 * i + 4], "big", signed=True), offset * SECTOR


def chunk_tree(data: bytes, start: int) -> Typed | None:
    """The tree of the chunk at an offset, None beyond the end of the file (it counts as absent); TreeError if it is damaged."""
    if start + 5 > len(data):
        return None
    length = int.from_bytes(data[start : start + 4], "big")
    try:
        return read_tree(decompressed(data[start + 4], data[start + 5 : start + 4 + length]))
    except (struct.error, EOFError, zlib.error, OSError, zstandard.ZstdError) as e:
        raise TreeError(str(e)) from e


def region_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all files below a path with the name of a region file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "r.*.mca").load(path).select("path", "content")


def _placed(files: DataFrame) -> DataFrame:
    from loamstone.functions.coords import region_of_file

    return files.withColumn("r", region_of_file("path", "mca")).filter("r is not null").select("path", "r.rx", "r.rz", "content")


def scan_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, rx, rz, lx, lz, header_ts of the chunks of all region files: the cheap scan before the change gate."""
    return headers_of(region_files(spark, path))


def headers_of(files: DataFrame) -> DataFrame:
    """scan_headers of files (path, content)."""

    def run(batches):
        for pdf in batches:
            rows = [(p, rx, rz, lx, lz, ts) for p, rx, rz, data in pdf.itertuples(index=False) for lx, lz, ts, _ in chunk_headers(data)]
            yield pd.DataFrame(rows, columns=["path", "rx", "rz", "lx", "lz", "header_ts"])

    head = _placed(files).withColumn("content", F.substring("content", 1, 2 * SECTOR))
    return head.mapInPandas(run, "path string, rx int, rz int, lx int, lz int, header_ts long")


def _entry(e) -> tuple[str, dict]:
    if isinstance(e, str):
        return e, {}
    name = e.get("id") or e.get("Name") or "?"
    return name, {k: str(v) for k, v in (e.get("properties") or e.get("Properties") or {}).items()}


def _section(container: dict | None, blocks: bool) -> tuple[list[str], np.ndarray] | None:
    """Canonical names and index of a section, None without a palette."""
    if not container or not container.get("palette"):
        return None
    names = []
    for e in container["palette"]:
        name, properties = _entry(e)
        names.append(f"{name}[{','.join(f'{k}={properties[k]}' for k in sorted(properties))}]" if properties else name)
    width = 4096 if blocks else 64
    if len(names) == 1:
        return names, np.zeros(width, np.int64)
    bits = max(4 if blocks else 1, (len(names) - 1).bit_length())
    index = unpack_indices(np.array(container.get("data") or [], np.int64), bits, width)
    if index.max() >= len(names):
        raise TreeError("an index is beyond the palette")
    return names, index


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """One row per section: place, status, x_pos, z_pos, y, block and biome names and digests, tiles; error rows for bad chunks."""
    return sections_in(region_files(spark, path))


def sections_in(files: DataFrame) -> DataFrame:
    """read_sections of files (path, content)."""
    schema = "path string, rx int, rz int, lx int, lz int, header_ts long, status string, x_pos int, z_pos int, y int, block_names array<string>, block_digest string, biome_names array<string>, biome_digest string, tiles array<struct<type:string,x:int,y:int,z:int>>, error string"
    columns = [c.split()[0] for c in schema.split(", ")]

    def digest(section):
        if section is None:
            return None, None
        names, index = section
        order = {n: r for r, n in enumerate(sorted(names))}
        return sorted(names), hashlib.sha1(np.array([order[n] for n in names], "<u2")[index].tobytes()).hexdigest()

    def run(batches):
        for pdf in batches:
            rows = []
            for p, rx, rz, data in pdf.itertuples(index=False):
                for lx, lz, ts, start in chunk_headers(data):
                    base = dict.fromkeys(columns) | {"path": p, "rx": rx, "rz": rz, "lx": lx, "lz": lz, "header_ts": ts}
                    try:
                        node = chunk_tree(data, start)
                        if node is None:
                            continue
                        root = plain(node)
                        base |= {"status": root.get("Status"), "x_pos": root.get("xPos"), "z_pos": root.get("zPos")}
                        tiles = [{"type": t.get("id"), "x": t.get("x"), "y": t.get("y"), "z": t.get("z")} for t in root.get("block_entities") or [] if "id" in t]
                        parts = []
                        for s in root.get("sections") or []:
                            block, biome = digest(_section(s.get("block_states"), True)), digest(_section(s.get("biomes"), False))
                            parts.append(base | {"y": s.get("Y", 0), "block_names": block[0], "block_digest": block[1], "biome_names": biome[0], "biome_digest": biome[1]})
                        parts = parts or [base]
                        parts[0] = parts[0] | {"tiles": tiles}
                        rows += parts
                    except (ValueError, KeyError, TypeError, AttributeError) as e:  # damaged, or a tree of another shape
                        rows.append(base | {"error": str(e)})
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)

    return _placed(files).mapInPandas(run, schema)


def read_tiles(spark: SparkSession, path: str, min_y: int = -64) -> DataFrame:
    """path, rx, rz, lx, lz, pos, type, nbt, error of the tiles of all chunks: place inside the chunk, name, and the rest in canonical bytes.

    Tiles without a name or place, and those outside their chunk, are left out. A chunk that cannot be read is one row with error.
    """
    return tiles_in(region_files(spark, path), min_y)


def tiles_in(files: DataFrame, min_y: int = -64) -> DataFrame:
    """read_tiles of files (path, content)."""
    schema = "path string, rx int, rz int, lx int, lz int, pos long, type string, nbt binary, error string"
    place = ("id", "x", "y", "z")

    def tiles(root: Typed, rx: int, rz: int, lx: int, lz: int) -> Iterator[tuple]:
        listed = root.value.get("block_entities")
        for t in listed.value if listed else []:
            if t.tag != 10 or any(k not in t.value for k in place):
                continue
            name, x, y, z = (t.value[k].value for k in place)
            x, z, y = x - (rx * 32 + lx) * 16, z - (rz * 32 + lz) * 16, y - min_y
            if 0 <= x <= 0xFF and 0 <= z <= 0xFF and 0 <= y <= 0xFFFF:
                rest = Typed(10, {k: v for k, v in t.value.items() if k not in (*place, "keepPacked")})
                yield y << 16 | z << 8 | x, name, canonical_bytes(rest), None

    def run(batches):
        for pdf in batches:
            rows = []
            for p, rx, rz, data in pdf.itertuples(index=False):
                for lx, lz, _, start in chunk_headers(data):
                    at = (p, rx, rz, lx, lz)
                    try:
                        root = chunk_tree(data, start)
                        rows += [at + t for t in tiles(root, *at[1:])] if root is not None else []
                    except (ValueError, TypeError, AttributeError) as e:  # damaged, or a tree of another shape
                        rows.append((*at, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    return _placed(files).mapInPandas(run, schema)


def auxiliary_files(spark: SparkSession, path: str) -> DataFrame:
    """path (below the root), ts, content of all files that are not region files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.regexp_replace("path", "^.*?" + re.escape(path.split(":")[-1].rstrip("/")) + "/", "")
    kept = ~F.concat(F.lit("/"), below).contains("/region/") & ~below.rlike(r"(^|/)session\.lock$")
    return found.filter(kept).select(below.alias("path"), F.unix_seconds("modificationTime").alias("ts"), "content")
