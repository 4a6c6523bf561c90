"""Coordinates of the voxel store as column expressions: regions, segments, tiles, atoms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimension -> (id, lowest y, height)
DIMENSIONS = {"overworld": (0, -64, 384), "nether": (1, 0, 256), "the_end": (2, 0, 256)}
REGION_SIDE = 32
BLOCK_WIDTH, BIOME_WIDTH = 4096, 64


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sections_of(dimension: str) -> int:
    return DIMENSIONS[dimension][2] // 16


def parse_dimension(name: str) -> str:
    """Dimension of a name in any case and with outer blanks; ValueError for others."""
    found = name.strip().lower()
    if found not in DIMENSIONS:
        raise ValueError(f"unknown dimension: {name!r}; one of {', '.join(DIMENSIONS)}")
    return found


def floor_div32(x) -> Column:
    """Sector of a region: rounds down for negatives too (an arithmetic shift)."""
    return F.shiftright(_c(x), 5)


def region_id(rx, rz, dim) -> Column:
    """Both coordinates as 21-bit two's complement, and the dimension's id above them."""
    ux, uz = (_c(v).cast("long").bitwiseAND(F.lit(0x1FFFFF).cast("long")) for v in (rx, rz))
    ud = _c(dim).cast("long").bitwiseAND(F.lit(0xFFFFF).cast("long"))
    return F.shiftleft(ud, 42).bitwiseOR(F.shiftleft(ux, 21)).bitwiseOR(uz)


def region_of_id(rid) -> Column:
    """struct(rx, rz, dim) of a region id."""

    def signed(u: Column) -> Column:
        return F.when(u >= 0x100000, u - 0x200000).otherwise(u).cast("int")

    low = F.lit(0x1FFFFF).cast("long")
    return F.struct(
        signed(F.shiftrightunsigned(_c(rid), 21).bitwiseAND(low)).alias("rx"),
        signed(_c(rid).bitwiseAND(low)).alias("rz"),
        F.shiftrightunsigned(_c(rid), 42).bitwiseAND(F.lit(0xFFFFF).cast("long")).cast("int").alias("dim"),
    )


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("int"))


def segment_index(x, z) -> Column:
    """x * 32 + z; fails outside 0..31."""
    x, z = _c(x), _c(z)
    return _checked(x.between(0, 31) & z.between(0, 31), x * REGION_SIDE + z, "segment coordinates are 0..31")


def header_index(x, z) -> Column:
    """Place in a world file's header: x + z * 32."""
    return _c(x) + _c(z) * REGION_SIDE


def chunk_key(x, z) -> Column:
    return F.shiftleft(_c(x).cast("long"), 32).bitwiseOR(_c(z).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def tile_position(x, z, y) -> Column:
    """y << 16 | z << 8 | x."""
    return F.shiftleft(_c(y).cast("int"), 16).bitwiseOR(F.shiftleft(_c(z).cast("int"), 8)).bitwiseOR(_c(x).cast("int"))


def tile_of_position(p) -> Column:
    p, byte = _c(p), F.lit(0xFF)
    return F.struct(p.bitwiseAND(byte).alias("x"), F.shiftright(p, 8).bitwiseAND(byte).alias("z"), F.shiftrightunsigned(p, 16).alias("y"))


def local_tile(x, y, z, chunk_x, chunk_z, min_y) -> Column:
    """Chunk-local struct(x, z, y) of a world position, null outside 0..255, 0..255, 0..65535."""
    lx, lz, ly = _c(x) - _c(chunk_x) * 16, _c(z) - _c(chunk_z) * 16, _c(y) - _c(min_y)
    inside = lx.between(0, 0xFF) & lz.between(0, 0xFF) & ly.between(0, 0xFFFF)
    return F.when(inside, F.struct(lx.alias("x"), lz.alias("z"), ly.alias("y")))


def block_place(i) -> Column:
    """struct(x, y, z) of an atom of a block section."""
    i, m = _c(i), F.lit(15)
    return F.struct(i.bitwiseAND(m).alias("x"), F.shiftright(i, 8).bitwiseAND(m).alias("y"), F.shiftright(i, 4).bitwiseAND(m).alias("z"))


def biome_place(i) -> Column:
    """struct(x, y, z) of an atom of a biome section."""
    i, m = _c(i), F.lit(3)
    return F.struct(i.bitwiseAND(m).alias("x"), F.shiftright(i, 4).bitwiseAND(m).alias("y"), F.shiftright(i, 2).bitwiseAND(m).alias("z"))


def region_of_file(path, extension: str) -> Column:
    """struct(rx, rz) of a name r.<rx>.<rz>.<extension>, null for other names."""
    pattern = rf"(?:^|/)r\.(-?\d+)\.(-?\d+)\.{re.escape(extension)}$"
    x, z = (F.try_to_number(F.nullif(F.regexp_extract(_c(path), pattern, g), F.lit("")), F.lit("S9999999999")).cast("int") for g in (1, 2))
    return F.when(x.isNotNull() & z.isNotNull(), F.struct(x.alias("rx"), z.alias("rz")))


def region_path(dimension, rx, rz, extension: str) -> Column:
    """Path under the store: dimension, both sectors, file."""
    parts = [_c(dimension), floor_div32(rx).cast("string"), floor_div32(rz).cast("string"), F.concat(F.lit("r."), _c(rx).cast("string"), F.lit("."), _c(rz).cast("string"), F.lit(f".{extension}"))]
    return F.concat_ws("/", *parts)
