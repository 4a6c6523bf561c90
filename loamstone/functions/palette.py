"""Dictionary encoding and bit packing of fixed-width integer arrays.

Sizes and conditions are column expressions; packing and unpacking are Arrow-batched numpy functions, because a lambda
that looks up a palette per element would rebuild the palette for each of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_INDIRECT = 256


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bits_per_entry(n) -> Column:
    n = _c(n)
    return F.when(n <= 16, 4).when(n <= 256, 8).otherwise(16)


def values_per_long(bits) -> Column:
    return F.floor(F.lit(64) / _c(bits)).cast("int")


def packed_length(n, bits) -> Column:
    return F.ceil(_c(n) / values_per_long(bits)).cast("int")


def bits_on_disc(n, blocks: bool) -> Column:
    """Bits that n values need, 0 for one; 4 at least for blocks."""
    n = _c(n)
    bits = F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long"))))
    return F.greatest(F.lit(4), bits) if blocks else bits


def palette(atoms) -> Column:
    """Distinct atoms in ascending order."""
    return F.array_sort(F.array_distinct(_c(atoms)))


def palette_as_met(atoms) -> Column:
    """Distinct atoms in the order in which they first occur."""
    a = _c(atoms)
    firsts = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.array_position(a, p["x"]) == p["i"] + 1)
    return F.transform(firsts, lambda p: p["x"])


def is_single(atoms) -> Column:
    return F.size(F.array_distinct(_c(atoms))) == 1


def is_full(atoms) -> Column:
    """Whether no element is null, the mark of an unchanged position."""
    return ~F.exists(_c(atoms), lambda x: x.isNull())


def _bits(n: int) -> int:
    return 4 if n <= 16 else 8 if n <= 256 else 16


def pack_indices(values: np.ndarray, bits: int) -> np.ndarray:
    """Cells of 64 bits, lowest bits first, no value across cells."""
    per = 64 // bits
    padded = np.zeros(-(-len(values) // per) * per, np.uint64)
    padded[: len(values)] = values
    return np.bitwise_or.reduce(padded.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=1).view(np.int64)


def unpack_indices(cells: np.ndarray, bits: int, n: int) -> np.ndarray:
    per = 64 // bits
    if len(cells) * per < n:
        raise ValueError(f"{len(cells)} cells of {per} values hold less than {n}")
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(bits)
    return ((cells.view(np.uint64)[:, None] >> shifts) & np.uint64((1 << bits) - 1)).ravel()[:n].astype(np.int64)


def _packed(atoms: pd.Series) -> pd.DataFrame:
    out = []
    for a in atoms:
        if a is None:
            out.append((None, None, None, None))
            continue
        a = np.asarray(a, np.int64)
        if len(a) and (a.min() < 0 or a.max() > 0xFFFF):
            raise ValueError("atoms are 0..65535")
        values, index = np.unique(a, return_inverse=True)
        if len(values) == 1:
            out.append((int(values[0]), None, None, None))
        elif len(values) <= MAX_INDIRECT:
            bits = _bits(len(values))
            out.append((None, pack_indices(index, bits), values.astype(np.int32), bits))
        else:
            out.append((None, pack_indices(a, 16), np.zeros(0, np.int32), 16))
    return pd.DataFrame(out, columns=["single", "cells", "palette", "bits"]).astype({"single": "Int32", "bits": "Int32"})


def packed(atoms) -> Column:
    """Palette form of arrays of 0..65535: one value alone, a palette of up to 256 in ascending order, or 16-bit values."""

    def run(atoms: pd.Series) -> pd.DataFrame:
        return _packed(atoms)

    return F.pandas_udf(run, "struct<single int, cells array<bigint>, palette array<int>, bits int>")(_c(atoms))


def unpacked(data, width: int) -> Column:
    """Atoms of a packed struct."""

    @F.pandas_udf("array<int>")
    def run(data: pd.DataFrame) -> pd.Series:
        out = []
        for single, cells, entries, bits in zip(data["single"], data["cells"], data["palette"], data["bits"], strict=True):
            if not pd.isna(single):
                out.append(np.full(width, int(single), np.int32))
            elif cells is None:
                out.append(None)
            else:
                index = unpack_indices(np.asarray(cells, np.int64), int(bits), width)
                if len(entries) and index.max() >= len(entries):
                    raise ValueError("an index is beyond the palette")
                out.append((np.asarray(entries)[index] if len(entries) else index).astype(np.int32))
        return pd.Series(out)

    return run(_c(data))


def section_digest(names, index) -> Column:
    """SHA-1 over each position's rank among the section's sorted names, whatever the order of its palette."""

    def run(names: pd.Series, index: pd.Series) -> pd.Series:
        out = []
        for n, i in zip(names, index, strict=True):
            order = {s: r for r, s in enumerate(sorted(n))}
            out.append(hashlib.sha1(np.array([order[s] for s in n], "<u2")[np.asarray(i)].tobytes()).hexdigest())
        return pd.Series(out)

    return F.pandas_udf(run, "string")(_c(names), _c(index))


def palette_table(packed_rows: DataFrame, column: str = "data") -> DataFrame:
    """palette_id, palette, bits: each distinct palette once, numbered in order of its content.

    Numbers are offsets of the first entry, offsets of the second among those, and places behind both. The only order over
    all is that of the first entries, which are 16 bits wide.
    """
    from pyspark.sql import Window

    distinct = packed_rows.filter(F.size(f"{column}.palette") > 0).select(f"{column}.palette", f"{column}.bits").distinct()
    keyed = distinct.withColumn("_a", F.col("palette")[0]).withColumn("_b", F.coalesce(F.get("palette", F.lit(1)), F.lit(-1)))  # [5] stands before [5, 0]
    pairs = keyed.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.unboundedPreceding, -1)
    firsts = pairs.groupBy("_a").agg(F.sum("_n").alias("_n")).select("_a", F.coalesce(F.sum("_n").over(Window.orderBy("_a").rowsBetween(*before)), F.lit(0)).alias("_start"))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_a").orderBy("_b").rowsBetween(*before)), F.lit(0))
    offsets = pairs.withColumn("_inner", inner).join(F.broadcast(firsts), "_a").select("_a", "_b", (F.col("_start") + F.col("_inner")).alias("_offset"))  # 65,536 rows at most
    place = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("palette", "bits"))
    return keyed.join(offsets, ["_a", "_b"]).select((F.col("_offset") + place).cast("int").alias("palette_id"), "palette", "bits")


def concat_sections(df: DataFrame, keys: list[str], section: str = "section", atoms: str = "atoms") -> DataFrame:
    """All sections of a key as one array, in order of the section."""
    ordered = F.array_sort(F.collect_list(F.struct(section, atoms)))
    return df.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda s: s[atoms])).alias(atoms))
