"""Names, hashes and ages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sha256_hex(content) -> Column:
    return F.sha2(_c(content).cast("binary"), 256)


def strip_namespace(name) -> Column:
    """What follows the first colon, if there is one."""
    return F.regexp_replace(_c(name), r"^[^:]*:", "")


def contains_ignoring_case(text, part) -> Column:
    return F.contains(F.lower(_c(text)), F.lower(_c(part)))


def canonical_state(name, properties) -> Column:
    """name[k=v,...] with the properties (a map of strings) in order of their keys; the name alone without any."""
    pairs = F.array_sort(F.transform(F.map_entries(_c(properties)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    some = F.coalesce(F.size(_c(properties)), F.lit(0)) > 0
    return F.when(some, F.concat(_c(name), F.lit("["), F.array_join(pairs, ","), F.lit("]"))).otherwise(_c(name))


def fully_generated(status) -> Column:
    return strip_namespace(status) == "full"


def human_age(seconds) -> Column:
    s = _c(seconds).cast("long")
    days, hours, minutes = (s / 86400).cast("long"), (s % 86400 / 3600).cast("long"), (s % 3600 / 60).cast("long")

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    return (
        F.when(s < 0, "in the future")
        .when(days > 0, text(days, "d ", hours, "h ago"))
        .when(hours > 0, text(hours, "h ", minutes, "m ago"))
        .when(minutes > 0, text(minutes, "m ago"))
        .otherwise(text(s, "s ago"))
    )


def age_range(min_days: int, max_days: int) -> str:
    low, high = min_days > 0, max_days > 0
    if low and high:
        return f"between {min_days} and {max_days} days old"
    return f"{min_days}+ days old" if low else f"up to {max_days} days old" if high else "of any age"


def registry_fingerprint(registry: DataFrame, protocol: int) -> DataFrame:
    """epoch, fingerprint of registry(epoch, kind, id, name): SHA-256 over the protocol and the names in order of id."""

    def names(kind: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", "name"))))
        return F.coalesce(F.array_join(F.transform(listed, lambda x: F.hex(F.concat(F.unhex(F.lit("00")), F.encode(x["name"], "utf-8")))), ""), F.lit(""))

    head = F.hex(F.encode(F.lit(str(protocol)), "utf-8"))
    return registry.groupBy("epoch").agg(F.lower(F.sha2(F.unhex(F.concat(head, names("block"), F.lit("FF"), names("biome"))), 256)).alias("fingerprint"))
