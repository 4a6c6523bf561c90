"""Text form of a registry: a header, then both lists of names in order of their ids."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

MAGIC = "ZRDREG1"  # fixed value: first line of the format
LISTS = (("block", "blocks"), ("biome", "biomes"))


class ManifestError(ValueError):
    """The text is not a manifest, is cut short, or is not the one asked for."""


@dataclass(frozen=True)
class Manifest:
    protocol: int
    block: tuple[str, ...]
    biome: tuple[str, ...]

    @property
    def fingerprint(self) -> str:
        parts = [str(self.protocol).encode(), *(b"\0" + n.encode() for n in self.block), b"\xff", *(b"\0" + n.encode() for n in self.biome)]
        return hashlib.sha256(b"".join(parts)).hexdigest()

    def text(self) -> str:
        out = [MAGIC, f"fingerprint {self.fingerprint}", f"protocol {self.protocol}"]
        for kind, title in LISTS:
            names = getattr(self, kind)
            out += [f"{title} {len(names)}", *names]
        return "\n".join(out) + "\n"


def parse(text: str, expected: str | None = None) -> Manifest:
    """Manifest of a text; expected: the fingerprint that it must state."""
    lines = iter(text.split("\n"))
    if next(lines) != MAGIC:
        raise ManifestError("not a registry manifest")
    head: dict[str, str] = {}
    found: dict[str, tuple[str, ...]] = {}
    titles = {title: kind for kind, title in LISTS}
    for line in lines:
        key, space, value = line.partition(" ")
        if key in titles and space:
            if not value.isdigit():
                raise ManifestError(f"malformed line: {line!r}")
            names = tuple(islice(lines, int(value)))
            if len(names) < int(value):
                raise ManifestError(f"cut short in {key}")
            found[titles[key]] = names
            if len(found) == len(titles):
                break
        elif not space:
            raise ManifestError(f"malformed line: {line!r}")
        else:
            head[key] = value
    if "fingerprint" not in head or len(found) < len(titles):
        raise ManifestError("a part is missing")
    if expected is not None and head["fingerprint"] != expected:
        raise ManifestError(f"fingerprint is {head['fingerprint']}, not {expected}")
    return Manifest(int(head.get("protocol", 0)), found["block"], found["biome"])


def table(spark: SparkSession, manifests: list[Manifest]) -> DataFrame:
    """epoch, kind, id, name of some manifests (65,536 names a kind at most)."""
    data = [(m.fingerprint, kind, i, name) for m in manifests for kind, _ in LISTS for i, name in enumerate(getattr(m, kind))]
    return spark.createDataFrame(data, "epoch string, kind string, id int, name string")


def of_table(registry: DataFrame, epoch: str, protocol: int) -> Manifest:
    """Manifest of one epoch of a registry table."""
    rows = registry.filter(registry["epoch"] == epoch).orderBy("kind", "id").collect()
    return Manifest(protocol, *(tuple(r["name"] for r in rows if r["kind"] == kind) for kind, _ in LISTS))
