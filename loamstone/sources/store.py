"""A versioned store on a shared file system: Parquet tables under generations, switched by one small pointer file.

A write puts all tables of a new generation in place and then renames the pointer, so readers see all of it or none.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["chains", "tiles", "states", "entries", "blobs", "registry"]
POINTER = "current.json"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{POINTER}"))

    def generation(self) -> dict[str, dict[str, str]]:
        """Table name -> part -> folder of the current generation. Tables without sectors have a part for each addition."""
        if not self.exists():
            return {}
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.root}/{POINTER}").first()[0])

    def tables(self) -> list[str]:
        return sorted(self.generation())

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame | None:
        """A table, or only some of its parts (a pruned read: other folders are not listed)."""
        folders = self.generation().get(name, {})
        wanted = [f"{self.root}/{f}" for p, f in sorted(folders.items()) if parts is None or p in parts]
        return self.spark.read.parquet(*wanted) if wanted else None

    def commit(self, changed: dict[str, DataFrame], level: int = 4, part: str | None = None, added: tuple[str, ...] = ()) -> None:
        """Writes the changed tables and switches to them at once. To the tables named in `added` the rows are added.

        With `part`, a column, tables that have it are written in parts: only the parts in `changed` are replaced, the others
        stay. A change therefore rewrites the sectors that it touches and no more.
        """
        current = self.generation()
        for name, df in changed.items():
            if name not in TABLES:
                raise ValueError(f"unknown table {name!r}; one of {', '.join(TABLES)}")
            folder = f"{name}-{uuid.uuid4().hex[:12]}"
            writer = df.withColumn("_part", F.col(part)) if part in df.columns else df
            writer = writer.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
            if part in df.columns:
                writer.partitionBy("_part").parquet(f"{self.root}/{folder}")
                written = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if x.isDirectory()]
                current[name] = current.get(name, {}) | {unquote(w.removeprefix("_part=")): f"{folder}/{w}" for w in written}
            else:
                writer.parquet(f"{self.root}/{folder}")
                current[name] = (current.get(name, {}) if name in added else {}) | {folder: folder}
        draft = self._path(f"{self.root}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(current, sort_keys=True).encode()))
        out.close()
        target = self._path(f"{self.root}/{POINTER}")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, target, options)

    def usage(self) -> dict[str, int]:
        """files and bytes of the current generation."""
        found = {"files": 0, "bytes": 0}
        for parts in self.generation().values():
            for folder in parts.values():
                summary = self._fs.getContentSummary(self._path(f"{self.root}/{folder}"))
                found["files"] += summary.getFileCount()
                found["bytes"] += summary.getLength()
        return found

    def broken(self) -> list[tuple[str, str]]:
        """(folder, problem) of parts of the current generation that are missing or cannot be read."""
        out = []
        for name, parts in sorted(self.generation().items()):
            for folder in sorted(parts.values()):
                if not self._fs.exists(self._path(f"{self.root}/{folder}")):
                    out.append((folder, f"missing part of {name}"))
                    continue
                try:
                    self.spark.read.parquet(f"{self.root}/{folder}").limit(1).count()
                except Exception as e:  # whatever Spark says of a damaged file is the finding
                    out.append((folder, f"unreadable part of {name}: {str(e).splitlines()[0][:200]}"))
        return out

    def sweep(self) -> int:
        """Deletes folders of older generations (no reader may use them any more)."""
        kept, n = {f.split("/")[0] for parts in self.generation().values() for f in parts.values()}, 0
        for status in self._fs.listStatus(self._path(self.root)):
            if status.isDirectory() and status.getPath().getName() not in kept:
                self._fs.delete(status.getPath(), True)
                n += 1
        return n
