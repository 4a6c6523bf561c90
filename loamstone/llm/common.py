"""What the corpus operators share: stored intermediate tables, size-checked joins, words and hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of every word operator here.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none, a folder of this machine if Spark runs on it alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.loamstone.scratch", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loamstone-")
        spark.conf.set("spark.loamstone.scratch", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder. They cut lineage and survive lost executors.

    `keep` writes and rereads a table; `drop` deletes tables that no later step reads. What a result that is not read yet
    still needs goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables = 0
        if spark.conf.get(ARROW_BYTES, None) == ARROW_DEFAULT:  # a session's own figure stays
            spark.conf.set(ARROW_BYTES, "8m")  # bounds the texts that are on their way between JVM and Python

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.tables += 1
        path = f"{self.root}/{self.tables:02d}-{label}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # this write's shuffle files go when it is done
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        if self.tables == 1:
            root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loamstone_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._loamstone_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], how: str, max_rows: int = 20_000) -> DataFrame:
    """Join that broadcasts `small` only after counting it; beyond `max_rows` Spark shuffles (and splits skew)."""
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def exploding_columns(df: DataFrame, own: list[str]) -> list[str]:
    """Columns of `df` that are neither in `own` nor equal to one of them but for case."""
    taken = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in taken]


def trim() -> None:
    """Gives memory that a task has freed back to the system; a Python worker serves many tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it keeps


def rows(fn: Callable, schema: str, step: int = 2048):
    """mapInArrow function from one that takes columns of at most `step` rows and returns columns."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                out = fn(**dict(zip(batch.schema.names, batch.columns, strict=True)))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
        trim()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
