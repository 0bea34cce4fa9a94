"""Tables written to the cluster's shared folder: cut lineage, survive lost executors.

Iterative operators write what the next step reads as Parquet below ``spark.checkpoint.dir``,
the folder all executors share. A lost executor then costs a re-read, never a recomputation
of earlier rounds, and the driver only ever holds file listings. Results are lazy and read these
tables, so they stay until the caller, who knows when a result is consumed, leaves ``scratch_scope``
or calls ``release``; what is left goes at exit.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh local one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="ostraka-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Written tables of one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _live[self.root] = spark

    def cut(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        """Write ``df`` and return the written table, whose plan is a single scan."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(compression="zstd", **options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(keep: frozenset[str] = frozenset()) -> None:
    """Delete all written tables but those of the runs named in ``keep``; results that read them are void."""
    for root in [r for r in _live if r not in keep]:
        spark = _live.pop(root)
        if not spark._jsc.sc().isStopped():
            _delete(spark, root)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables written inside are deleted at the end: consume results before leaving."""
    before = frozenset(_live)
    try:
        yield
    finally:
        release(before)


@atexit.register
def _clean() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001 - the JVM may already be gone at exit
        pass
