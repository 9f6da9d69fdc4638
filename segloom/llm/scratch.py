"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset: a temporary folder for ``local[..]`` masters, which have
    one machine, and the warehouse, which is shared, for every other master."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="segloom-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        return f"file://{_OWN[0]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


class Scratch:
    """Parquet tables of one run of an operator. ``write`` returns the table as read back, so later steps neither
    recompute it nor depend on the executors that made it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.dir = f"{shared_dir(spark)}/segloom/{name}-{uuid.uuid4().hex[:12]}"
        _MADE.append(self.dir)
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.dir}/t{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path  # the frame too, so that no other gets its id
        return out

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        if held := self._paths.pop(id(df), None):
            remove(self.spark, held[1])


def made() -> list[str]:
    """Folders that this process has made and not deleted."""
    return list(_MADE)


def clear(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete folders, or all that this process has made. Results that are not yet read may still need them: call it when they are done."""
    for path in made() if folders is None else folders:
        if path in _MADE:
            _MADE.remove(path)
            remove(spark, path)


def _forget() -> None:
    """At exit, what lies on this machine goes; a shared store is cleared by ``clear`` or its own rules."""
    for path in _MADE:
        if path.startswith(("/", "file:")):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


atexit.register(_forget)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
