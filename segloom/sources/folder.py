"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a temporary one for local masters, the warehouse for others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            if not _OWN:
                _OWN.append(tempfile.TemporaryDirectory(prefix="segloom-io-"))
            base = f"file://{_OWN[0].name}"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/segloom/{name}-{uuid.uuid4().hex[:12]}"
