"""A folder that the driver and all executors can write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below spark.checkpoint.dir; a local session may have none, then below a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="graphprep-"))
        top = _LOCAL[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
