"""A new folder that driver and executors share, for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A folder of its own in spark.checkpoint.dir; a local master may do without that setting and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lectio-shared-')}"
    return f"{root.rstrip('/')}/lectio-files/{uuid.uuid4().hex}"
