"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from findloom.errors import EngineIOError


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else the context's checkpoint folder; on a local master a temporary one that becomes it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise EngineIOError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="findloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/findloom-inputs/{tag}-{uuid.uuid4().hex}"
