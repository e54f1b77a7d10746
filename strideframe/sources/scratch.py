"""Folders for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; a local master without such a setting gets a temporary one, a cluster an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
