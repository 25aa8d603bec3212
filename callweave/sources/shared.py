"""A folder that the driver and all executors see, for tables between two steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place in this application's part of the folder named in spark.checkpoint.dir.

    Where the setting is absent a folder of this machine serves in local mode, and goes with
    the process; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"{tempfile.gettempdir()}/checkpoints/callweave-{uuid.uuid4().hex}"
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"{at.rstrip('/')}/callweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
