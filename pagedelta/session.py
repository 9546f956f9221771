"""Session settings that the package relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "pagedelta", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; partition counts are the cluster's business."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or, in local mode alone, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
