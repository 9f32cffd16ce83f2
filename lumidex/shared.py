"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session without one gets a temporary one if all of it runs in one process, as in
    tests. On a cluster it is refused: a folder of the driver's own machine would lose
    what executors on other machines write.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumidex-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")
