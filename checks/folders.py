"""A scratch folder for local runs that have none, in this one place."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from loanloom.session import shared_folder, use_folder


def ensure_folder(spark: SparkSession) -> None:
    """Local sessions without `spark.checkpoint.dir` get a temporary folder; a cluster must name one."""
    try:
        shared_folder(spark)
    except RuntimeError:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise
        use_folder(spark, tempfile.mkdtemp(prefix="loanloom-"))
