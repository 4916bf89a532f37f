"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CHOSEN: dict[str, str] = {}


def local_session(app_name: str = "loanloom", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and the benchmark. On a cluster, settings come from spark-submit instead."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        # Recording the Python call site of every column costs more than building the plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, else the one given to `use_folder`."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _CHOSEN.get(spark.sparkContext.applicationId)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    return folder.rstrip("/")


def use_folder(spark: SparkSession, folder: str) -> None:
    """The shared folder of a session that was started without `spark.checkpoint.dir`."""
    _CHOSEN[spark.sparkContext.applicationId] = folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back, so later passes survive lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, "materialised")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
