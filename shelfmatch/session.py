"""Session construction and lineage control."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "shelfmatch", cpus: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster passes its own session."""
    parallel = os.cpu_count() if str(cpus) == "*" else int(cpus)
    settings = {
        "spark.sql.shuffle.partitions": str(parallel),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        # Call sites are captured for every expression otherwise; plans here have thousands.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local master, whose executors share the driver's disk, gets a temporary
    folder; a cluster gets an error, since a folder of one machine would lose the data.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a result that several later branches read, so that it is computed once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
