"""The folder that driver and executors share, and tables cut loose from their lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where a local session names none, one of this machine."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named, master = spark.conf.get("spark.checkpoint.dir", ""), spark.sparkContext.master
        if not named and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: worked out once, and safe from lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
