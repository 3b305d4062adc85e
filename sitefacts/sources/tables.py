"""Parquet table access."""

from pyspark.sql import DataFrame, SparkSession

LEAST_ROWS, MOST_ROWS, TASKS_A_CORE = 500, 10_000, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; the path may be any that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a scan dealt out evenly for work that costs much a row.

    A scan has no more tasks than its files have row groups, and a small file has one, however many rows it holds. A task gets
    at most ``MOST_ROWS`` rows, so tasks grow in number and not in length; there are a few for each core if the rows suffice.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    pieces = max(-(-n // MOST_ROWS), min(TASKS_A_CORE * cores, -(-n // LEAST_ROWS)), 1)
    return rows.repartition(pieces)
