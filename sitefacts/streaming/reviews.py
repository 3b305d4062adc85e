"""Reviews as streams: the first submission of each site completes it.

What a site's first submission was is keyed state: one value a site, kept by the state store with the stream's progress, so a
batch reads no earlier result. Of submissions that arrive together the one first in ``order`` counts, nulls last; later
arrivals are passed over, whatever their time. Submissions without a site complete none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _First(StatefulProcessor):
    """Hands on a site's first row once, and remembers that it did, for ``keep_ms`` or for ever."""

    def __init__(self, order: tuple[str, ...], keep_ms: int | None):
        self.order, self.keep_ms = list(order), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "completed boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.done.exists():
            return
        first = None
        for part in rows:  # a site's rows come in batches; one row is held
            part = part if first is None else pd.concat([first, part])
            first = part.sort_values(self.order, kind="stable", na_position="last").head(1)
        self.done.update((True,))
        yield first

    def close(self) -> None:
        pass


def submissions(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of submissions from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_of_each(stream: DataFrame, order: tuple[str, ...] = ("submitted_at",), by: str = "site_id", keep_ms: int | None = None) -> DataFrame:
    """Rows of ``stream`` that are the first of their ``by``, each given out once; state goes ``keep_ms`` after it was written.

    The session keeps state in RocksDB from here on, which this operator needs.
    """
    spark = stream.sparkSession
    if spark.conf.get(_PROVIDER) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    rows = stream.where(F.col(by).isNotNull()).groupBy(by)
    return rows.transformWithStateInPandas(_First(order, keep_ms), stream.schema, "append", "None" if keep_ms is None else "ProcessingTime")


def completed(stream: DataFrame, table_path: str, checkpoint: str, order: tuple[str, ...] = ("submitted_at",), every: str | None = None, keep_ms: int | None = None) -> StreamingQuery:
    """Appends each site's first submission to ``table_path``; later ones of the same site are passed over.

    A batch that runs again after a failure replaces what it wrote before: its rows lie in a part of its number. State that
    expires needs a steady trigger, ``every``, since such a stream never runs out of work.
    """
    if keep_ms is not None and not every:
        raise ValueError("state expires in streams with a steady trigger only")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table_path)

    writer = first_of_each(stream, order, keep_ms=keep_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def status(sites: DataFrame, done: DataFrame) -> DataFrame:
    """Sites with ``status`` and whether the final record is served, after the submissions so far."""
    final = done.groupBy("site_id").agg(F.lit(True).alias("done"))
    return sites.join(final, "site_id", "left").withColumn("status", F.when(F.col("done"), "completed").otherwise(F.col("status"))).withColumn("serves_final", F.coalesce("done", F.lit(False))).drop("done")


def refreshes(spark: SparkSession, table_path: str, schema: str) -> DataFrame:
    """A stream of what ``completed`` adds to its table, by the offsets of its files: what a view has not shown yet."""
    return spark.readStream.schema(f"{schema}, batch int").parquet(table_path)


def watch(stream: DataFrame, on_batch: Callable[[DataFrame], None], checkpoint: str, every: str | None = "4 seconds") -> StreamingQuery:
    """A view that is brought up to date at a steady interval, or once with all there is; a restart goes on behind what was shown."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: on_batch(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
