"""What the training-data operators share: tables, checkpoints and bounded memos."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that goes to Python or comes from there: with texts of a few KB, some MB on either side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let batches between Spark and Python hold at most ``BATCH_ROWS`` rows in this session; a smaller setting stays.

    Such batches lie outside the heap and are kept for reuse, so the session's default of ten times that costs an executor
    some hundred MB.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text read as an empty one; other columns, whatever their names, stay behind."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where a local session names none, one of this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
            found = context._jsc.sc().getCheckpointDir()
        named = found.get()
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: lineage ends and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder that is no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Memo(dict):
    """A dictionary that makes its missing values and holds at most two generations of ``cap`` entries.

    Keys longer than ``longest`` are not held, so its bytes are bounded too.
    """

    def __init__(self, make, cap: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.cap, self.longest, self.old = make, cap, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Rows up to which a side may be broadcast; with the rows that callers send, well under 100 MB.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; else as it is, to be joined by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


#: White space that separates words.
BLANKS = "[ \\t-\\r]+"


def words_of(text):
    """The words of a text column; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def bind(value, then):
    """``then`` of a column that is computed once: a lambda over a one-element array binds it."""
    return F.get(F.transform(F.array(value), then), 0)
