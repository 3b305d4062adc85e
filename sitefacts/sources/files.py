"""Binary files, stored uploads, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.functions import urls

UPLOAD_BYTES = 8 * 1024 * 1024


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, content, bytes, mime`` of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return found.select("path", name.alias("name"), "content", F.col("length").alias("bytes"), urls.mime_type(name).alias("mime"))


def upload_entries(uploads: DataFrame, salt: str) -> DataFrame:
    """``site_id, id, stored_name, original_name, created_at`` of accepted uploads ``site_id, name, bytes, created_at``."""
    token = F.left(F.sha2(F.concat_ws(":", F.lit(salt), "site_id", "name", F.col("created_at").cast("string")), 256), F.lit(16))
    rows = uploads.where((F.col("bytes") > 0) & (F.col("bytes") <= UPLOAD_BYTES)).withColumn("id", token)
    return rows.select("site_id", "id", F.concat_ws("-", "id", urls.safe_basename(F.col("name"))).alias("stored_name"), F.col("name").alias("original_name"), "created_at")


def write_text(lines: DataFrame, folder: str) -> None:
    """Lines ``site_id, seq, line`` as one text file for each site folder, in order."""
    ordered = lines.repartition("site_id").sortWithinPartitions("site_id", "seq")
    ordered.select("site_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("site_id").text(folder)
