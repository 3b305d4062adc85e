"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

Toxic documents go, boilerplate lines go from the texts, one document of each near-duplicate group stays, sources are
mixed to their targets, and what is left is encoded. All stages but the last return the columns of ``documents``;
``n_chars`` follows the text. A stage's table is removed once the next one's is written.

Null and empty texts pass every stage as they are, but for the mixing draw; a null text keeps a null ``n_chars``. A document
whose every line is boilerplate that stands elsewhere says nothing of its own and goes; copies of a whole document are left
whole by the line stage, so that the next one finds them. Of repeated
rows with words one stays. Extra columns of ``documents`` stay to the last stage, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.llm import line_dedup, mixing, ngram_join, sentencepiece_codec, toxicity
from sitefacts.llm.common import drop_folder, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(docs, copies_as_one=True)
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    return cleaned.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Subword encoding and learned scores have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            drop_folder(spark, f"{place}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
