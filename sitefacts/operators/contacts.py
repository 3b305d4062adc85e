"""Phones, emails and addresses of texts, ``site, page_seq, text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.functions import checks, vocab
from sitefacts.functions.rx import all_of, has, squeeze, swap, trim
from sitefacts.operators.pages import first_by_key


def _found(texts: DataFrame, pattern: str, group: int) -> DataFrame:
    return texts.select("site", "page_seq", F.posexplode(all_of(F.col("text"), pattern, group)).alias("pos", "value"))


def _labelled(rows: DataFrame, what: str) -> DataFrame:
    label = F.when(F.col("n") == 1, f"Primary {what}").otherwise(F.concat(F.lit(f"Additional {what} "), F.col("n").cast("string")))
    return rows.select("site", "n", label.alias("label"), "value")


def phones(texts: DataFrame) -> DataFrame:
    """``site, n, label, value``: plausible phones, one for each run of digits, first seen first."""
    rows = _found(texts, vocab.PHONE, 0).withColumn("value", trim(F.col("value"))).where(checks.phone(F.col("value")))
    rows = rows.withColumn("key", checks.digits(F.col("value")))
    return _labelled(first_by_key(rows, ["site"], "key", ["page_seq", "pos"], vocab.MAX_CONTACTS), "phone")


def primary_phone(texts: DataFrame) -> DataFrame:
    """``site, phone, confidence`` of sites with a phone."""
    return phones(texts).where("n = 1").select("site", F.col("value").alias("phone"), F.when(F.col("value").rlike(r"[().\-\s]"), 0.82).otherwise(0.72).alias("confidence"))


def emails(texts: DataFrame) -> DataFrame:
    """``site, page_seq, pos, email, rejected``: every address, and whether it is a placeholder or a file name."""
    rows = _found(texts, vocab.EMAIL, 0).withColumn("email", swap(trim(F.col("value")), "[),.;:]+$", ""))
    return rows.select("site", "page_seq", "pos", "email", checks.bad_email(F.col("email")).alias("rejected"))


def best_email(texts: DataFrame) -> DataFrame:
    """``site, email, confidence``: the first role mailbox, else the first address."""
    rows = emails(texts).where(~F.col("rejected")).withColumn("other", ~has(F.col("email"), vocab.ROLE_MAILBOX))
    best = rows.groupBy("site").agg(F.min_by(F.struct("email", "other"), F.struct("other", "page_seq", "pos")).alias("x"))
    return best.select("site", "x.email", F.when(F.col("x.other"), 0.72).otherwise(0.86).alias("confidence"))


def addresses(texts: DataFrame) -> DataFrame:
    """``site, n, label, value``: plausible street addresses, first seen first."""
    rows = _found(texts, vocab.ADDRESS, 1).withColumn("value", trim(swap(squeeze(F.col("value")), r"\s+,", ","))).where(checks.address(F.col("value")))
    rows = rows.withColumn("key", F.lower("value"))
    return _labelled(first_by_key(rows, ["site"], "key", ["page_seq", "pos"], vocab.MAX_CONTACTS), "address")
