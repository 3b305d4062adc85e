"""Which fields of a record are missing or uncertain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.functions import vocab
from sitefacts.functions.rx import blank

NO_KEYWORD = "No positive keyword match for this amenity"


def text_gap(value, confidence):
    return F.when(blank(value), "missing").when(confidence < 0.45, "partial").when(confidence < 0.65, "uncertain").otherwise("complete")


def amenity_gap(present, confidence):
    sure = F.coalesce(confidence, F.lit(0.0))
    return F.when(present, F.when(sure >= 0.5, "complete").otherwise("uncertain")).when(sure >= 0.55, "complete").when(sure > 0.2, "uncertain").otherwise("missing")


def list_gap(n, confidence):
    return F.when(n > 0, F.when(confidence < 0.5, "partial").otherwise("complete")).when((confidence > 0.25) & (confidence < 0.55), "uncertain").otherwise("missing")


def dining_gap(venues):
    named = lambda v: ~blank(v["restaurant_name"])
    told = F.exists(venues, lambda v: named(v) & (~blank(v["hours"]) | (F.size(v["menu_items"]) > 0)))
    return F.when(told, "complete").when(F.exists(venues, named), "partial").otherwise("missing")


def fields(records: DataFrame) -> DataFrame:
    """``site_id, path_no, path, kind, text, present, n, dining``: the fixed paths of every record, in order."""
    d = F.col("data")

    def entry(path):
        top, _, leaf = path.partition(".")
        value = d[top][leaf] if leaf else d[top]
        kind = "amenity" if top == "amenities" else "dining" if top == "dining" else "list" if path in ("services", "room_types", "images") else "text"
        return F.struct(
            F.lit(path).alias("path"), F.lit(kind).alias("kind"),
            (value if kind == "text" else F.lit(None).cast("string")).alias("text"),
            (value if kind == "amenity" else F.lit(None).cast("boolean")).alias("present"),
            (F.size(value) if kind in ("list", "dining") else F.lit(None).cast("int")).alias("n"),
            (dining_gap(value) if kind == "dining" else F.lit(None).cast("string")).alias("dining"),
        )

    return records.select("site_id", F.posexplode(F.array(*map(entry, vocab.PATHS))).alias("path_no", "x")).select("site_id", "path_no", "x.*")


def report(records: DataFrame, confidences: DataFrame) -> DataFrame:
    """``site_id, path_no, path, status, note`` of every path of every record."""
    rows = fields(records).join(confidences, ["site_id", "path"], "left")
    sure = F.col("confidence")
    status = (
        F.when(F.col("kind") == "amenity", amenity_gap(F.col("present"), sure)).when(F.col("kind") == "list", list_gap(F.col("n"), sure))
        .when(F.col("kind") == "dining", F.col("dining")).otherwise(text_gap(F.col("text"), sure))
    )
    note = F.when((F.col("kind") == "amenity") & ~F.col("present") & (sure >= 0.55), NO_KEYWORD)
    return rows.select("site_id", "path_no", "path", status.alias("status"), note.alias("note"))


def summary(gaps: DataFrame) -> DataFrame:
    """``site_id, n_open, open_paths`` and a count of each status."""
    open_ = F.filter(F.array_sort(F.collect_list(F.struct("path_no", "path", "status"))), lambda x: x["status"] != "complete")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("complete", "partial", "uncertain", "missing")]
    return gaps.groupBy("site_id").agg(F.count_if(F.col("status") != "complete").alias("n_open"), F.array_join(F.transform(open_, lambda x: x["path"]), ",").alias("open_paths"), *counts)


def note(status, text):
    """A gap as a remark: status and note."""
    return F.concat_ws(" · ", status, F.nullif(text, F.lit("")))
