"""URL filtering: host and path rules first, a logistic regression on character n-grams for the rest.

A rule names a host, with all its subdomains, and a path beginning; the longest rule that fits decides. Urls without a
rule are judged by logistic regression on hashed 3- to 5-grams of the characters of host and path. It learns from a small
labelled table of urls (``url, verdict``); where none is given, the urls that rules decide serve as one. At most
``MOST_LABELLED`` distinct urls are learned from, half of each verdict, in hash order.

Null urls and urls without ``://`` have empty host and path; the model judges them as such. With labels of one verdict
only, the model gives that verdict; with none, it allows; labels that are null or say anything else are left out, and of
labels that differ for one url both count. Repeated rows are judged alike; extra columns, whatever their names, stay behind.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import Memo

#: (verdict, host, path beginning), the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MOST_LABELLED = 20_000
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def with_parts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", *parts(F.col("url")))


def parts(url) -> list:
    """Columns ``host`` and ``path`` of a url column."""
    url = F.coalesce(url, F.lit(""))
    return [F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path")]


def with_rule(parts: DataFrame, rules=RULES) -> DataFrame:
    """Appends ``rule`` and ``ruled``, both null where no rule fits; equal rules decide in the order given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return parts.withColumn("rule", rule).withColumn("ruled", verdict)


def grams(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of a url, each bucket once."""
    text = f"^{host}|{path}$"
    return np.unique(np.array([zlib.crc32(text[i : i + n].encode("utf-8", "replace"), n) % BUCKETS for n in GRAMS for i in range(len(text) - n + 1)], "int64"))


def labelled(ruled: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``host, path, ruled``: at most ``most`` distinct urls that rules decide."""
    known = ruled.where(F.col("ruled").isNotNull()).select("host", "path", "ruled").distinct()
    key = F.xxhash64("host", "path")
    half = [known.where(F.col("ruled") == say).orderBy(key, "host", "path").limit(most // 2) for say in ("allow", "block")]
    return half[0].unionByName(half[1])


def fit(rows: list, epochs: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept for labelled rows (verdict ``block`` counts as 1), by AdaGrad on the full batch."""
    weights, shift = np.zeros(BUCKETS), 0.0
    y = np.array([r["ruled"] == "block" for r in rows], float)
    if not len(y) or y.min() == y.max():
        return weights, -1.0 if not len(y) or y[0] == 0 else 1.0
    found = [grams(r["host"], r["path"]) for r in rows]
    sizes = np.array([len(f) for f in found])
    owner, bucket = np.repeat(np.arange(len(y)), sizes), np.concatenate(found)
    value = 1 / np.sqrt(sizes)[owner]
    seen, seen_shift = np.full(BUCKETS, 1e-8), 1e-8
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[bucket] * value, len(y)) + shift, -30, 30)))
        error = (p - y) * balance
        gradient = np.bincount(bucket, error[owner] * value, BUCKETS) + ridge * weights
        seen += gradient**2
        weights -= rate * gradient / np.sqrt(seen)
        seen_shift += error.sum() ** 2
        shift -= rate * error.sum() / np.sqrt(seen_shift)
    return weights, shift


def judge(pages: DataFrame, rules=RULES, most: int = MOST_LABELLED, labels: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``score`` (the model's, for urls without a rule), one row a page."""
    ruled = with_rule(with_parts(pages), rules)
    known = ruled if labels is None else labels.select(*parts(F.col("url")), F.col("verdict").alias("ruled"))
    weights, shift = fit(labelled(known, most).collect())  # at most ``most`` short rows

    def run(batches):
        def score(url):
            host, slash, path = url.partition("/")  # a host has none, and a path begins with one
            found = grams(host, slash + path)
            return float(1 / (1 + np.exp(-np.clip(weights[found].sum() / np.sqrt(max(1, len(found))) + shift, -30, 30))))

        memo = Memo(score, 50_000)
        for batch in batches:
            hosts, paths, known = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path", "ruled"))
            scores = [None if k is not None else memo[h + p] for h, p, k in zip(hosts, paths, known)]
            verdicts = [k if k is not None else "block" if s >= 0.5 else "allow" for k, s in zip(known, scores)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return ruled.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
