"""Cross-site boilerplate removal at line level, by distinct-site spread.

Each line's distinct sites are sketched (HyperLogLog, merged by Spark's partial and final aggregation, so a line held by a
third of all rows shuffles one sketch a task). A line clearly above ``min_sites`` is boilerplate, one clearly below is
not; one within the sketch's error of the threshold gets an exact distinct count. Boilerplate goes from every document
but the first that holds it (smallest doc_id, then position), so no wording is lost from the corpus as a whole.

A line of very many documents is never one join key of one task: lines near the threshold, and boilerplate lines, are few
against all lines and are broadcast where a count proves it; beyond that bound their rows are salted.

Copies of a whole document are not boilerplate: with ``copies_as_one`` rows of equal text count as one document, that of the
smallest id with its site, and keep or lose the same lines.

Short lines meet by chance or custom; a line of ``LONG_WORDS`` words or more does not, so ``remove_boilerplate`` takes it
for boilerplate from ``long_sites`` sites on. ``report`` has one threshold for all lines, that of its SQL.

A line is what stands between line feeds; lines are compared without blanks at their ends, and blank lines are never
boilerplate. Null text has no line and stays null. A null site counts as one site of its own, a null doc_id as smaller
than all others. Repeated rows (equal id and text) stand for one place and keep or lose the same lines. Extra columns stay;
``n_lines`` and ``n_removed`` are replaced if they exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import BROADCAST_ROWS, bind, cut, words_of

MIN_SITES = 10
#: Lines of so many words count as long, and are boilerplate on so many sites.
LONG_WORDS, LONG_SITES = 50, 3
LG_K = 12
#: Ways in which the rows of a line are dealt where its keys are too many to broadcast.
SALTS = 64

_ID, _HASH, _DROP = "__line_doc", "__line_text", "__line_drop"


def _with_keys(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn(_HASH, F.xxhash64("text"))


def site_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """One row for each line with content: its place, its key, its site and whether it is ``long``."""
    keyed = _with_keys(docs).select(_ID, _HASH, F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim(F.col("line"), F.lit(" \t\r"))
    long = F.when(F.length(line) < 2 * LONG_WORDS - 1, False).otherwise(F.size(words_of(line)) >= LONG_WORDS)
    return keyed.where(line != "").select(_ID, _HASH, "site", "pos", F.xxhash64(line).alias("key"), long.alias("long"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, long_sites: int = LONG_SITES) -> DataFrame:
    """``key`` of every line on at least ``min_sites`` sites, for long lines ``long_sites``, with its first place.

    Counts within six standard errors of the sketch are taken again exactly; that a line's sketch is further off happens
    about twice in a thousand million lines.
    """
    error = 6 * 1.04 / 2 ** (lg_k / 2)
    least = F.when(F.col("long"), long_sites).otherwise(min_sites)
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct(_ID, _HASH, "pos")).alias("first"), F.max("long").alias("long"))
    spread = cut(spread.select("key", "first", "long", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= least * (1 - error) - 1))
    near = spread.where(F.col("sites") <= least * (1 + error) + 1).select("key")
    exact = with_few(lines, near).groupBy("key", "site").count().groupBy("key").agg(F.count("*").alias("exact"))
    return spread.join(exact, "key", "left").where(F.coalesce("exact", "sites") >= least).select("key", "first")


def with_few(lines: DataFrame, few: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``lines`` joined with the rows that ``few`` has of their keys, at most one each; no key is left to one task."""
    few = cut(few)
    if few.count() <= most:
        return lines.join(F.broadcast(few), "key")
    salted = lines.withColumn("__line_salt", F.pmod(F.xxhash64(_ID, "pos"), F.lit(SALTS)))
    return salted.join(few.withColumn("__line_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["key", "__line_salt"]).drop("__line_salt")


def one_of_copies(lines: DataFrame) -> DataFrame:
    """``lines`` of one row for each text: the row of the smallest id, and of its places of a line the first."""
    first = lines.groupBy("key", _HASH).agg(F.min(F.struct(_ID, "site", "pos")).alias("x"), F.max("long").alias("long"))
    return first.select("key", _HASH, "x.*", "long")


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, long_sites: int = LONG_SITES, copies_as_one: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines`` (lines with content) and ``n_removed``."""
    lines = cut(site_lines(docs, site))
    found = boilerplate(one_of_copies(lines) if copies_as_one else lines, min_sites, lg_k, long_sites)
    place = [_HASH, "pos"] if copies_as_one else [_ID, _HASH, "pos"]
    drops = with_few(lines, found).where(F.struct(*place) != F.struct(*(F.col(f"first.{c}") for c in place)))
    drops = drops.groupBy(_ID, _HASH).agg(F.collect_set("pos").alias(_DROP))
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(_DROP))
    cleaned = bind(parts, lambda p: F.array_join(F.transform(kept, lambda i: F.get(p, i)), "\n"))
    text = F.when(F.col(_DROP).isNull(), F.col("text")).otherwise(cleaned)
    filled = F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(" \t\r")) != ""))
    return (
        _with_keys(docs)
        .join(drops, [_ID, _HASH], "left")
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(filled).cast("long"))
        .withColumn("n_removed", F.when(F.col(_DROP).isNull(), 0).otherwise(F.size(_DROP)).cast("long"))
        .withColumn("text", text)
        .select(*docs.columns, *(c for c in ("n_lines", "n_removed") if c not in docs.columns))
    )


def report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_chars, text_md5`` of the cleaned texts; one threshold for lines of any length."""
    return remove_boilerplate(docs, site, min_sites, long_sites=min_sites).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("text_md5"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
     l AS (SELECT doc_id, coalesce(source, '') AS site, parts, unnest(range(1, len(parts) + 1)) AS pos FROM d),
     k AS (SELECT doc_id, site, pos, parts[pos] AS line, trim(parts[pos], ' ' || chr(9) || chr(13)) AS key FROM l),
     b AS (SELECT key, min(struct_pack(d := doc_id, p := pos)) AS place FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {MIN_SITES}),
     m AS (SELECT k.*, b.key IS NOT NULL AND (b.place.d <> k.doc_id OR b.place.p <> k.pos) AS gone FROM k LEFT JOIN b USING (key)),
     t AS (SELECT doc_id, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
                  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS kept_chars, md5(text) AS text_md5 FROM t
"""
