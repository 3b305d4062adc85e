"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Each dimension's values have target shares of a token budget; a
value that has fewer tokens than its share gives all it has, and the others share the rest in proportion. The cells' token
weights are raked to the targets of each dimension in turn, no cell above the tokens it has, until the largest difference
between a marginal and its target is below ``TOLERANCE`` of the budget or ``ROUNDS`` rounds are over (targets may exclude
each other); ``marginals`` reports what is left. Each document of a cell is kept with the cell's calibrated probability,
fitted weight over present tokens. The draw is a hash of seed and doc_id, so a rerun keeps the same documents.

Only the table of cells is raked: its size is sources x languages x topics, whatever the rows. Cell totals come from partial
aggregation, a table of up to ``ONE_TASK`` cells is raked in one task and a larger one by shuffles, and cells go back to
documents by a broadcast of checked size or else a shuffle join.

Targets default to shares raised to a power below 1 (temperature), which lifts small sources. A value without tokens, or
whose target is 0, ends at 0. Topics are those of the column ``topic`` if there is one, else derived by rules. Null source,
language or topic is a value of its own, ''; null text has no token and derived topic 'blank'; documents of cells without
tokens are kept at the budget's share. Repeated rows draw alike. Extra columns stay; ``n_tokens``, ``probability`` and
``kept`` are replaced if they exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import cut, small, words_of

#: Rounds at most, rounds between two looks at the error, and the error that ends them.
ROUNDS, LOOK, TOLERANCE = 30, 5, 1e-6
#: Cells that one task rakes.
ONE_TASK = 200_000
BUDGET = 0.6
SEED = "mix-1"
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.9}
DIMS = tuple(TEMPERATURE)
_CELL = [f"__mix_{d}" for d in DIMS]

#: Topic patterns, first match wins.
TOPICS = (("contact", "@[A-Za-z0-9-]+[.]"), ("markup", "[#*$%&|<>][#*$%&|<>]"), ("figures", "[0-9][0-9][0-9][0-9]"))


def topic_of(text):
    """Rule-based topic of a text column."""
    out = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "blank")
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with cell columns and ``n_tokens`` (words)."""
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(F.col("text"))
    return (
        docs.withColumn(_CELL[0], F.coalesce(F.col("source").cast("string"), F.lit("")))
        .withColumn(_CELL[1], F.coalesce(F.col("lang").cast("string"), F.lit("")))
        .withColumn(_CELL[2], topic)
        .withColumn("n_tokens", F.size(words_of(F.col("text"))).cast("long"))
    )


def value_targets(cells: DataFrame, dim: str, column: str, given: dict[str, float], budget: float) -> DataFrame:
    """``column, t``: the tokens to take of each value of a dimension, at most those it has.

    The level that spends the budget is found on the values in order of tokens per share: below it a value gives all it has.
    """
    values = cells.groupBy(column).agg(F.sum("tokens").cast("double").alias("m"))
    every = Window.partitionBy()
    power = F.when(F.col("m") > 0, F.pow("m", F.lit(TEMPERATURE[dim]))).otherwise(0.0)
    named = F.col(column).isin(*given) if given else F.lit(False)
    rest = F.nullif(F.sum(F.when(named, 0.0).otherwise(power)).over(every), F.lit(0.0))
    share = F.coalesce(power / rest * F.lit(max(0.0, 1.0 - sum(given.values()))), F.lit(0.0))
    for value, x in given.items():
        share = F.when(F.col(column) == value, F.lit(float(x))).otherwise(share)
    values = values.withColumn("s", F.when(F.col("m") > 0, share).otherwise(0.0)).withColumn("spend", F.sum("m").over(every) * F.lit(budget))
    values = values.withColumn("ratio", F.col("m") / F.nullif(F.col("s"), F.lit(0.0)))
    order = Window.orderBy(F.asc_nulls_last("ratio"), column)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum("m").over(before), F.lit(0.0))
    values = values.withColumn("level", (F.col("spend") - full) / F.nullif(F.sum("s").over(after), F.lit(0.0)))
    level = F.max("level").over(every)  # it rises while values are full and falls after
    return values.select(column, F.when(F.col("s") <= 0, 0.0).when(F.col("ratio") <= level, F.col("m")).otherwise(level * F.col("s")).alias("t"))


def raked_cells(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Cell columns, ``tokens``, the fitted tokens ``w``, the targets of the cell's values and ``probability``.

    ``targets`` may name shares for a dimension's values; values it does not name share what is left by temperature.
    """
    cells = cut(cells)
    few = cells.count() <= ONE_TASK
    cells = _together(cells, few)
    out = cells.withColumn("w", F.col("tokens") * F.lit(float(budget)))
    for dim, column in zip(DIMS, _CELL):
        given = {k: float(v) for k, v in ((targets or {}).get(dim) or {}).items()}
        out = out.join(value_targets(cells, dim, column, given, budget).withColumnRenamed("t", f"t_{dim}"), column)
    out = _together(cut(out), few)
    sums = {dim: F.sum("w").over(Window.partitionBy(column)) for dim, column in zip(DIMS, _CELL)}
    for _ in range(-(-rounds // LOOK)):
        for _ in range(LOOK):
            for dim in DIMS:
                fitted = F.col("w") * F.col(f"t_{dim}") / F.nullif(sums[dim], F.lit(0.0))
                out = out.withColumn("w", F.least(F.col("tokens").cast("double"), F.coalesce(fitted, F.lit(0.0))))
        out = _together(cut(out), few)
        if _error(out, sums, budget) <= TOLERANCE:
            break
    chance = F.when(F.col("tokens") > 0, F.col("w") / F.nullif(F.col("tokens"), F.lit(0))).otherwise(F.lit(float(budget)))
    return out.withColumn("probability", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), chance)), 9))


def _together(cells: DataFrame, few: bool) -> DataFrame:
    """``few`` cells as one partition: read back from a cut they say nothing of how they lie, and each window would shuffle them."""
    return cells.coalesce(1) if few else cells


def _error(cells: DataFrame, sums: dict, budget: float) -> float:
    """The largest difference between a value's tokens and its target, as a part of the budget."""
    gaps = cells.select("tokens", *(F.abs(sums[dim] - F.col(f"t_{dim}")).alias(dim) for dim in DIMS))
    row = gaps.agg(F.max(F.greatest(*DIMS)).alias("gap"), F.sum("tokens").alias("tokens")).first()
    return (row["gap"] or 0.0) / max(1.0, budget * (row["tokens"] or 0))


def marginals(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """``dim, value, target, fitted``: tokens asked of each value and tokens that the fitted weights give it."""
    cells = raked_cells(measured(docs).groupBy(*_CELL).agg(F.sum("n_tokens").alias("tokens")), targets, budget)
    one = [cells.groupBy(F.lit(dim).alias("dim"), F.col(c).alias("value")).agg(F.max(f"t_{dim}").alias("target"), F.sum("w").alias("fitted")) for dim, c in zip(DIMS, _CELL)]
    return one[0].unionByName(one[1]).unionByName(one[2])


def draw(doc_id, seed: str = SEED):
    """A number in [0, 1) from seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """``docs`` with ``topic, n_tokens, probability`` and ``kept``, one row for each row."""
    rows = measured(docs)
    cells = rows.groupBy(*_CELL).agg(F.sum("n_tokens").alias("tokens"))
    cells = small(raked_cells(cells, targets, budget).select(*_CELL, "probability"))
    out = rows.join(cells.select(*_CELL, F.col("probability").alias("__mix_p")), _CELL)
    if "topic" not in docs.columns:
        out = out.withColumn("topic", F.col(_CELL[2]))
    out = out.withColumn("probability", F.col("__mix_p")).withColumn("kept", draw(F.col("doc_id"), seed) < F.col("__mix_p"))
    return out.select(*docs.columns, *(c for c in ("topic", "n_tokens", "probability", "kept") if c not in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    slim = measured(docs)
    slim = cut(slim.select("doc_id", *_CELL, "n_tokens"))
    cells = small(raked_cells(slim.groupBy(*_CELL).agg(F.sum("n_tokens").alias("tokens"))).select(*_CELL, "probability"))
    out = slim.join(cells, _CELL)
    return out.select("doc_id", *(F.col(c).alias(d) for c, d in zip(_CELL, DIMS)), "n_tokens", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("kept"))


def oracle() -> str:
    """The same numbers in DuckDB SQL: targets by ordered sums, raking by a recursive table, one step of one dimension each time."""
    blanks = "[ \\t-\\r]+"
    topics = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    steps = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'blank' {topics} ELSE 'prose' END AS topic,"
        f" len(list_filter(string_split_regex(coalesce(text, ''), '{blanks}'), lambda w: w <> ''))::BIGINT AS n_tokens FROM documents)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for dim in DIMS:
        steps += [
            f"m_{dim} AS (SELECT {dim}, sum(tokens) AS m, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {TEMPERATURE[dim]}::DOUBLE) ELSE 0 END AS s FROM c GROUP BY {dim})",
            f"n_{dim} AS (SELECT {dim}, m, s / nullif(sum(s) OVER (), 0) AS s, sum(m) OVER () * {BUDGET}::DOUBLE AS spend, m / nullif(s / nullif(sum(s) OVER (), 0), 0) AS ratio FROM m_{dim})",
            f"l_{dim} AS (SELECT *, (spend - coalesce(sum(m) OVER (ORDER BY ratio NULLS LAST, {dim} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"
            f" / nullif(sum(s) OVER (ORDER BY ratio NULLS LAST, {dim} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM n_{dim})",
            f"t_{dim} AS (SELECT {dim}, CASE WHEN coalesce(s, 0) <= 0 THEN 0 WHEN ratio <= x THEN m ELSE x * s END AS t_{dim} FROM l_{dim}, (SELECT max(level) AS x FROM l_{dim}))",
        ]
    turn = " ".join(f"WHEN {k} THEN {dim}" for k, dim in enumerate(DIMS))
    target = " ".join(f"WHEN {k} THEN t_{dim}" for k, dim in enumerate(DIMS))
    present = f"sum(w) OVER (PARTITION BY CASE k % 3 {turn} END)"
    gap = "greatest(" + ", ".join(f"abs(sum(w) OVER (PARTITION BY {dim}) - t_{dim})" for dim in DIMS) + ")"
    steps.append(
        f"r AS (SELECT 0 AS k, *, tokens * {BUDGET}::DOUBLE AS w FROM c {' '.join(f'JOIN t_{dim} USING ({dim})' for dim in DIMS)}"
        f" UNION ALL SELECT k + 1, * EXCLUDE (k, w, gap, error), least(tokens, coalesce(w * CASE k % 3 {target} END / nullif({present}, 0), 0))"
        f" FROM (SELECT *, max(gap) OVER () / greatest(1, {BUDGET}::DOUBLE * sum(tokens) OVER ()) AS error FROM (SELECT *, {gap} AS gap FROM r))"
        f" WHERE k < {3 * ROUNDS} AND NOT (k > 0 AND k % {3 * LOOK} = 0 AND error <= {TOLERANCE}))"
    )
    steps.append(f"p AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN greatest(0, least(1, w / tokens)) ELSE {BUDGET} END, 9)::DOUBLE AS probability FROM r WHERE k = (SELECT max(k) FROM r))")
    return (
        "WITH RECURSIVE " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, n_tokens, probability, ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < probability AS kept"
        " FROM d JOIN p USING (source, lang, topic)"
    )
