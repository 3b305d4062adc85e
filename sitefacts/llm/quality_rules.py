"""Quality rules with risk-controlled thresholds.

Each rule rejects a document when its measure passes a cutoff. Cutoffs are drawn from a path of settings, fixed beforehand,
that goes from all rules off to all rules sharp: each step sharpens one rule by one cutoff, the rules in turn. The path is
walked in each stratum (language) on labelled holdout rows: a setting is certified if an exact binomial test shows that all
rules together reject at most a share ``risk`` of good documents, that is, if so few rejections of good rows would have a
chance below ``delta / strata`` were the true share larger. The walk ends before the first setting that fails, so a wrong
choice needs a false certificate at one setting only, the first whose true share is too large, and testing many settings
needs no further correction; the division makes all strata hold together.

A language with too few good rows to certify anything belongs to the stratum of all such languages, which is tested and
cut as one. A stratum without labels keeps all that passes the base rules.

DataFrame functions only. Null text has no words and fails the base; null language is the language ''. Repeated rows are
judged alike; repeated labels of one doc_id count once, as good only if all say so. Extra columns, whatever their names,
stay behind.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import BLANKS, bind, cut, small, words_of

FALSE_REJECTIONS, DELTA = 0.05, 0.05
LEAST_WORDS, MOST_REPEATED, SPAN = 20, 30, 8

#: Rule, measure of the base columns, and cutoffs from lenient to sharp; a value above the cutoff rejects.
RULES = {
    "symbols": ("n_symbols / nullif(n_words, 0)", (2.0, 1.0, 0.5, 0.2, 0.1, 0.05, 0.02)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.7, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", (0.25, 0.2, 0.15, 0.1, 0.05, 0.02)),
    "long_words": ("word_chars / nullif(n_words, 0)", (12.0, 10.0, 9.0, 8.0, 7.0, 6.5, 6.0, 5.5)),
    "short_words": ("-word_chars / nullif(n_words, 0)", (-2.5, -3.0, -3.5, -4.0, -4.5)),
}
#: The path: (rule, cutoff) of each step, numbered from 1.
PATH = [(name, cuts[k]) for k in range(max(len(c) for _, c in RULES.values())) for name, (_, cuts) in RULES.items() if k < len(cuts)]
#: The stratum of the languages with few good rows.
POOLED = "*"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words):
    """How many words lie in a window of ``SPAN`` words that occurs twice or more in ``words``; linear but for a sort.

    Windows are compared by a 64-bit hash. Texts whose windows all differ stop at the first test.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - SPAN), lambda i: F.xxhash64(F.slice(words, i + 1, SPAN)))

    def covered(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda p, k: F.get(p, k)["h"]
        twice = lambda p: F.filter(p, lambda x, k: (x["h"] == same(p, k - 1)) | (x["h"] == same(p, k + 1)))
        found = bind(pairs, lambda p: F.array_sort(F.transform(twice(p), lambda x: x["i"])))
        return bind(found, lambda f: F.aggregate(F.transform(f, lambda x, k: F.coalesce(F.least(F.get(f, k + 1) - x, F.lit(SPAN)), F.lit(SPAN))), F.lit(0), lambda a, x: a + x))

    counted = bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) <= SPAN, F.lit(0)).otherwise(counted).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, language``, the base measures and ``n_lines`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return base.select(
        "doc_id",
        "language",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("line"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    ).select("doc_id", "language", "n_words", "word_chars", "n_symbols", F.col("line.dup").alias("n_dup_lines"), "n_repeat_words", F.col("line.all").alias("n_lines"))


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def binomial_tail(k, n, share: float):
    """P(at most ``k`` of ``n``) at probability ``share``, by exact summation of the mass in log space."""
    odds = math.log(share) - math.log1p(-share)
    start = F.struct((n * math.log1p(-share)).alias("log"), F.exp(n * math.log1p(-share)).alias("sum"))

    def add(state, i):
        log = state["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.lit(odds)
        return F.struct(log.alias("log"), (state["sum"] + F.exp(log)).alias("sum"))

    terms = F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0)
    return F.aggregate(terms, start, add, lambda s: s["sum"])


def step_of(name: str):
    """The first step of the path at which a rule rejects a row; null if none does."""
    value, out = F.expr(RULES[name][0]), F.when(F.lit(False), 0)
    for step, (rule, cutoff) in enumerate(PATH, 1):
        if rule == name:
            out = out.when(value > cutoff, step)
    return out


def with_steps(measured: DataFrame) -> DataFrame:
    """Appends ``base_failed``, ``step`` (the first at which any rule rejects the row) and ``rule`` (that rule)."""
    steps = F.array(*(F.struct(step_of(name).alias("step"), F.lit(name).alias("rule")) for name in RULES))
    first = F.array_min(F.filter(steps, lambda x: x["step"].isNotNull()))
    return measured.withColumn("base_failed", base_failed()).withColumn("first", first).select("*", F.col("first.step").alias("step"), F.col("first.rule").alias("rule")).drop("first")


def least_rows(risk: float, level: float) -> int:
    """The fewest good rows that can certify a setting: with none of them rejected."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def thresholds(stepped: DataFrame, labels: DataFrame, risk: float = FALSE_REJECTIONS, delta: float = DELTA) -> DataFrame:
    """``language, stratum, good, reached``: the last step of the certified path for each language with labels.

    The languages' counts by step are a small table; all that follows works on it.
    """
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality > 0")
    held = stepped.where(~F.col("base_failed")).join(good.select("doc_id"), "doc_id")
    counts = cut(held.groupBy("language", F.coalesce("step", F.lit(len(PATH) + 1)).alias("step")).agg(F.count("*").alias("k")))
    sizes = counts.groupBy("language").agg(F.sum("k").alias("n"))
    # Every language on its own is the strictest division, so what counts as few does not hang on the outcome.
    everywhere = Window.partitionBy()
    sizes = sizes.withColumn("few", F.log(F.lit(delta) / F.count("*").over(everywhere)) / math.log1p(-risk))
    sizes = sizes.select("language", F.when(F.col("n") >= F.ceil("few"), F.col("language")).otherwise(POOLED).alias("stratum"))
    strata = counts.join(sizes, "language").groupBy("stratum", "step").agg(F.sum("k").alias("k"))
    steps = strata.select("stratum").distinct().withColumn("strata", F.count("*").over(everywhere)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(PATH) + 1))))
    walk = Window.partitionBy("stratum").orderBy("step")
    rows = steps.join(strata, ["stratum", "step"], "left").withColumn("k", F.sum(F.coalesce("k", F.lit(0))).over(walk))
    rows = rows.withColumn("n", F.max("k").over(Window.partitionBy("stratum"))).where(F.col("step") <= len(PATH))
    chance = F.when(F.col("k") < risk * F.col("n"), binomial_tail(F.col("k"), F.col("n"), risk)).otherwise(1.0)
    rows = rows.withColumn("fails", (chance > F.lit(delta) / F.col("strata")).cast("int"))
    reached = rows.groupBy("stratum").agg(F.max("n").alias("good"), F.coalesce(F.min(F.when(F.col("fails") == 1, F.col("step"))) - 1, F.lit(len(PATH))).alias("reached"))
    return sizes.join(reached, "stratum").select("language", "stratum", "good", "reached")


def judge(docs: DataFrame, labels: DataFrame, risk: float = FALSE_REJECTIONS, delta: float = DELTA) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``kept`` and the rule that rejects, one row for each row."""
    stepped = cut(with_steps(measures(docs)))
    chosen = small(thresholds(stepped, labels, risk, delta).select("language", "reached"))
    reason = F.when(F.col("base_failed"), F.lit("base")).when(F.col("step") <= F.col("reached"), F.col("rule"))
    out = stepped.join(chosen, "language", "left").withColumn("rejected_by", reason)
    return out.select("doc_id", *BASE, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def oracle() -> str:
    """DuckDB twin: windows exploded and counted, the path as a table, tails by log-gamma sums."""
    measure = {name: value.replace(" /", "::DOUBLE /") for name, (value, _) in RULES.items()}
    values = " ".join(f"WHEN '{n}' THEN {measure[n]}" for n in RULES)
    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS language, coalesce(text, '') AS text,
                  list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS words FROM documents),
     win AS (SELECT doc_id, unnest(range(1, len(words) - {SPAN - 2})) AS i FROM w WHERE len(words) > {SPAN}),
     h AS (SELECT doc_id, i, array_to_string(words[i:i + {SPAN - 1}], ' ') AS x FROM win JOIN w USING (doc_id)),
     rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM h) WHERE c > 1),
     cov AS (SELECT doc_id, sum(least({SPAN}, coalesce(nxt - i, {SPAN})))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
     ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls FROM w),
     m AS (SELECT w.doc_id, language, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ \\t-\\r]+', '', 'g'))::BIGINT AS word_chars,
                  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
                  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
           FROM w JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
     path AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}', {float(c)}::DOUBLE)" for k, (n, c) in enumerate(PATH, 1))}) t(step, rule, cutoff)),
     hit AS (SELECT doc_id, min(step) AS step, arg_min(rule, step) AS rule FROM m CROSS JOIN path WHERE (CASE rule {values} END) > cutoff GROUP BY doc_id),
     b AS (SELECT m.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, step, rule FROM m LEFT JOIN hit USING (doc_id)),
     g AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) > 0),
     held AS (SELECT b.* FROM b JOIN g USING (doc_id) WHERE NOT base_failed),
     s AS (SELECT language, CASE WHEN count(*) >= ceil(ln({DELTA}::DOUBLE / count(*) OVER ()) / {math.log1p(-FALSE_REJECTIONS)}) THEN language ELSE '{POOLED}' END AS stratum FROM held GROUP BY language),
     v AS (SELECT stratum, p.step, count(*) AS n, count(*) FILTER (held.step <= p.step) AS k FROM held JOIN s USING (language) CROSS JOIN path p GROUP BY ALL),
     c AS (SELECT stratum, step, NOT (k < {FALSE_REJECTIONS} * n AND list_sum(list_transform(range(0, k + 1), lambda i:
              exp(lgamma(n + 1) - lgamma(i + 1) - CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1) END + i * ln({FALSE_REJECTIONS}) + (n - i) * ln(1 - {FALSE_REJECTIONS})))) <= {DELTA}::DOUBLE / (SELECT count(DISTINCT stratum) FROM s)) AS fails FROM v),
     r AS (SELECT stratum, coalesce(min(step) FILTER (fails) - 1, {len(PATH)}) AS reached FROM c GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by IS NULL AS kept, rejected_by
FROM (SELECT b.*, CASE WHEN base_failed THEN 'base' WHEN step <= reached THEN rule END AS rejected_by FROM b LEFT JOIN s USING (language) LEFT JOIN r USING (stratum))
"""
