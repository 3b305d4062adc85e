"""Robots rules, site maps and crawl order over pages already fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.functions import urls, vocab
from sitefacts.functions.rx import has, let, trim
from sitefacts.sources.shared import cut


def robots_rules(lines: DataFrame) -> DataFrame:
    """``site, seq, allow, path`` of robots lines ``site, line_no, line`` that stand in a group for all agents.

    An empty path means the whole site, whichever way the line reads; a later agent line ends the group.
    """
    clean = lines.withColumn("t", trim(F.regexp_replace("line", "#.*$", "")))
    parts = clean.withColumn("field", F.lower(trim(F.regexp_extract("t", r"^([^:]+):", 1)))).withColumn("value", trim(F.regexp_extract("t", r"^[^:]+:(.*)$", 1)))
    agent = F.when(F.col("field") == "user-agent", F.col("value") == "*")
    so_far = Window.partitionBy("site").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ours = parts.withColumn("ours", F.coalesce(F.last(agent, True).over(so_far), F.lit(False)))
    path = F.regexp_replace("value", "[?#].*$", "")
    path = F.when(path == "", "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return ours.where(F.col("ours") & F.col("field").isin("allow", "disallow")).select("site", F.col("line_no").alias("seq"), (F.col("field") == "allow").alias("allow"), path.alias("path"))


def allowed(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Appends ``allowed`` to ``site, url``: the longest rule on whole path segments decides, of equals the first; none allows.

    A rule fits a path if it is the path, or one of its beginnings up to a slash, with or without that slash. Each of these is
    looked up by a join, so the work grows with the urls and their segments, however many rules a site has.
    """
    firm = rules.groupBy("site", F.col("path").alias("__rule")).agg(F.max(F.struct((-F.col("seq")).alias("turn"), "allow"))["allow"].alias("__allow"))
    at = F.coalesce(F.nullif(urls.part(F.col("url"), "PATH"), F.lit("")), F.lit("/"))
    asked = targets.withColumn("__at", at)
    begun = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    parts = F.split("__at", "/")
    heads = F.when(F.size(parts) > 1, let(begun(parts), lambda b: F.concat(b, F.transform(b, lambda x: F.concat(x, F.lit("/")))))).otherwise(F.array().cast("array<string>"))
    looked_up = asked.select("site", "__at").distinct().select("site", "__at", F.explode(F.array_distinct(F.array_append(heads, F.col("__at")))).alias("__rule"))
    told = looked_up.join(firm, ["site", "__rule"]).groupBy("site", "__at").agg(F.max_by("__allow", F.length("__rule")).alias("__allow"))
    verdict = F.coalesce("__allow", F.lit(True)) & urls.origin(F.col("url")).isNotNull()
    return asked.join(told, ["site", "__at"], "left").select(*targets.columns, verdict.alias("allowed"))


def sitemap_urls(files: DataFrame, most: int = vocab.MAX_SITEMAP) -> DataFrame:
    """``site, url, n``: urls of site maps ``site, origin, file, xml``, first seen first, same origin, no assets."""
    rows = files.select("site", "origin", "file", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("pos", "url"))
    rows = rows.where(urls.same_origin(F.col("url"), F.col("origin")) & ~has(F.col("url"), vocab.SITEMAP_ASSET))
    kept = rows.groupBy("site", "url").agg(F.min(F.struct("file", "pos")).alias("at"))
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("at"))).where(F.col("n") <= most).select("site", "url", "n")


def site_map_files(fetched: DataFrame) -> DataFrame:
    """``site, origin, file, xml`` of the site maps among fetched files ``site, origin, url, xml``, ``file`` in the order they are read.

    A site's own map comes first, then the maps that its index names, in its order; other files are not read.
    """
    base = fetched.select("site", "origin", "url", "xml")
    own = base.where(F.col("url") == F.concat("origin", F.lit("/sitemap.xml"))).select("site", "origin", F.lit("0").alias("file"), "xml")
    index = base.where(F.col("url") == F.concat("origin", F.lit("/sitemap_index.xml")))
    named = index.select("site", "origin", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("pos", "url"))
    named = named.where(has(F.col("url"), r"sitemap.*\.xml$")).groupBy("site", "origin", "url").agg(F.min("pos").alias("pos"))
    nested = named.join(base.select("site", "url", "xml"), ["site", "url"]).select("site", "origin", F.concat(F.lit("1-"), F.lpad(F.col("pos").cast("string"), 9, "0")).alias("file"), "xml")
    return own.unionByName(nested)


def reach(seeds: DataFrame, links: DataFrame, pages: DataFrame, rules: DataFrame, depth: int = vocab.MAX_DEPTH) -> DataFrame:
    """``site, url, depth``: pages reached level by level from the seeds, each at its least depth.

    A level joins the frontier to the link table, drops what was seen or is disallowed, and keeps what was fetched.
    """
    edges = allowed(links.select("site", F.col("url").alias("src"), F.col("href").alias("url")).distinct(), rules).where("allowed").select("site", "src", F.col("url").alias("href"))
    known = cut(pages.select("site", F.col("url_key").alias("url")).distinct())
    edges = cut(edges.join(known.withColumnRenamed("url", "href"), ["site", "href"]))
    frontier = cut(allowed(seeds.select("site", "url").distinct(), rules).where("allowed").select("site", "url").join(known, ["site", "url"]).withColumn("depth", F.lit(0)))
    seen = frontier
    for level in range(1, depth + 1):
        step = frontier.select("site", F.col("url").alias("src")).join(edges, ["site", "src"]).select("site", F.col("href").alias("url")).distinct()
        frontier = cut(step.join(seen, ["site", "url"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _promising(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """``by`` and ``out``: of rows ``url, score, seq, leads`` the first of each url, and of those the best, as an array in turn.

    A crawl of ``most`` pages can have seen ``most`` urls of a list and take as many more, so twice that many are enough.
    """
    first = rows.groupBy(*by, "url").agg(F.min(F.struct("seq", "score", "leads")).alias("x")).select(*by, "url", "x.*")
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "seq")
    kept = first.withColumn("__place", F.row_number().over(best)).where(F.col("__place") <= 2 * most)
    return kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "url", "score", "leads"))).alias("out"))


def best_first(seeds: DataFrame, links: DataFrame, pages: DataFrame, most: int = vocab.MAX_PAGES, depth: int = vocab.MAX_DEPTH, ahead: int = 16) -> DataFrame:
    """``site, url, turn, depth``: the order in which a best-first crawl of at most ``most`` pages visits each site.

    Seeds and links are those that robots allow; what is not among ``pages`` cannot be fetched. A site's frontier is a queue by
    score, first in first out among equals. It advances in rounds: a round replays each site's queue over the links of the
    pages known so far, up to the first page whose links are not, and asks for those of the ``ahead`` best pages in the
    queue; a join brings them. A site's rows in a round are pages it visits or asked for, each with a bounded list, so a site
    of any size takes no more room than another; at least one page of each site is settled in a round. Pages without a link
    to a page are never asked for.
    """
    import heapq

    import pandas as pd

    known = pages.select("site", F.col("url_key").alias("url")).distinct()
    out_of = links.select("site", F.col("url").alias("src"), F.col("href").alias("url"), F.col("score").cast("double").alias("score"), F.col("pos").cast("long").alias("seq"))
    out_of = cut(out_of.where("src <> url").join(known, ["site", "url"], "left_semi"))
    sources = out_of.select("site", F.col("src").alias("url"), F.lit(True).alias("leads")).distinct()
    known = cut(known.join(sources, ["site", "url"], "left").fillna(False, ["leads"]))
    first = seeds.select("site", "url", F.col("score").cast("double").alias("score"), F.col("seq").cast("long").alias("seq"))
    first = _promising(first.join(known, ["site", "url"]), ["site"], most)
    out_of = cut(_promising(out_of.join(known, ["site", "url"]), ["site", "src"], most))
    held = cut(first.select("site", F.lit("").alias("src"), "out"))

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        lists = {src: [(x["url"], x["score"]) for x in out] for src, out in zip(group.src, group.out)}
        leads = {x["url"] for out in group.out for x in out if x["leads"]}
        queue, turn, seen, rows = [], 0, set(), []
        site = group.site.iloc[0]

        def push(found, before, level):
            nonlocal turn
            for url, points in found:
                if url not in seen:
                    heapq.heappush(queue, (-(points - before / 100), turn, url, level))
                    turn += 1

        push(lists.get("", []), 0.0, 0)
        while queue and len(rows) < most:
            score, _, url, level = queue[0]
            if url in seen:
                heapq.heappop(queue)
                continue
            wanted = level < depth and len(rows) + 1 < most and url in leads
            if wanted and url not in lists:
                asked = {}
                for _, _, other, below in sorted(queue):
                    if other in leads and other not in seen and other not in lists and below < depth:
                        asked[other] = True
                        if len(asked) == ahead:
                            break
                return pd.DataFrame([(site, u, -1, 0) for u in asked], columns=["site", "url", "turn", "depth"])
            heapq.heappop(queue)
            seen.add(url)
            rows.append((site, url, len(rows), level))
            if wanted:
                push(lists[url], score, level + 1)
        return pd.DataFrame(rows, columns=["site", "url", "turn", "depth"])

    done = None
    while True:
        replayed = cut(held.groupBy("site").applyInPandas(replay, "site string, url string, turn long, depth long"))
        whole = replayed.where("turn >= 0")
        done = whole if done is None else done.unionByName(whole)
        asked = replayed.where("turn < 0").select("site", F.col("url").alias("src"))
        if asked.isEmpty():
            return done
        empty = F.expr("cast(array() as array<struct<seq:bigint,url:string,score:double,leads:boolean>>)")
        more = asked.join(out_of, ["site", "src"], "left").select("site", "src", F.coalesce("out", empty).alias("out"))
        held = cut(held.join(asked.select("site").distinct(), "site", "left_semi").unionByName(more))
