"""Pages: sites, visible text, titles, links, and what a site's pages say together.

Rows are ``site, page_seq, url, html``; order within a site is ``page_seq``. A site is the host of its urls.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.functions import checks, urls, vocab
from sitefacts.functions.markup import Page
from sitefacts.functions.rx import blank, count_of, has, swap, trim

_ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def site_pages(pages: DataFrame) -> DataFrame:
    """``site, page_seq, url, html`` of rows ``page_id, url, html``; urls without host have no site and go."""
    return pages.select(urls.host(F.col("url")).alias("site"), F.col("page_id").alias("page_seq"), "url", F.coalesce("html", F.lit("")).alias("html")).where("site <> ''")


_PARSED = (
    "site string, page_seq long, url string, text string, title string, og_title string, og_site_name string, "
    "links array<struct<raw:string,anchor:string>>, images array<struct<src:string,alt:string,title:string,caption:string>>, scripts array<string>"
)
#: Rows of a batch of parsed pages.
_BATCH = 200


def parsed(pages: DataFrame) -> DataFrame:
    """``site, page_seq, url`` and all that a page's markup says, read in one pass: ``text, title, og_title, og_site_name, links, images, scripts``.

    The exact tier: what a browser's tree would give, for pages of any shape. ``visible_text`` and ``links`` are the native
    tier for pages whose tags are closed.
    """

    def run(batches):
        link, image = (pa.struct([(c, pa.string()) for c in names]) for names in (("raw", "anchor"), ("src", "alt", "title", "caption")))
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.list_(link), pa.list_(image), pa.list_(pa.string())]
        names = [x.split()[0] for x in _PARSED.replace(":", " ").split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH):
                part, rows = batch.slice(lo, _BATCH), []
                for site, seq, url, html in zip(*(part.column(c).to_pylist() for c in ("site", "page_seq", "url", "html"))):
                    page = Page(html or "")
                    links = [dict(zip(("raw", "anchor"), x)) for x in page.links()]
                    images = [dict(zip(("src", "alt", "title", "caption"), x)) for x in page.images()]
                    rows.append((site, seq, url, page.visible(), page.title_text(), page.named.get("og:title", ""), page.named.get("og:site_name", ""), links, images, page.scripts))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    rows = pages.select("site", F.col("page_seq").cast("long").alias("page_seq"), "url", "html").mapInArrow(run, _PARSED)
    return rows.withColumn("og_title", trim(F.col("og_title"))).withColumn("og_site_name", trim(F.col("og_site_name")))


def decode_entities(text):
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def tag_text(html):
    """Trimmed text of a small piece of HTML."""
    return trim(decode_entities(F.regexp_replace(html, "<[^>]*>", "")))


def visible_text(html):
    """Text of the body: hidden elements dropped, a line end where a block closes, runs of blanks and line ends shortened."""
    out = F.regexp_replace(html, r"(?is)^.*?<body\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?is)</body\b.*$", "")
    for name in ("script", "style", "noscript", "svg"):
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, rf"(?i)<br\b[^>]*>|</(?:{'|'.join(vocab.BLOCK_TAGS[1:])})\s*>", "\n")
    out = decode_entities(F.regexp_replace(out, "<[^>]*>", ""))
    out = F.regexp_replace(out, r"[ \t\f\x0B]+", " ")
    out = F.regexp_replace(out, r"\n[ \t]+", "\n")
    return trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def title_of(html):
    return tag_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta(html, name: str):
    """Content of the first meta tag of that property or name, whichever attribute stands first."""
    ahead = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    behind = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*content=["']([^"']*)["'][^>]*(?:property|name)=["']{name}["']""", 1)
    return trim(decode_entities(F.when(ahead != "", ahead).otherwise(behind)))


def links(pages: DataFrame) -> DataFrame:
    """``site, page_seq, url, pos, href, anchor, score``: links to the same origin that are no assets, in document order.

    Anchors come first, then ``data-`` attributes, then quoted paths in click handlers.
    """
    html = F.col("html")
    found = lambda pattern, group: F.regexp_extract_all(html, F.lit(pattern), F.lit(group))
    anchor = r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
    data = r"""(?is)<[a-z]+\b[^>]*?\bdata-(?:href|url|link|page|target-url)=["']([^"']*)["'][^>]*>([^<]*)"""
    click = r"""(?is)<[a-z]+\b[^>]*?\bonclick="[^"]*'([^"']+/[^"']*)'[^"]*"[^>]*>([^<]*)"""
    each = F.concat(*(F.arrays_zip(found(p, 1).alias("raw"), found(p, 2).alias("anchor")) for p in (anchor, data, click)))
    rows = pages.select("site", "page_seq", "url", F.posexplode(each).alias("pos", "x"))
    return _targets(rows.select("site", "page_seq", "url", "pos", trim(decode_entities(F.col("x.raw"))).alias("raw"), tag_text(F.col("x.anchor")).alias("anchor")))


def parsed_links(found: DataFrame) -> DataFrame:
    """``links`` of ``parsed`` pages: the same columns, from the exact tier."""
    rows = found.select("site", "page_seq", "url", F.posexplode("links").alias("pos", "x"))
    return _targets(rows.select("site", "page_seq", "url", "pos", trim(F.col("x.raw")).alias("raw"), F.col("x.anchor").alias("anchor")))


def _targets(rows: DataFrame) -> DataFrame:
    rows = rows.where((F.col("raw") != "") & ~F.col("raw").rlike("^(mailto:|tel:|#)"))
    rows = rows.withColumn("abs", urls.resolve(F.col("raw"), F.col("url"))).where(F.col("abs").rlike("(?i)^https?://") & urls.same_origin(F.col("abs"), F.col("url")) & ~urls.is_asset(F.col("abs")))
    return rows.select("site", "page_seq", "url", "pos", urls.url_key(F.col("abs")).alias("href"), "anchor", urls.link_score(F.col("abs"), F.col("anchor")).alias("score"))


def thin(pages: DataFrame) -> DataFrame:
    """Appends ``text_chars, n_links, thin``: pages with little text or few links, whose markup was likely built by script."""
    n_links = links(pages).groupBy("site", "page_seq").agg(F.count("*").alias("n_links"))
    out = pages.withColumn("text_chars", F.length(visible_text(F.col("html"))).cast("long")).join(n_links, ["site", "page_seq"], "left").fillna(0, ["n_links"])
    score = F.lit(vocab.START_SCORE) if "priority" not in pages.columns else F.col("priority")
    return out.withColumn("thin", (score >= 70) | ((score >= 40) & (F.col("text_chars") < 2500)) | ((F.col("n_links") < 4) & (F.col("text_chars") < 3500)))


def prefer_rendered(static, rendered):
    """The rendered copy of a page where it has clearly more text or more links; else the static one."""
    count = lambda html: F.regexp_count(html, F.lit(r"(?i)\bhref="))
    richer = (F.length(visible_text(rendered)) > F.length(visible_text(static)) * 1.15) | (count(rendered) > count(static))
    return F.when(rendered.isNull(), static).when(static.isNull() | richer, rendered).otherwise(static)


def most_common(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """``by`` and the most frequent trimmed value that is not blank; of equals, the one seen first."""
    counted = rows.select(*by, trim(F.col(value)).alias("v"), F.col(order).alias("o")).where("v <> ''").groupBy(*by, "v").agg(F.count("*").alias("n"), F.min("o").alias("first"))
    return counted.groupBy(*by).agg(F.max_by("v", F.struct("n", -F.col("first"))).alias(value))


def longest(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """``by`` and the longest value; of equals, the first."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(F.length(value), -F.col(order))).alias(value))


def site_titles(pages: DataFrame) -> DataFrame:
    """``site, title``: each site's longest page title."""
    return longest(pages.select("site", "page_seq", title_of(F.col("html")).alias("title")), ["site"], "title", "page_seq")


def site_names(titles: DataFrame, structured: DataFrame) -> DataFrame:
    """``site, name, confidence`` of ``site, page_seq, title, og_title, og_site_name`` and structured ``site, name``.

    The structured name, else the most common site name, else the most common title that says something, else the longest.
    """
    plain = titles.where(~checks.generic_title(F.col("og_title")))
    out = longest(titles, ["site"], "title", "page_seq")
    out = out.join(most_common(titles, ["site"], "og_site_name", "page_seq"), "site", "left").join(most_common(plain, ["site"], "og_title", "page_seq"), "site", "left").join(structured, "site", "left")
    set_ = lambda c: ~blank(F.coalesce(F.col(c), F.lit("")))
    best = F.when(set_("name"), F.struct(F.col("name"), F.lit(0.92).alias("confidence")))
    best = best.when(set_("og_site_name"), F.struct(F.col("og_site_name").alias("name"), F.lit(0.78).alias("confidence")))
    best = best.when(set_("og_title"), F.struct(checks.title(F.col("og_title")).alias("name"), F.lit(0.62).alias("confidence")))
    best = best.when(set_("title"), F.struct(checks.title(F.col("title")).alias("name"), F.lit(0.48).alias("confidence"))).otherwise(F.struct(F.lit("").alias("name"), F.lit(0.0).alias("confidence")))
    return out.select("site", best.alias("b")).select("site", "b.*")


def name_or_title(name, title):
    """The name, or what stands before a title's first separator."""
    return F.when(blank(name), F.coalesce(F.get(F.split(title, r"\s*[|\-–]\s*"), F.lit(0)), F.lit(""))).otherwise(name)


def corpus(texts: DataFrame) -> DataFrame:
    """``site, text``: page texts in order, a blank line between them. For sites of bounded size; large ones count by page."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "text"))), lambda x: x["text"])
    return texts.groupBy("site").agg(F.array_join(ordered, "\n\n").alias("text"))


def first_by_key(rows: DataFrame, by: list[str], key: str, order: list[str], most: int | None = None) -> DataFrame:
    """First row of each key of each group, numbered ``n`` in order, at most ``most`` of them."""
    names = [c for c in rows.columns if c not in (*by, key)]
    kept = rows.groupBy(*by, key).agg(F.min(F.struct(*order, *(c for c in names if c not in order))).alias("x")).select(*by, key, "x.*")
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return kept if most is None else kept.where(F.col("n") <= most)


def seeds(sites: DataFrame, sitemap: DataFrame) -> DataFrame:
    """``site, url, depth, score, seq``: the start page, the usual paths, then the site map's urls."""
    own = sites.select("site", "start", urls.origin(F.col("start")).alias("o"))
    start = own.select("site", urls.url_key(F.col("start")).alias("url"), F.lit(vocab.START_SCORE).alias("score"), F.lit(0).cast("long").alias("seq"))
    usual = own.select("site", "o", F.posexplode(F.array(*map(F.lit, vocab.SEED_PATHS))).alias("k", "path"))
    usual = usual.select("site", F.concat("o", "path").alias("url"), F.lit(vocab.SEED_SCORE).alias("score"), (F.col("k") + 1).cast("long").alias("seq"))
    mapped = sitemap.select("site", urls.url_key(F.col("url")).alias("url"), F.lit(vocab.SITEMAP_SCORE).alias("score"), (F.col("n") + 1000).cast("long").alias("seq"))
    return start.unionByName(usual).unionByName(mapped).withColumn("depth", F.lit(0))


def verify_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of ``pages`` (with ``site, page_seq, url``) that are a site's start page or its root, numbered ``n`` 0 and 1."""
    wanted = sites.select("site", urls.url_key(F.col("url")).alias("k"), F.lit(0).alias("n"))
    wanted = wanted.unionByName(sites.select("site", F.concat(urls.origin(F.col("url")), F.lit("/")).alias("k"), F.lit(1).alias("n"))).groupBy("site", "k").agg(F.min("n").alias("n"))
    found = pages.withColumn("k", urls.url_key(F.col("url"))).join(wanted, ["site", "k"])
    place = F.row_number().over(Window.partitionBy("site", "k").orderBy("page_seq"))
    return found.withColumn("__place", place).where("__place = 1").drop("__place", "k")


def site_scores(sites: DataFrame, pages: DataFrame, structured: DataFrame) -> DataFrame:
    """``site, score, accepted, marketplace`` of ``site, url``, pages with ``title, text``, and structured hints.

    Signals are counted over the titles and the first ``VERIFY_CUT`` characters of the start page and the root, as one text.
    """
    said = F.struct("n", F.concat("title", F.lit("\n"), F.left("text", F.lit(vocab.VERIFY_CUT))).alias("said"))
    texts = verify_pages(sites, pages).groupBy("site").agg(F.array_sort(F.collect_list(said)).alias("x")).select("site", F.array_join(F.transform("x", lambda x: x["said"]), "\n\n").alias("text"))
    rows = sites.join(texts, "site", "left").join(structured, "site", "left").fillna(False, ["has_name", "has_address", "has_phone"])
    host = swap(urls.host(F.col("url")), r"^www\.", "")
    points = lambda when, n: F.when(when, n).otherwise(0)
    signals = lambda pattern, most: F.least(F.lit(most), F.coalesce(count_of(F.col("text"), pattern), F.lit(0)))
    score = (
        points(F.col("has_name"), 8) + points(F.col("has_address") & F.col("has_phone"), 2) + points(has(host, vocab.IDENTITY), 2) + signals(vocab.IDENTITY, 5)
        + signals(vocab.OPERATIONS, 5) + signals(vocab.DETAIL, 4) - points((signals(vocab.NOT_LODGING, 1) > 0) & ~F.col("has_name"), 3)
    ).cast("long")
    market = has(urls.host(F.col("url")), vocab.MARKETPLACE)
    scored = rows.select("site", score.alias("score"), market.alias("marketplace"), F.col("text").isNotNull().alias("opened"))
    return scored.select("site", "score", ((F.col("score") >= 7) & ~F.col("marketplace") & F.col("opened")).alias("accepted"), "marketplace")


def verify_urls(sites: DataFrame) -> DataFrame:
    """``site, url``: the start page and the site's root, each once."""
    return sites.select("site", "url").unionByName(sites.select("site", F.concat(urls.origin(F.col("url")), F.lit("/")).alias("url"))).distinct()


def og(html):
    return F.struct(meta(html, "og:title").alias("og_title"), meta(html, "og:site_name").alias("og_site_name"))


