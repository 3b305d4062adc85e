"""Queries over the page, document, conversation and event tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitefacts.functions import checks, urls, vocab
from sitefacts.functions.rx import count_of, has
from sitefacts.operators import contacts, crawling, facts, gaps, jsonld, pages
from sitefacts.operators.review import first_submissions
from sitefacts.plans import twin
from sitefacts.sources.tables import spread, table

_SITE = f"s AS (SELECT {twin.host('url')} AS site, page_id AS page_seq, url, coalesce(html, '') AS html FROM pages WHERE {twin.host('url')} <> '')"
_TEXTS = f"{_SITE}, t AS (SELECT site, page_seq, {twin.visible('html')} AS text FROM s)"
_DOCS = "t AS (SELECT source AS site, doc_id AS page_seq, text FROM documents)"
#: A corpus vocabulary: what counts for a document, and what speaks against it.
TERMS, AGAINST = r"\b(the|und|que|los|der|las)\b", r"\b(no|nicht|non|ne)\s+\w+"


def site_pages(spark, d):
    return pages.site_pages(table(spark, d, "pages"))


def page_texts(spark, d):
    return site_pages(spark, d).select("site", "page_seq", pages.visible_text(F.col("html")).alias("text"))


def doc_texts(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("page_seq"), "text")


def _phone_rows(texts):
    raw = f"(SELECT site, page_seq, m, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT site, page_seq, {twin.every('text', vocab.PHONE)} AS m FROM {texts}))"
    return (
        f"c AS (SELECT site, page_seq, pos, {twin.trim('m[pos + 1]')} AS value FROM {raw}), k AS (SELECT *, {twin.swap('value', '[^0-9]', '', False)} AS key FROM c WHERE {twin.phone_ok('value')}),"
        " f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY site, key ORDER BY page_seq, pos) = 1),"
        f" n AS (SELECT site, value, row_number() OVER (PARTITION BY site ORDER BY page_seq, pos)::INT AS n FROM f QUALIFY n <= {vocab.MAX_CONTACTS})"
    )


def site_primary_phone(spark, d):
    """Each site's main phone, how sure it is, and whether it is a gap."""
    texts = page_texts(spark, d)
    out = texts.select("site").distinct().join(contacts.primary_phone(texts), "site", "left").fillna("", ["phone"]).fillna(0.0, ["confidence"])
    return out.select("site", "phone", "confidence", gaps.text_gap(F.col("phone"), F.col("confidence")).alias("status"))


SITE_PRIMARY_PHONE = f"""WITH {_TEXTS}, {_phone_rows('t')},
 p AS (SELECT DISTINCT t.site, coalesce(value, '') AS phone, CASE WHEN value IS NULL THEN 0.0 WHEN regexp_matches(value, '[().\\-\\s]') THEN 0.82 ELSE 0.72 END::DOUBLE AS confidence FROM t LEFT JOIN (SELECT * FROM n WHERE n = 1) USING (site))
SELECT site, phone, confidence, CASE WHEN phone = '' THEN 'missing' WHEN confidence < 0.45 THEN 'partial' WHEN confidence < 0.65 THEN 'uncertain' ELSE 'complete' END AS status FROM p"""


def phone_candidates(spark, d):
    return contacts.phones(doc_texts(spark, d))


PHONE_CANDIDATES = f"WITH {_DOCS}, {_phone_rows('t')} SELECT site, n, CASE WHEN n = 1 THEN 'Primary phone' ELSE 'Additional phone ' || n END AS label, value FROM n"


def email_candidates(spark, d):
    return contacts.emails(doc_texts(spark, d))


EMAIL_CANDIDATES = f"""WITH {_DOCS}, m AS (SELECT site, page_seq, m, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT site, page_seq, {twin.every('text', vocab.EMAIL)} AS m FROM t)),
 e AS (SELECT site, page_seq, pos::INT AS pos, {twin.swap('m[pos + 1]', '[),.;:]+$', '')} AS email FROM m) SELECT *, {twin.bad_email('email')} AS rejected FROM e"""


def visible_text_stats(spark, d):
    return page_texts(spark, d).select("site", "page_seq", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.md5("text").alias("text_md5"))


VISIBLE_TEXT_STATS = f"WITH {_TEXTS} SELECT site, page_seq, length(text)::BIGINT AS n_chars, len(string_split(text, chr(10)))::BIGINT AS n_lines, md5(text) AS text_md5 FROM t"


def page_titles(spark, d):
    title = pages.title_of(F.col("html"))
    return site_pages(spark, d).select("site", "page_seq", title.alias("title"), checks.title(title).alias("clean"), checks.generic_title(title).alias("generic"), pages.name_or_title(F.lit(""), title).alias("fallback"))


PAGE_TITLES = f"""WITH {_SITE}, t AS (SELECT site, page_seq, {twin.title('html')} AS title FROM s)
SELECT site, page_seq, title, {twin.clean_title('title')} AS clean, {twin.has(twin.trim('title'), vocab.GENERIC_TITLE)} AS generic, string_split_regex(title, '\\s*[|\\-–]\\s*')[1] AS fallback FROM t"""


def longest_title(spark, d):
    return pages.site_titles(site_pages(spark, d))


LONGEST_TITLE = f"WITH {_SITE}, t AS (SELECT site, page_seq, {twin.title('html')} AS title FROM s) SELECT site, title FROM t QUALIFY row_number() OVER (PARTITION BY site ORDER BY length(title) DESC, page_seq) = 1"


def most_common_value(spark, d):
    return pages.most_common(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


MOST_COMMON_VALUE = """WITH c AS (SELECT user_id, trim(event_type) AS event_type, count(*) AS n, min(event_id) AS f FROM events WHERE trim(event_type) <> '' GROUP BY ALL)
SELECT user_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1"""


def url_forms(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.url_key(u).alias("url_key"), urls.image_key(u).alias("image_key"), urls.origin(u).alias("origin"), urls.host(u).alias("host"), urls.is_asset(u).alias("asset"), has(urls.host(u), vocab.MARKETPLACE).alias("marketplace"))


URL_FORMS = f"SELECT page_id, {twin.url_key('url')} AS url_key, lower(regexp_replace(url, '[?#].*$', '')) AS image_key, {twin.origin('url')} AS origin, {twin.host('url')} AS host, {twin.has('url', vocab.ASSET)} AS asset, {twin.has(twin.host('url'), vocab.MARKETPLACE)} AS marketplace FROM pages"


def page_links(spark, d):
    return pages.links(site_pages(spark, d))


_SCORE = f"(CASE WHEN regexp_matches(lower(a), '{vocab.LINK_PRIORITY}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(anchor), '{vocab.LINK_PRIORITY}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(a), '{vocab.LINK_KEY}') THEN 1 ELSE 0 END)"
#: Links of the page table are all root-relative anchors.
_LINKS = f"""{_SITE}, m AS (SELECT site, page_seq, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>', 1) AS h, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>', 2) AS x FROM s),
 u AS (SELECT site, page_seq, url, generate_subscripts(h, 1) - 1 AS pos, h, x FROM m), r AS (SELECT site, page_seq, url, pos::INT AS pos, {twin.trim(twin.entities('h[pos + 1]'))} AS raw, {twin.tag_text('x[pos + 1]')} AS anchor FROM u),
 l AS (SELECT *, {twin.origin('url')} || raw AS a FROM r WHERE raw LIKE '/%'), k AS (SELECT site, page_seq, url, pos, {twin.url_key('a')} AS href, anchor, {_SCORE} AS score FROM l WHERE NOT {twin.has('a', vocab.ASSET)})"""
PAGE_LINKS = f"WITH {_LINKS} SELECT * FROM k"


#: The page table's markup made regular: what the end cuts off goes, paragraphs that the next one ends and links are closed, entities end.
_WHOLE = r"regexp_replace(regexp_replace(html, '(?s)<!--(?:[^-]|-[^-]|--[^>])*$', ''), '<[^>]*$', '')"
_CLOSED = rf"regexp_replace(replace({_WHOLE}, '<br><p>', '<br></p><p>'), '&(amp|quot|copy|middot)([^;a-z]|$)', '&\1;\2', 'g')"
_REGULAR = f"{_SITE}, w AS (SELECT site, page_seq, url, {_CLOSED} AS html FROM s)"


def exact_texts(spark, d):
    """Text and title of every page by the exact tier."""
    found = pages.parsed(site_pages(spark, d))
    return found.select("site", "page_seq", F.length("text").cast("long").alias("text_chars"), F.md5("text").alias("text_md5"), "title")


EXACT_TEXTS = f"WITH {_REGULAR}, v AS (SELECT site, page_seq, {twin.visible('html')} AS text, {twin.title('html')} AS title FROM w) SELECT site, page_seq, length(text)::BIGINT AS text_chars, md5(text) AS text_md5, title FROM v"


def exact_links(spark, d):
    """Links of every page by the exact tier."""
    return pages.parsed_links(pages.parsed(site_pages(spark, d)))


EXACT_LINKS = f"WITH {_REGULAR}" + _LINKS.removeprefix(_SITE).replace("FROM s)", "FROM w)").replace("(.*?)</a\\s*>", "([^<]*)") + " SELECT * FROM k"


def thin_pages(spark, d):
    return pages.thin(site_pages(spark, d).withColumn("priority", F.lit(vocab.SITEMAP_SCORE))).select("site", "page_seq", "text_chars", "n_links", "thin")


THIN_PAGES = f"""WITH {_LINKS}, c AS (SELECT site, page_seq, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT site, page_seq, length({twin.visible('html')})::BIGINT AS text_chars FROM s)
SELECT site, page_seq, text_chars, coalesce(n, 0)::BIGINT AS n_links, text_chars < 2500 OR (coalesce(n, 0) < 4 AND text_chars < 3500) AS thin FROM t LEFT JOIN c USING (site, page_seq)"""


def seed_union(spark, d):
    sites = site_pages(spark, d).groupBy("site").agg(F.min_by("url", "page_seq").alias("start"))
    mapped = site_pages(spark, d).select("site", "url", F.row_number().over(pages.Window.partitionBy("site").orderBy("page_seq")).alias("n"))
    return pages.seeds(sites, mapped.where(F.col("n") <= vocab.MAX_SITEMAP)).select("site", "url", "score", "seq")


SEED_UNION = f"""WITH {_SITE}, b AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY page_seq) AS n FROM s), p AS (SELECT unnest({list(vocab.SEED_PATHS)}) AS p, generate_subscripts({list(vocab.SEED_PATHS)}, 1) AS k)
SELECT site, {twin.url_key('url')} AS url, 100.0::DOUBLE AS score, 0::BIGINT AS seq FROM b WHERE n = 1 UNION ALL SELECT site, {twin.origin('url')} || p, 38.0, k FROM b, p WHERE n = 1 UNION ALL SELECT site, {twin.url_key('url')}, 45.0, n + 1000 FROM b WHERE n <= 80"""


def site_verify_score(spark, d):
    own = site_pages(spark, d)
    sites = own.groupBy("site").agg(F.min_by("url", "page_seq").alias("url"))
    html = F.col("html")
    shown = own.select("site", "page_seq", "url", pages.title_of(html).alias("title"), pages.visible_text(html).alias("text"))
    found = jsonld.hints(jsonld.nodes(jsonld.scripts(pages.verify_pages(sites, own))))
    hints = found.select("site", *((F.col(c) != "").alias(f"has_{c}") for c in ("name", "address", "phone")))
    return pages.site_scores(sites, shown, hints)


_SIGNALS = ", ".join(f"{twin.count('text', p)} AS {n}" for n, p in (("i", vocab.IDENTITY), ("o", vocab.OPERATIONS), ("de", vocab.DETAIL), ("no", vocab.NOT_LODGING)))
#: No page of the table holds structured data.
SITE_VERIFY_SCORE = f"""WITH {_SITE}, b AS (SELECT site, url FROM s QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_seq) = 1),
 v AS (SELECT site, k, min(n) AS n FROM (SELECT site, {twin.url_key('url')} AS k, 0 AS n FROM b UNION ALL SELECT site, {twin.origin('url')} || '/', 1 FROM b) GROUP BY ALL),
 p AS (SELECT v.site, n, {twin.title('html')} || chr(10) || left({twin.visible('html')}, {vocab.VERIFY_CUT}) AS said FROM s JOIN v ON v.site = s.site AND v.k = {twin.url_key('s.url')} QUALIFY row_number() OVER (PARTITION BY v.site, k ORDER BY page_seq) = 1),
 t AS (SELECT site, string_agg(said, chr(10) || chr(10) ORDER BY n) AS text FROM p GROUP BY site), c AS (SELECT site, {_SIGNALS} FROM t),
 x AS (SELECT site, (CASE WHEN {twin.has("regexp_replace(site, '^www\\.', '')", vocab.IDENTITY)} THEN 2 ELSE 0 END + least(5, i) + least(5, o) + least(4, de) - CASE WHEN no > 0 THEN 3 ELSE 0 END)::BIGINT AS score, {twin.has('site', vocab.MARKETPLACE)} AS marketplace FROM c)
SELECT site, score, score >= 7 AND NOT marketplace AS accepted, marketplace FROM x"""


def verify_urls(spark, d):
    return pages.verify_urls(site_pages(spark, d).groupBy("site").agg(F.min_by("url", "page_seq").alias("url")))


VERIFY_URLS = f"WITH {_SITE}, b AS (SELECT site, url FROM s QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_seq) = 1) SELECT site, url FROM b UNION SELECT site, {twin.origin('url')} || '/' FROM b"


def term_scores(spark, d):
    counted = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", count_of(F.col("text"), TERMS).cast("long").alias("hits"), has(F.col("text"), AGAINST).alias("against"))
    scored = counted.select("doc_id", "hits", facts.term_score(F.col("hits"), F.col("against")).alias("score"))
    return scored.select("doc_id", "hits", "score", (F.col("score") >= facts.PRESENT).alias("present"))


TERM_SCORES = f"WITH c AS (SELECT doc_id, {twin.count('text', TERMS)} AS hits, {twin.has('text', AGAINST)} AS ne FROM documents) SELECT doc_id, hits, {twin.score('hits', 'ne')} AS score, {twin.score('hits', 'ne')} >= 0.55 AS present FROM c"


def corpus_text(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("site"), F.col("turn").alias("page_seq"), F.col("text"))
    return pages.corpus(rows).select(F.col("site").alias("conv_id"), F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


CORPUS_TEXT = "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS text_md5, length(string_agg(text, chr(10) || chr(10) ORDER BY turn, text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id"


def first_rows_win(spark, d):
    return first_submissions(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ("ts", "event_id"))


FIRST_ROWS_WIN = "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"


def csv_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(checks.csv_field(F.col("text"))).alias("field_md5"))


CSV_ESCAPE = f"SELECT doc_id, md5({twin.csv('text')}) AS field_md5 FROM documents"


def crawl_reach(spark, d):
    """Pages of the table that links reach from each site's first page."""
    own = site_pages(spark, d)
    known = own.select("site", urls.url_key(F.col("url")).alias("url_key"))
    first = own.groupBy("site").agg(F.min_by("url", "page_seq").alias("url")).select("site", urls.url_key(F.col("url")).alias("url"))
    rules = spark.createDataFrame([], "site string, seq int, allow boolean, path string")
    found = pages.links(own).withColumn("url", urls.url_key(F.col("url")))
    return crawling.reach(first, found, known, rules)


CRAWL_REACH = f"""WITH RECURSIVE {_LINKS}, f AS (SELECT site, {twin.url_key('url')} AS url, 0 AS depth FROM s QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_seq) = 1),
 g AS (SELECT DISTINCT k.site, {twin.url_key('k.url')} AS src, k.href FROM k JOIN s ON s.site = k.site AND {twin.url_key('s.url')} = k.href),
 w AS (SELECT * FROM f UNION SELECT g.site, g.href, depth + 1 FROM w JOIN g ON g.site = w.site AND g.src = w.url WHERE depth < 7) SELECT site, url, min(depth)::INT AS depth FROM w GROUP BY ALL"""

def _part_graph(spark, d):
    """A link graph of the tables: sites are brands, pages their parts, links what an order lists next."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("site"))
    line = table(spark, d, "lineitem")
    ahead = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    line = line.select(F.col("l_partkey").alias("key"), ahead.alias("next"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")).alias("pos"), F.col("l_quantity").alias("score")).where("next is not null")
    at = lambda c: F.concat(F.lit("https://x.test/"), F.col(c).cast("string"))
    other = part.select(F.col("key").alias("next"), F.col("site").alias("next_site"))
    links = line.join(part, "key").join(other, "next").where("site = next_site").select("site", at("key").alias("url"), at("next").alias("href"), "pos", "score")
    seeds = part.groupBy("site").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    seeds = seeds.select("site", F.posexplode(F.array("a", "b")).alias("seq", "key")).select("site", at("key").alias("url"), (100.0 - F.col("seq")).alias("score"), "seq")
    return seeds, links, part.select("site", at("key").alias("url_key"))


_GRAPH = """p AS (SELECT p_partkey AS key, p_brand AS site FROM part), n AS (SELECT l_partkey AS key, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS next, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + l_quantity::BIGINT AS pos, l_quantity AS score FROM lineitem),
 g AS MATERIALIZED (SELECT p.site, n.key, next, pos, score FROM n JOIN p ON p.key = n.key JOIN p AS o ON o.key = next AND o.site = p.site),
 f AS MATERIALIZED (SELECT site, unnest([min(key), max(key)]) AS key, unnest([0, 1]) AS seq FROM p GROUP BY site)"""


def part_levels(spark, d):
    """Parts of each brand that links reach from its first and last one, level by level."""
    seeds, links, known = _part_graph(spark, d)
    rules = spark.createDataFrame([], "site string, seq int, allow boolean, path string")
    found = crawling.reach(seeds, links, known, rules, 3)
    return found.groupBy("site", "depth").agg(F.count("*").alias("n"), F.sum(F.substring_index("url", "/", -1).cast("long")).alias("keys"))


PART_LEVELS = f"""WITH RECURSIVE {_GRAPH}, w AS (SELECT site, key, 0 AS depth FROM f UNION SELECT g.site, g.next, depth + 1 FROM w JOIN g ON g.site = w.site AND g.key = w.key WHERE depth < 3),
 m AS (SELECT site, key, min(depth)::INT AS depth FROM w GROUP BY ALL) SELECT site, depth, count(*) AS n, sum(key)::BIGINT AS keys FROM m GROUP BY ALL"""


def part_tour(spark, d):
    """The order in which a best-first crawl visits each brand's parts."""
    return crawling.best_first(*_part_graph(spark, d), most=40).select("site", "turn", F.substring_index("url", "/", -1).cast("long").alias("part"), "depth")


#: A queue in lists: each step takes the best entry that was not seen and adds what its page links to.
PART_TOUR = f"""WITH RECURSIVE {_GRAPH}, o AS (SELECT site, key, next, arg_min(score, pos) AS score, min(pos) AS pos FROM g GROUP BY ALL),
 l AS (SELECT site, key, list(struct_pack(u := next, s := score) ORDER BY pos) AS out FROM o GROUP BY ALL),
 q AS (SELECT site, 0 AS n, 2 AS turns, []::BIGINT[] AS seen, list(struct_pack(s := seq - 100.0::DOUBLE, t := seq::BIGINT, u := key, d := 0) ORDER BY seq) AS held, NULL::STRUCT(s DOUBLE, t BIGINT, u BIGINT, d INTEGER) AS best FROM f GROUP BY site
  UNION ALL SELECT site, n + 1, turns + len(more), list_append(seen, best.u), list_concat(rest, list_transform(more, lambda x, i: struct_pack(s := -(x.s - best.s / 100), t := (turns + i)::BIGINT, u := x.u, d := best.d + 1))), best
  FROM (SELECT b.*, list_filter(CASE WHEN best.d < 7 THEN coalesce(out, []) ELSE [] END, lambda x: x.u <> best.u AND NOT list_contains(seen, x.u)) AS more FROM
        (SELECT site, n, turns, seen, list_filter(held, lambda x: NOT list_contains(seen, x.u)) AS rest, list_min(list_filter(held, lambda x: NOT list_contains(seen, x.u))) AS best FROM q WHERE n < 40) b LEFT JOIN l ON l.site = b.site AND l.key = best.u) c
  WHERE best IS NOT NULL)
SELECT site, (n - 1)::BIGINT AS turn, best.u AS part, best.d::BIGINT AS depth FROM q WHERE n > 0"""


def nested_site_maps(spark, d):
    """Seeds that site maps over parts give: a site's own map, then those of its index, 80 urls in all."""
    part = table(spark, d, "part").select((F.col("p_size") % 10).cast("string").alias("s"), F.regexp_replace("p_brand", "#", "-").alias("brand"), "p_partkey")
    origin = F.concat(F.lit("https://m"), F.col("s"), F.lit(".test"))
    locs = lambda c, of: F.array_join(F.transform(F.array_sort(F.collect_list(c)), of), "")
    page = lambda k: F.concat(F.lit("<url><loc> "), F.first("o"), F.lit("/p"), k.cast("string"), F.lit("</loc></url>"))
    part = part.withColumn("o", origin)
    nested = part.groupBy("s", "brand").agg(F.first("o").alias("origin"), locs("p_partkey", page).alias("xml")).select("s", "origin", F.concat("origin", F.lit("/maps/Sitemap-"), "brand", F.lit(".xml")).alias("url"), "xml")
    named = lambda b: F.concat(F.lit("<loc>"), F.first("o"), F.lit("/maps/Sitemap-"), b, F.lit(".xml</loc><loc>"), F.first("o"), F.lit("/x.xml</loc>"))
    index = part.select("s", "o", "brand").distinct().groupBy("s").agg(F.first("o").alias("origin"), locs("brand", named).alias("xml")).select("s", "origin", F.concat("origin", F.lit("/sitemap_index.xml")).alias("url"), "xml")
    own = part.where("p_partkey % 5 = 0").groupBy("s").agg(F.first("o").alias("origin"), locs("p_partkey", page).alias("xml")).select("s", "origin", F.concat("origin", F.lit("/sitemap.xml")).alias("url"), "xml")
    files = nested.unionByName(index).unionByName(own).withColumnRenamed("s", "site")
    return crawling.sitemap_urls(crawling.site_map_files(files))


NESTED_SITE_MAPS = """WITH p AS (SELECT (p_size % 10)::VARCHAR AS s, replace(p_brand, '#', '-') AS brand, p_partkey AS k, 'https://m' || (p_size % 10) || '.test' AS o FROM part),
 b AS (SELECT s, brand, row_number() OVER (PARTITION BY s ORDER BY brand) AS f FROM (SELECT DISTINCT s, brand FROM p)),
 u AS (SELECT s, o || '/p' || k AS url, 0 AS f, k FROM p WHERE k % 5 = 0 UNION ALL SELECT s, o || '/p' || k, f, k FROM p JOIN b USING (s, brand)),
 x AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY s, url ORDER BY f, k) = 1)
SELECT s AS site, url, row_number() OVER (PARTITION BY s ORDER BY f, k)::INT AS n FROM x QUALIFY n <= 80"""


NAMES = (
    "site_primary_phone", "phone_candidates", "email_candidates", "visible_text_stats", "page_titles", "longest_title", "most_common_value", "url_forms", "page_links", "exact_texts", "exact_links", "thin_pages", "seed_union",
    "site_verify_score", "verify_urls", "term_scores", "corpus_text", "first_rows_win", "csv_escape", "crawl_reach", "part_levels", "part_tour", "nested_site_maps",
)
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
