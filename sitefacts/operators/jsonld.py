"""Structured data in pages, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.functions import checks, vocab
from sitefacts.functions.rx import blank, first_wins, has, trim
from sitefacts.sources.shared import cut

_SCRIPT = r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""


def scripts(pages: DataFrame) -> DataFrame:
    """``site, page_seq, script_no, body`` of every structured-data script."""
    return pages.select("site", "page_seq", F.posexplode(F.regexp_extract_all("html", F.lit(_SCRIPT), F.lit(1))).alias("script_no", "body"))


def nodes(bodies: DataFrame) -> DataFrame:
    """``site, page_seq, script_no, at, node``: roots with arrays opened and graphs in place of what holds them, at any depth.

    Each round opens what the round before gave; the rounds end when nothing opens any more. Bad JSON gives no node.
    """
    rows = bodies.select("site", "page_seq", "script_no", F.expr("cast(array() as array<int>)").alias("at"), F.try_parse_json("body").alias("node")).where("node is not null")
    graph = "try_variant_get(node, '$[\"@graph\"]', 'variant')"
    parts = F.expr(f"coalesce(try_variant_get(node, '$', 'array<variant>'), try_variant_get(node, '$[\"@graph\"]', 'array<variant>'), if({graph} is null, null, array({graph})))")
    done = None
    while True:
        rows = cut(rows.withColumn("parts", parts))
        whole = rows.where("parts is null").drop("parts")
        done = whole if done is None else done.unionByName(whole)
        rows = rows.where("parts is not null")
        if rows.isEmpty():
            return done
        rows = rows.select("site", "page_seq", "script_no", "at", F.posexplode("parts").alias("i", "node")).withColumn("at", F.array_append("at", F.col("i"))).drop("i")


def text_at(path: str, node: str = "node"):
    """The string at a path; null if there is none or it is of another kind."""
    return F.expr(f"""case when schema_of_variant(try_variant_get({node}, '{path}', 'variant')) = 'STRING' then try_variant_get({node}, '{path}', 'string') end""")


def texts_at(path: str, node: str = "node"):
    """The strings at a path: one, or those of an array."""
    many = F.expr(f"filter(transform(try_variant_get({node}, '{path}', 'array<variant>'), x -> case when schema_of_variant(x) = 'STRING' then cast(x as string) end), x -> x is not null)")
    one = text_at(path, node)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.expr("cast(array() as array<string>)"))


def of_type(names: tuple[str, ...]):
    return F.exists(texts_at('$["@type"]'), lambda t: t.isin(*names))


def address():
    """A plain address, or its parts with commas between."""
    parts = [F.nullif(F.coalesce(text_at(f"$.address.{p}"), F.lit("")), F.lit("")) for p in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
    return F.coalesce(text_at("$.address"), F.concat_ws(", ", *parts))


def lodging(found: DataFrame) -> DataFrame:
    """``site, page_seq, script_no, at, name, phones, emails, address`` of lodging nodes."""
    return found.where(of_type(vocab.LODGING_TYPES)).select("site", "page_seq", "script_no", "at", trim(F.coalesce(text_at("$.name"), F.lit(""))).alias("name"), texts_at("$.telephone").alias("phones"), texts_at("$.email").alias("emails"), address().alias("address"))


def hints(found: DataFrame) -> DataFrame:
    """``site, name, phone, email, address``: the first of each that a site's lodging nodes give."""
    rows = lodging(found).withColumn("o", F.struct("page_seq", "script_no", "at"))
    first = lambda value: F.coalesce(F.min_by(F.nullif(value, F.lit("")), F.when(value != "", F.col("o"))), F.lit(""))
    head = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return rows.groupBy("site").agg(first(F.col("name")).alias("name"), first(head("phones")).alias("phone"), checks.clean_email(first(head("emails"))).alias("email"), first(F.col("address")).alias("address"))


def _hours():
    spec = F.expr(
        "transform(try_variant_get(node, '$.openingHoursSpecification', 'array<variant>'), x -> case when schema_of_variant(x) = 'STRING' then cast(x as string) else concat_ws(' ', "
        "coalesce(concat_ws(' ', try_variant_get(x, '$.dayOfWeek', 'array<string>')), try_variant_get(x, '$.dayOfWeek', 'string')), try_variant_get(x, '$.opens', 'string'), try_variant_get(x, '$.closes', 'string')) end)"
    )
    listed = F.coalesce(F.expr("try_variant_get(node, '$.openingHours', 'array<string>')"), spec)
    said = F.coalesce(text_at("$.openingHours"), F.array_join(F.filter(listed, lambda x: x != ""), " | "), text_at("$.openingHoursSpecification"), F.lit(""))
    return checks.hours(said)


def _menu(name: str):
    each = F.expr(f"transform(try_variant_get(node, '$.{name}', 'array<variant>'), x -> case when schema_of_variant(x) = 'STRING' then cast(x as string) else try_variant_get(x, '$.name', 'string') end)")
    one = F.coalesce(text_at(f"$.{name}"), text_at(f"$.{name}.name"))
    return F.filter(F.coalesce(each, F.array(one)), lambda x: F.coalesce(trim(x), F.lit("")) != "")


def venues(found: DataFrame) -> DataFrame:
    """``site, dining``: named venues of a site's food nodes, one for each name, generic names left out."""
    rows = found.where(of_type(vocab.FOOD_TYPES)).select("site", "page_seq", "script_no", "at", trim(F.coalesce(text_at("$.name"), F.lit(""))).alias("name"), _hours().alias("hours"), F.slice(F.when(F.size(_menu("menu")) > 0, _menu("menu")).otherwise(_menu("hasMenu")), 1, vocab.MAX_VENUES).alias("menu_items"))
    rows = rows.where(~blank(F.col("name")) & ~has(F.col("name"), vocab.GENERIC_VENUE))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "script_no", "at", "name", "hours", "menu_items"))), lambda x: F.struct(x["name"].alias("restaurant_name"), x["hours"], x["menu_items"]))
    return rows.groupBy("site").agg(listed.alias("dining")).select("site", first_wins(F.col("dining"), lambda v: F.lower(v["restaurant_name"]), vocab.MAX_VENUES).alias("dining"))
