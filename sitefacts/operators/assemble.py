"""Whole records of sites, from page texts and structured data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.functions import checks, urls, vocab
from sitefacts.functions.rx import blank, first_wins
from sitefacts.operators import blocks, contacts, crawling, facts, images, jsonld, pages
from sitefacts.sources.demo import RECORD
from sitefacts.sources.shared import cut


def crawled(parsed: DataFrame) -> DataFrame:
    """The pages that a crawl of each site would read, ``page_seq`` in its order; ``parsed`` pages of whole sites are given.

    It begins at a site's first page, knows the first ``MAX_SITEMAP`` others as a site map would name them, and goes on best
    first along the links, ``MAX_PAGES`` pages in all.
    """
    keyed = parsed.withColumn("k", urls.url_key(F.col("url")))
    place = F.row_number().over(Window.partitionBy("site").orderBy("page_seq"))
    mapped = keyed.groupBy("site", "k").agg(F.min("page_seq").alias("page_seq"), F.min_by("url", "page_seq").alias("url")).withColumn("n", place)
    sites = mapped.where("n = 1").select("site", F.col("url").alias("start"))
    seeds = pages.seeds(sites, mapped.where((F.col("n") > 1) & (F.col("n") <= vocab.MAX_SITEMAP + 1)).select("site", "url", "n"))
    links = pages.parsed_links(parsed).withColumn("url", urls.url_key(F.col("url")))
    order = crawling.best_first(seeds, links, mapped.select("site", F.col("k").alias("url_key")))
    chosen = order.join(mapped.select("site", F.col("k").alias("url"), F.col("page_seq")), ["site", "url"]).select("site", "page_seq", "turn")
    return parsed.join(chosen, ["site", "page_seq"]).withColumn("page_seq", F.col("turn")).drop("turn")


def extract(site_pages: DataFrame, as_of: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``site_id, data`` and ``site_id, path, confidence`` of ``site, page_seq, url, html``.

    Pages are parsed once; of a site, those count that a crawl would read. Page-level work is done page by page; a site's own
    row then holds one text, that of these pages. With ``files`` (``url, content``) the first images of each record are probed.
    """
    parsed = cut(crawled(cut(pages.parsed(_spread(site_pages)))))
    texts = parsed.select("site", "page_seq", "text")
    titled = parsed.select("site", "page_seq", "title", "og_title", "og_site_name")
    found = jsonld.nodes(parsed.select("site", "page_seq", F.posexplode("scripts").alias("script_no", "body")))
    hints = jsonld.hints(found)
    names = pages.site_names(titled, hints.select("site", "name"))
    text = pages.corpus(texts)
    phones = contacts.phones(texts).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("n", "label", "value"))).alias("phones"))
    addresses = contacts.addresses(texts).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("n", "label", "value"))).alias("addresses"))
    photos = cut(images.site_images(images.assets(images.of_parsed(parsed))))
    shots = photos.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("n", "url", "alt", "caption", "category"))).alias("photos"))
    probes = _probes(photos, files)
    listed = parsed.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("page_seq", "url"))).alias("listed"), F.collect_set("title").alias("titles"))
    rows = text.join(names, "site").join(listed, "site").join(hints.select("site", F.col("phone").alias("ld_phone"), F.col("email").alias("ld_email"), F.col("address").alias("ld_address")), "site", "left")
    rows = rows.join(phones, "site", "left").join(addresses, "site", "left").join(contacts.best_email(texts).withColumnRenamed("confidence", "email_sure"), "site", "left").join(shots, "site", "left").join(jsonld.venues(found), "site", "left").join(probes, "site", "left")
    rows = rows.fillna("", ["ld_phone", "ld_email", "ld_address", "email"])
    t = F.col("text")
    # The patterns over a site's text take long for few bytes, so rows are dealt to all tasks, not joined by their size.
    rows = rows.repartition(int(site_pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "site")
    rows = cut(rows.select(
        "*", facts.amenity_scores(t).alias("scores"), facts.services(t).alias("services"), facts.rooms(t).alias("rooms"), facts.check_in(t).alias("check_in"), facts.check_out(t).alias("check_out"), blocks.pet_policy(t).alias("pet"),
        blocks.policy_block(t, vocab.CANCEL_LABEL, vocab.CANCEL_SIGNAL).alias("cancellation"), blocks.policy_block(t, vocab.SMOKE_LABEL, vocab.SMOKE_SIGNAL).alias("smoking"), blocks.venues(t, F.col("titles")).alias("venues"),
    ))

    def contact(column, structured, ok, what, by_digits):
        own = F.coalesce(F.transform(F.col(column), lambda x: F.struct(x["label"], x["value"], F.lit("").alias("note"))), F.expr("cast(array() as array<struct<label:string,value:string,note:string>>)"))
        good = (F.col(structured) != "") & ok(F.col(structured))
        head = F.when(good, F.array(F.struct(F.lit(f"Structured-data {what}").alias("label"), F.col(structured).alias("value"), F.lit("").alias("note")))).otherwise(F.slice(own, 1, 0))
        all_ = first_wins(F.concat(head, own), lambda c: checks.digits(c["value"]) if by_digits else F.lower(c["value"]))
        return good, own, all_

    phone_ok, phone_own, phone_all = contact("phones", "ld_phone", checks.phone, "phone", True)
    place_ok, place_own, place_all = contact("addresses", "ld_address", checks.address, "address", False)
    first = lambda own: F.coalesce(F.get(own, F.lit(0))["value"], F.lit(""))
    phone = F.when(phone_ok, F.col("ld_phone")).otherwise(first(phone_own))
    place = F.when(place_ok, F.col("ld_address")).otherwise(first(place_own))
    email = F.when(F.col("ld_email") != "", F.col("ld_email")).otherwise(F.col("email"))
    dining = blocks.merged_venues(F.coalesce(F.col("dining"), F.slice(F.col("venues"), 1, 0)), F.col("venues"))
    shots_ = F.coalesce(F.col("photos"), F.expr("cast(array() as array<struct<n:int,url:string,alt:string,caption:string,category:string>>)"))
    data = F.struct(
        F.col("name").alias("hotel_name"), F.get(F.col("listed"), F.lit(0))["url"].alias("website"),
        F.struct(phone.alias("phone"), email.alias("email"), place.alias("address"), phone_all.alias("phones"), place_all.alias("addresses")).alias("contact"),
        F.struct(*((F.element_at("scores", a) >= facts.PRESENT).alias(a) for a in vocab.AMENITIES)).alias("amenities"),
        dining.alias("dining"), F.col("services"),
        F.struct("check_in", "check_out", F.col("pet.value").alias("pet_policy"), F.col("cancellation.value").alias("cancellation_policy"), F.col("smoking.value").alias("smoking_policy")).alias("policies"),
        F.col("rooms").alias("room_types"), F.transform(shots_, lambda x: x["url"]).alias("images"),
        F.struct(F.lit(as_of).alias("scrape_timestamp"), F.transform("listed", lambda x: x["url"]).alias("source_pages"), F.transform(shots_, lambda x: F.struct(x["url"], x["alt"], x["caption"], x["category"])).alias("image_details"), F.col("probes").alias("image_probe")).alias("metadata"),
    )
    sure = {
        "hotel_name": F.col("confidence"),
        "contact.phone": F.when(phone_ok, 0.9).when(blank(phone), 0.0).when(phone.rlike(r"[().\-\s]"), 0.82).otherwise(0.72),
        "contact.email": F.when(F.col("ld_email") != "", 0.9).otherwise(F.coalesce("email_sure", F.lit(0.0))),
        "contact.address": F.when(place_ok, 0.88).when(blank(place), 0.0).otherwise(0.68),
        **{f"amenities.{a}": F.element_at("scores", a) for a in vocab.AMENITIES},
        "dining": F.when(F.size(F.coalesce("dining", F.slice("venues", 1, 0))) > 0, 0.88).when(F.size("venues") > 0, 0.55).otherwise(0.0),
        "services": F.when(F.size("services") > 0, 0.55).otherwise(0.0),
        "policies.check_in": F.when(blank(F.col("check_in")), 0.0).otherwise(0.55),
        "policies.check_out": F.when(blank(F.col("check_out")), 0.0).otherwise(0.55),
        "policies.pet_policy": F.col("pet.confidence"),
        "policies.cancellation_policy": F.col("cancellation.confidence"),
        "policies.smoking_policy": F.col("smoking.confidence"),
        "room_types": F.when(F.size("rooms") > 0, 0.5).otherwise(0.0),
        "images": F.when(F.size(shots_) > 0, 0.65).otherwise(0.0),
    }
    records = rows.select(F.col("site").alias("site_id"), data.alias("data")).to(_schema())
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), c.alias("confidence")) for p, c in sure.items()))
    return records, rows.select(F.col("site").alias("site_id"), F.inline(pairs))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer splits than there are cores, dealt to all: reading markup takes long for few bytes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def _probes(photos: DataFrame, files: DataFrame | None) -> DataFrame:
    """``site, probes``: what the heads of each site's first images tell; a file that is not there is unreadable."""
    if files is None:
        return photos.limit(0).groupBy("site").agg(F.lit(None).alias("probes"))
    asked = photos.where(F.col("n") <= images.PROBED).select("site", "n", "url").join(files.select("url", "content"), "url", "left")
    found = F.struct("n", "url", "bytes", "format", "width", "height", "error")
    told = images.probe(asked).groupBy("site").agg(F.array_sort(F.collect_list(found)).alias("x"))
    return told.select("site", F.transform("x", lambda p: F.struct(*(p[c].alias(c) for c in ("url", "bytes", "format", "width", "height", "error")))).alias("probes"))


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(f"site_id string, data {RECORD}")
