"""Reviews of records: validation, merge with the extracted data, provenance and what is served."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.functions import checks, urls, vocab
from sitefacts.functions.rx import blank, first_wins, key, trim
from sitefacts.operators.blocks import policy_answer

# What a reviewer is told.
BAD_PHONE = "Use a 10-digit phone number, optionally with +1, spaces, dashes, or parentheses."
BAD_EMAIL = "Use a standard email address like frontdesk@example.com."
BAD_ADDRESS = "Default address check expects a street address and ZIP code."
BAD_CHECK_IN, BAD_CHECK_OUT = "Use a recognizable time like 3:00 PM.", "Use a recognizable time like 11:00 AM."

#: Paths whose origin is recorded, in order.
TRACKED = (
    "hotel_name", "contact.phone", "contact.email", "contact.address", "contact.phones", "contact.addresses", *(f"amenities.{a}" for a in vocab.AMENITIES),
    "dining", "services", "room_types", "images", *(f"policies.{p}" for p, _ in vocab.POLICIES),
)


def issues(records: DataFrame) -> DataFrame:
    """``site_id, seq, field, severity, message`` of every implausible value of ``site_id, data``."""
    d = F.col("data")

    def one(ok, field, message, severity="error"):
        return F.when(~ok, F.array(F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))).otherwise(F.array())

    def many(values, ok, field, message):
        marked = F.transform(F.coalesce(values, F.array()), lambda v, i: F.struct(ok(v).alias("ok"), F.concat(F.lit(f"{field}."), i.cast("string")).alias("field"), F.lit("error").alias("severity"), F.format_string(message, i + 1).alias("message")))
        return F.transform(F.filter(marked, lambda x: ~x["ok"]), lambda x: F.struct(x["field"], x["severity"], x["message"]))

    c = d["contact"]
    each = F.concat(
        one(checks.phone(c["phone"]), "contact.phone", BAD_PHONE),
        many(c["phones"], lambda v: checks.phone(v["value"]), "contact.phones", "Additional phone %d must use a valid 10-digit phone format."),
        one(checks.email(c["email"]), "contact.email", BAD_EMAIL),
        one(checks.address(c["address"]), "contact.address", BAD_ADDRESS),
        many(c["addresses"], lambda v: checks.address(v["value"]), "contact.addresses", "Additional address %d must include a street address and ZIP code."),
        one(checks.time(d["policies"]["check_in"]), "policies.check_in", BAD_CHECK_IN, "warning"),
        one(checks.time(d["policies"]["check_out"]), "policies.check_out", BAD_CHECK_OUT, "warning"),
        many(d["images"], urls.plausible, "images", "Image %d must be an http(s) URL."),
    )
    return records.select("site_id", F.posexplode(each).alias("seq", "x")).select("site_id", "seq", "x.*")


def without_errors(submissions: DataFrame) -> DataFrame:
    """Submissions none of whose issues is an error."""
    return submissions.join(issues(submissions).where("severity = 'error'").select("site_id").distinct(), "site_id", "left_anti")


def issues_of(issues_: DataFrame, paths: list[str]) -> DataFrame:
    """``path, field, severity``: the issues at or below each of the form's field paths."""
    below = (F.col("field") == F.col("path")) | F.expr("startswith(field, path || '.')")
    return issues_.select("field", "severity", F.explode(F.array(*map(F.lit, paths))).alias("path")).where(below).select("path", "field", "severity")


def merged_contacts(primary, staff, default: str, by_digits: bool):
    """The primary value first, then the reviewer's entries, one for each digits (or text where there are none)."""
    low = lambda c: F.lower(trim(c["value"]))
    name = (lambda c: F.when(checks.digits(low(c)) != "", checks.digits(low(c))).otherwise(low(c))) if by_digits else low
    both = F.concat(F.array(F.struct(F.lit("Primary").alias("label"), primary.alias("value"), F.lit("").alias("note"))), F.coalesce(staff, F.array()))
    kept = first_wins(F.filter(both, lambda c: ~blank(c["value"])), name)
    return F.transform(kept, lambda c: F.struct(F.when(blank(c["label"]), default).otherwise(trim(c["label"])).alias("label"), trim(c["value"]).alias("value"), trim(c["note"]).alias("note")))


def trimmed_list(values):
    return F.filter(F.transform(values, trim), lambda x: x != "")


def _image_key(url):
    return F.when(urls.part(url, "HOST").isNull(), key(url)).otherwise(urls.image_key(url))


def merge(scraped: DataFrame, staff: DataFrame) -> DataFrame:
    """``site_id, scraped, data``: the reviewer's record over the extracted one, both ``site_id, data``."""
    both = scraped.withColumnRenamed("data", "a").join(staff.select("site_id", F.col("data").alias("b")), "site_id")
    a, b = F.col("a"), F.col("b")
    phone = checks.normal_phone(checks.pick(b["contact"]["phone"], a["contact"]["phone"]))
    address = checks.pick(b["contact"]["address"], a["contact"]["address"])
    pa, pb = a["policies"], b["policies"]
    time = lambda f: F.when(blank(pb[f]), checks.normal_time(pa[f])).otherwise(trim(pb[f])).alias(f)
    answer = lambda kind: F.when(blank(pb[f"{kind}_policy"]), policy_answer(kind, pa[f"{kind}_policy"])).otherwise(trim(pb[f"{kind}_policy"])).alias(f"{kind}_policy")
    own = F.coalesce(b["metadata"]["image_details"], F.array())
    details = first_wins(F.when(F.size(own) > 0, own).otherwise(F.coalesce(a["metadata"]["image_details"], F.array())), lambda x: _image_key(x["url"]))
    data = F.struct(
        checks.pick(b["hotel_name"], a["hotel_name"]).alias("hotel_name"),
        F.when(a["website"] != "", a["website"]).otherwise(b["website"]).alias("website"),
        F.struct(
            phone.alias("phone"), checks.pick(b["contact"]["email"], a["contact"]["email"]).alias("email"), address.alias("address"),
            merged_contacts(phone, b["contact"]["phones"], "Contact", True).alias("phones"), merged_contacts(address, b["contact"]["addresses"], "Address", False).alias("addresses"),
        ).alias("contact"),
        b["amenities"].alias("amenities"), b["dining"].alias("dining"), trimmed_list(b["services"]).alias("services"),
        F.struct(time("check_in"), time("check_out"), answer("pet"), answer("cancellation"), answer("smoking")).alias("policies"),
        trimmed_list(b["room_types"]).alias("room_types"), first_wins(trimmed_list(b["images"]), _image_key).alias("images"),
        F.struct(a["metadata"]["scrape_timestamp"].alias("scrape_timestamp"), a["metadata"]["source_pages"].alias("source_pages"), details.alias("image_details"), F.coalesce(b["metadata"]["image_probe"], a["metadata"]["image_probe"]).alias("image_probe")).alias("metadata"),
    )
    return both.select("site_id", a.alias("scraped"), data.alias("data"))


def provenance(merged: DataFrame) -> DataFrame:
    """``site_id, path_no, path, value, source``: values as JSON; equal to the extracted one, or the reviewer's."""

    def entry(path):
        top, _, leaf = path.partition(".")
        of = lambda c: F.to_json(F.struct((F.col(c)[top][leaf] if leaf else F.col(c)[top]).alias("v")), {"ignoreNullFields": "false"})
        return F.struct(F.lit(path).alias("path"), of("data").alias("value"), F.when(of("data").eqNullSafe(of("scraped")), "scraper").otherwise("hotel_staff").alias("source"))

    last = F.struct(F.lit("metadata").alias("path"), F.to_json(F.struct(F.col("data")["metadata"].alias("v")), {"ignoreNullFields": "false"}).alias("value"), F.lit("merged").alias("source"))
    return merged.select("site_id", F.posexplode(F.array(*map(entry, TRACKED), last)).alias("path_no", "x")).select("site_id", "path_no", "x.*")


def first_submissions(rows: DataFrame, by: str = "site_id", order: tuple[str, ...] = ("submitted_at",)) -> DataFrame:
    """The first row of each ``by``: one aggregate, whose partial step leaves a row for each key and task."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(by).agg(first.alias("x")).select("x.*")


def served(sites: DataFrame, needs_completed: bool = True) -> DataFrame:
    """Appends ``served``: the reviewed record where there is one (and, for the dashboard, the review is completed), else the extracted one."""
    final = F.col("normalized").isNotNull()
    return sites.withColumn("served", F.when(final & (F.col("status") == "completed") if needs_completed else final, F.col("normalized")).otherwise(F.col("scraped")))


def with_token(sites: DataFrame, requests: DataFrame, token: str = "review_token") -> DataFrame:
    """Requests ``site_id, token`` that hold the site's own token; a site without one answers none."""
    return requests.join(sites.select("site_id", F.col(token).alias("token")).where(F.col("token").isNotNull()), ["site_id", "token"], "left_semi")


def intake(sites: DataFrame, salt: str) -> DataFrame:
    """New site rows with status and tokens; tokens come from id and salt, so a rerun makes the same."""
    token = lambda kind: F.left(F.sha2(F.concat_ws(":", F.lit(salt), F.lit(kind), "site_id"), 256), F.lit(48))
    return sites.withColumn("status", F.lit("pending_review")).withColumn("review_token", token("review")).withColumn("operator_token", token("operator"))


def complete(sites: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Sites with the reviewed record and status ``completed`` where ``site_id, normalized`` has one and none was there before."""
    new = reviewed.select("site_id", F.col("normalized").alias("__new"))
    take = F.col("__new").isNotNull() & (F.col("status") != "completed")
    out = sites.join(new, "site_id", "left").withColumn("normalized", F.when(take, F.col("__new")).otherwise(F.col("normalized")))
    return out.withColumn("status", F.when(take, "completed").otherwise(F.col("status"))).select(*sites.columns)


def form_record(dining):
    """Venues for a form: one empty venue where there is none."""
    empty = F.struct(F.lit("").alias("restaurant_name"), F.lit("").alias("hours"), F.expr("cast(array() as array<string>)").alias("menu_items"))
    return F.when(F.size(dining) > 0, dining).otherwise(F.array(empty))


def submitted_dining(dining):
    """Venues of a form without those that are all blank, lists trimmed."""
    clean = F.transform(dining, lambda v: F.struct(v["restaurant_name"], v["hours"], trimmed_list(v["menu_items"]).alias("menu_items")))
    return F.filter(clean, lambda v: ~blank(v["restaurant_name"]) | ~blank(v["hours"]) | (F.size(v["menu_items"]) > 0))


def presence(on, completed):
    return F.when(on, "Present").when(completed, "Not present").otherwise("Not found")


def bodies(requests: DataFrame, schema: str) -> DataFrame:
    """Appends ``body``, JSON text read by ``schema``: what is missing or of another kind is null, and so is text that is no JSON."""
    return requests.withColumn("body", F.from_json("text", schema))
