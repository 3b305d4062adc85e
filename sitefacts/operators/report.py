"""Reports of records: long-form rows, summaries, CSV and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.functions import checks, vocab
from sitefacts.functions.rx import blank, trim
from sitefacts.operators import gaps as gaps_

# The document's version, its columns, and the sentences and labels in the functions below.
VERSION = "2.0"
COLUMNS = ("section", "field_key", "label", "value", "status", "source", "scrape_gap_notes")


def display(value):
    """Null as blank, booleans as Yes and No."""
    return F.coalesce(F.when(value.cast("string") == "true", "Yes").when(value.cast("string") == "false", "No").otherwise(value.cast("string")), F.lit(""))


def _status(value):
    return F.when(blank(value), "empty").otherwise("filled")


def _row(section, field, label, value, status, source_key=None, notes=None):
    lit = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    return F.struct(
        lit(section).alias("section"), lit(field).alias("field_key"), lit(label).alias("label"), lit(value).alias("value"), lit(status).alias("status"),
        lit(source_key).cast("string").alias("source_key"), lit(notes).cast("string").alias("notes"),
    )


def _missing(pairs):
    """Names whose value is blank."""
    return F.filter(F.array(*(F.when(blank(v), F.lit(n)) for n, v in pairs)), lambda x: x.isNotNull())


def _amenities(d, on: bool):
    return F.filter(F.array(*(F.when(d["amenities"][a] if on else ~d["amenities"][a], F.lit(label)) for a, (_, _, label) in vocab.AMENITIES.items())), lambda x: x.isNotNull())


def contact_summary(d):
    c = d["contact"]
    filled = reduce(lambda x, y: x + y, (F.when(blank(c[f]), 0).otherwise(1) for f in ("phone", "email", "address")))
    more = lambda f: F.greatest(F.lit(0), F.size(F.coalesce(c[f], F.array())) - 1)
    said = F.format_string("%d of 3 primary contact slots have text. %d additional phone(s), %d additional address(es).", filled, more("phones"), more("addresses"))
    return F.when(filled == 0, "No contact details captured.").otherwise(said)


def amenity_summary(d):
    on, off = F.array_join(_amenities(d, True), ", "), F.array_join(_amenities(d, False), ", ")
    some = F.concat(F.lit("Available: "), on, F.lit(". Not offered or unchecked: "), F.when(off == "", "none").otherwise(off), F.lit("."))
    return F.when(on == "", F.concat(F.lit("No amenity toggles are on. Not offered or unchecked: "), off, F.lit("."))).otherwise(some)


def policy_missing(d):
    return _missing([(label, d["policies"][p]) for p, label in vocab.POLICIES])


def dining_summary(d):
    n = F.size(d["dining"])
    return F.when(n == 0, "No dining venues captured.").otherwise(F.format_string("%d dining entr%s.", n, F.when(n == 1, "y").otherwise("ies")))


def summaries(d) -> dict:
    """One sentence for each category."""
    gone = F.array_join(policy_missing(d), ", ")
    return {
        "contact": contact_summary(d),
        "amenities": amenity_summary(d),
        "services": F.when(F.size(d["services"]) == 0, "No services list captured.").otherwise(F.array_join(d["services"], "; ")),
        "policies": F.when(gone == "", "All policy slots have text.").otherwise(F.concat(F.lit("Missing: "), gone, F.lit("."))),
        "rooms": F.when(F.size(d["room_types"]) == 0, "No room types captured.").otherwise(F.format_string("%d room type line(s).", F.size(d["room_types"]))),
        "dining": dining_summary(d),
    }


def _contacts(d, field, name, section):
    told = lambda c: F.concat(c["value"], F.when(c["note"] != "", F.concat(F.lit(" ("), c["note"], F.lit(")"))).otherwise(""))

    def one(c, i):
        number = (i + 1).cast("string")
        label = F.when(c["label"] != "", c["label"]).otherwise(F.concat(F.lit(f"{name} "), number))
        return _row(section, F.concat(F.lit(f"contact.{field}["), i.cast("string"), F.lit("]")), label, told(c), _status(c["value"]), f"contact.{field}")

    return F.transform(F.coalesce(d["contact"][field], F.array()), one)


def categories(d) -> list[tuple]:
    """``id, title, missing, rows`` of the five categories; each is an array column."""
    c, said = d["contact"], (("Phone", "phone"), ("Email", "email"), ("Address", "address"))
    listed = lambda f: F.array_join(d[f], "\n")
    some = lambda f: F.when(F.size(d[f]) > 0, "filled").otherwise("empty")
    none = F.expr("cast(array() as array<string>)")
    lacks = lambda f, name: F.when(F.size(d[f]) > 0, none).otherwise(F.array(F.lit(name)))
    return [
        ("contact", "Contact", _missing([(label, c[f]) for label, f in said]), F.concat(F.array(*(_row("Contact", f"contact.{f}", label, c[f], _status(c[f]), f"contact.{f}") for label, f in said)), _contacts(d, "phones", "Phone", "Contact"), _contacts(d, "addresses", "Address", "Contact"))),
        ("amenities", "Amenities", none, F.array(*(_row("Amenities", f"amenities.{a}", label, display(d["amenities"][a]), "filled", f"amenities.{a}") for a, (_, _, label) in vocab.AMENITIES.items()))),
        ("services", "Services", lacks("services", "Entire services list"), F.array(_row("Services", "services", "Services (combined)", listed("services"), some("services"), "services"))),
        ("policies", "Policies", policy_missing(d), F.array(*(_row("Policies", f"policies.{p}", label, d["policies"][p], _status(d["policies"][p]), f"policies.{p}") for p, label in vocab.POLICIES))),
        ("rooms", "Room types", lacks("room_types", "Room types"), F.array(_row("Room types", "room_types", "Room types (combined)", listed("room_types"), some("room_types"), "room_types"))),
    ]


def field_rows(records: DataFrame) -> DataFrame:
    """``site_id, category, seq, section, field_key, label, value, status`` of the five categories."""
    d = F.col("data")
    parts = [records.select("site_id", F.lit(name).alias("category"), F.posexplode(rows).alias("seq", "x")).select("site_id", "category", "seq", "x.section", "x.field_key", "x.label", "x.value", "x.status") for name, _, _, rows in categories(d)]
    return reduce(DataFrame.unionByName, parts)


def summary_rows(records: DataFrame) -> DataFrame:
    """``site_id, category, summary, missing``."""
    d = F.col("data")
    gone = {name: missing for name, _, missing, _ in categories(d)}
    pairs = [F.struct(F.lit(name).alias("category"), text.alias("summary"), F.array_join(gone.get(name, F.array()), "; ").alias("missing")) for name, text in summaries(d).items()]
    return records.select("site_id", F.inline(F.array(*pairs)))


def probe_value(p):
    """Format, width, height and size of an image, blanks and zeros left out."""
    number = lambda x: F.nullif(x, F.lit(0)).cast("string")
    return F.concat_ws("×", F.nullif(p["format"], F.lit("")), number(p["width"]), number(p["height"]), number(p["bytes"]))


def export_rows(records: DataFrame, gaps: DataFrame, sources: DataFrame) -> DataFrame:
    """The long-form report: ``site_id, seq`` and the seven columns; rows of blanks part the sections (``gap`` is true there).

    One array a record, exploded once; gap notes and sources join on site and path.
    """
    d = F.col("data")
    blank_row = F.array(_row("", "", "", "", "", None, None))
    header = lambda title: F.array(_row("SECTION_HEADER", f"— {title} —", "", "", "", None, None))
    named = F.when(d["hotel_name"] == "", "(unnamed)").otherwise(d["hotel_name"])
    glance = F.array(
        _row("AT_A_GLANCE", "hotel_name", "Hotel name", named, F.when(named == "(unnamed)", "empty").otherwise("filled"), "hotel_name"),
        *(_row("AT_A_GLANCE", f"contact.{f}", label, d["contact"][f], _status(d["contact"][f]), f"contact.{f}") for label, f in (("Phone", "phone"), ("Email", "email"), ("Address", "address"))),
    )
    said = summaries(d)
    parts = [glance, blank_row, header("Categories")]
    for name, title, missing, rows in categories(d):
        parts += [blank_row, F.array(_row("CATEGORY", name, title, said[name], "", None, F.array_join(missing, "; "))), rows]
    number = lambda i: (i + 1).cast("string")

    def venue(v, i):
        at = lambda f: F.concat(F.lit("dining["), i.cast("string"), F.lit(f"].{f}"))
        label = lambda what: F.concat(F.lit("Restaurant "), number(i), F.lit(f" {what}"))
        return F.array(
            _row("Dining", at("restaurant_name"), label("name"), v["restaurant_name"], _status(v["restaurant_name"]), "dining"),
            _row("Dining", at("hours"), label("hours"), v["hours"], _status(v["hours"])),
            _row("Dining", at("menu_items"), label("menu items"), F.array_join(v["menu_items"], " | "), F.when(F.size(v["menu_items"]) > 0, "filled").otherwise("empty")),
        )

    parts += [blank_row, header("Dining"), F.flatten(F.transform(d["dining"], venue)), blank_row, header("Images")]

    def image(url, i):
        detail = F.get(F.filter(F.coalesce(d["metadata"]["image_details"], F.array()), lambda x: x["url"] == url), F.lit(0))
        note = F.when(detail.isNull(), "").otherwise(F.concat(F.lit("alt="), detail["alt"], F.lit("; caption="), detail["caption"]))
        return _row("Images", F.concat(F.lit("images["), i.cast("string"), F.lit("]")), F.concat(F.lit("Image "), number(i)), url, _status(url), None, note)

    parts.append(F.transform(d["images"], image))
    probes = F.coalesce(d["metadata"]["image_probe"], F.array())
    probed = F.transform(probes, lambda p: _row("Image probe", p["url"], "Technical read", probe_value(p), F.when(F.coalesce(p["error"], F.lit("")) != "", "empty").otherwise("filled"), None, F.coalesce(p["error"], F.lit(""))))
    parts += [F.when(F.size(probes) > 0, F.concat(blank_row, probed)).otherwise(F.slice(blank_row, 1, 0))]
    rows = records.select("site_id", F.posexplode(F.concat(*parts)).alias("seq", "x")).select("site_id", "seq", "x.*")
    # A field's own path carries its gap note; a venue's name carries that of dining.
    rows = rows.withColumn("gap_key", F.when(F.col("source_key") == "dining", F.lit("dining")).when(F.col("section").isin("CATEGORY", "SECTION_HEADER", ""), F.lit(None)).otherwise(F.col("field_key")))
    notes = gaps.select("site_id", F.col("path").alias("gap_key"), gaps_.note(F.col("status"), F.col("note")).alias("gap_note"))
    origin = sources.select("site_id", F.col("path").alias("source_key"), "source")
    rows = rows.join(notes, ["site_id", "gap_key"], "left").join(origin, ["site_id", "source_key"], "left")
    return rows.select("site_id", "seq", (F.col("section") == "").alias("gap"), "section", "field_key", "label", "value", "status", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("notes", "gap_note", F.lit("")).alias("scrape_gap_notes"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """``site_id, seq, line`` of export rows, the column names first."""
    line = F.concat_ws(",", *(checks.csv_field(F.col(c)) for c in COLUMNS))
    body = rows.select("site_id", (F.col("seq") + 1).alias("seq"), F.when(F.col("gap"), "").otherwise(line).alias("line"))
    return rows.select("site_id").distinct().select("site_id", F.lit(0).alias("seq"), F.lit(",".join(COLUMNS)).alias("line")).unionByName(body)


def csv_documents(rows: DataFrame) -> DataFrame:
    """``site_id, text``: a record's report as one CSV text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    return csv_lines(rows).groupBy("site_id").agg(F.array_join(ordered, "\n").alias("text"))


def json_documents(records: DataFrame, gaps: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """``site_id, text``: the readable report, its gaps and the whole record as JSON."""
    d = F.col("data")
    said = summaries(d)
    told = {name: F.struct(F.lit(name).alias("id"), F.lit(title).alias("title"), said[name].alias("summary_line"), missing.alias("missing_in_category"), F.transform(rows, lambda x: F.struct(x["field_key"].alias("key"), x["label"], x["value"], x["status"])).alias("fields")) for name, title, missing, rows in categories(d)}
    noted = gaps.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("status", "note")))).alias("gap"))
    origin = sources.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "source"))).alias("origin"))
    out = records.join(noted, "site_id", "left").join(origin, "site_id", "left")
    readable = F.struct(
        F.lit(VERSION).alias("document_version"), F.lit(as_of).alias("generated_at"), F.struct(trim(d["hotel_name"]).alias("hotel_name"), d["contact"]["phone"].alias("phone"), d["contact"]["email"].alias("email"), d["contact"]["address"].alias("address"), said["contact"].alias("contact_summary")).alias("at_a_glance"),
        F.array(*told.values()).alias("categories"), F.struct(said["dining"].alias("summary"), d["dining"].alias("rows")).alias("dining"), F.col("origin").alias("provenance"),
    )
    text = F.to_json(F.struct(readable.alias("readable"), F.col("gap").alias("scrape_gap_reference"), d.alias("canonical_record")), {"pretty": "true", "ignoreNullFields": "false"})
    return out.select("site_id", text.alias("text"))


def attachment(site_id, kind: str):
    return F.concat(F.lit("hotel-"), site_id, F.lit(f"-report.{kind}"))
