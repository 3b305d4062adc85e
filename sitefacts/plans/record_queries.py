"""Queries over whole records: gaps, validation, merge, provenance and reports."""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from sitefacts.functions import checks, vocab
from sitefacts.operators import assemble, gaps, report, review
from sitefacts.plans import twin
from sitefacts.plans.page_queries import site_pages
from sitefacts.sources import demo
from sitefacts.sources.tables import table

DEMO = copy.deepcopy(demo.STRUCTURED)
#: A reviewer's version of the demo record.
STAFF = copy.deepcopy(demo.STRUCTURED) | {
    "hotel_name": "  Harbor & Pine  ",
    "website": "https://other.test",
    "contact": {
        "phone": "", "email": "stay@harborpine.test ", "address": "",
        "phones": [{"label": "", "value": "415.555.0198", "note": ""}, {"label": " Bar ", "value": " 415 555 0177 ", "note": " late "}, {"label": "x", "value": " ", "note": ""}, {"label": "Desk", "value": "ext only", "note": ""}],
        "addresses": [{"label": "", "value": "120 market street, san francisco, ca 94105", "note": ""}, {"label": "", "value": "1 Pier", "note": ""}],
    },
    "services": [" Concierge ", "", "Concierge"],
    "policies": {"check_in": "", "check_out": " 11 a.m. ", "pet_policy": "", "cancellation_policy": "", "smoking_policy": "No smoking."},
    "images": ["https://x.test/A.jpg?1", " https://x.test/a.JPG#z", "no url", "No  URL", ""],
}
SCRAPED = copy.deepcopy(demo.STRUCTURED) | {
    "contact": DEMO["contact"] | {"phone": "(415)  555-0198"},
    "policies": {"check_in": "3:00  p.m. ", "check_out": "", "pet_policy": "Are pets allowed? Pet policy: Dogs  stay free.", "cancellation_policy": "We hope you like it here.", "smoking_policy": ""},
}
_BAD = copy.deepcopy(demo.STRUCTURED) | {
    "contact": {"phone": "12", "email": "a@b", "address": "Main", "phones": [{"label": "", "value": "1", "note": ""}, {"label": "", "value": "", "note": ""}, {"label": "", "value": "555-0100", "note": ""}], "addresses": [{"label": "", "value": "x", "note": ""}]},
    "policies": dict.fromkeys(DEMO["policies"], "") | {"check_in": "noon", "check_out": "late"},
    "images": ["/api/file.png", "https://a.test/b.png"],
}
_WARN = copy.deepcopy(demo.STRUCTURED) | {"policies": DEMO["policies"] | {"check_in": "noon"}}
_PLAIN = copy.deepcopy(demo.STRUCTURED) | {"dining": [{"restaurant_name": "Named only", "hours": " ", "menu_items": []}, {"restaurant_name": "", "hours": "9", "menu_items": []}], "services": [], "room_types": [], "images": [], "amenities": dict.fromkeys(DEMO["amenities"], False)}
_SURE = {"demo": demo.CONFIDENCE, "plain": {"hotel_name": 0.3, "services": 0.3, "room_types": 0.2, "amenities.pool": 0.6, "amenities.gym": 0.3, "dining": 0.9}}


def _records(spark, rows):
    return demo.records(spark, rows)


#: Kinds of the fixed paths, and records that customers make: each value hangs on the customer's key and the path's number.
_KINDS = [(no, p, "amenity" if p.startswith("amenities.") else "dining" if p == "dining" else "list" if p in ("services", "room_types", "images") else "text") for no, p in enumerate(vocab.PATHS)]
_MADE_TEXT = "CASE (c_custkey + {no}) % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE 'text ' || cast(c_custkey as string) END"
_MADE_SURE = "CASE WHEN (c_custkey + {no}) % 7 <> 0 THEN ((c_custkey * ({no} + 3)) % 20) / 20.0 END"


def _table_records(spark, d):
    """A record and its confidences for every customer."""
    at = lambda e, no: F.expr(e.format(no=no))
    told = "struct('Dune' AS restaurant_name, '9' AS hours, array('x') AS menu_items)"
    named, none = "struct('Dune' AS restaurant_name, ' ' AS hours, cast(array() AS array<string>) AS menu_items)", "struct(' ' AS restaurant_name, '9' AS hours, array('x') AS menu_items)"
    dining = f"CASE (c_custkey + {{no}}) % 4 WHEN 0 THEN slice(array({none}), 1, 0) WHEN 1 THEN array({none}, {named}) WHEN 2 THEN array({named}, {told}) ELSE array({none}) END"
    made = {"text": _MADE_TEXT, "amenity": "(c_custkey + {no}) % 2 = 0", "list": "array_repeat('x', cast((c_custkey + {no}) % 3 AS int))", "dining": dining}
    data = F.from_json(F.lit(json.dumps(demo.STRUCTURED)), demo.RECORD)
    for no, path, kind in _KINDS:
        data = data.withField(path, at(made[kind], no))
    site = F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("site_id")
    customers = table(spark, d, "customer")
    sure = F.array(*(F.struct(F.lit(p).alias("path"), at(_MADE_SURE, no).cast("double").alias("confidence")) for no, p, _ in _KINDS))
    return customers.select(site, data.alias("data")), customers.select(site, F.inline(sure)).where("confidence is not null")


def _gap_inputs(spark, d):
    records, sure = _table_records(spark, d)
    return records.unionByName(_records(spark, {"demo": DEMO, "plain": _PLAIN})), sure.unionByName(demo.confidences(spark, _SURE))


_MADE_FIELDS = f"""(SELECT 'k' || c_custkey AS site_id, no AS path_no, path, kind, CASE WHEN kind = 'text' THEN {_MADE_TEXT.format(no='no')} END AS text, CASE WHEN kind = 'amenity' THEN (c_custkey + no) % 2 = 0 END AS present,
 CASE kind WHEN 'list' THEN (c_custkey + no) % 3 WHEN 'dining' THEN [0, 2, 2, 1][(c_custkey + no) % 4 + 1] END AS n, CASE WHEN kind = 'dining' THEN [0, 1, 2, 0][(c_custkey + no) % 4 + 1] ELSE 0 END AS named, kind = 'dining' AND (c_custkey + no) % 4 = 2 AS told, ({_MADE_SURE.format(no='no')})::DOUBLE AS c
 FROM customer, (VALUES {', '.join(f"({no}, '{p}', '{k}')" for no, p, k in _KINDS)}) AS paths(no, path, kind))"""


def demo_fields(spark, d):
    return gaps.fields(demo.records(spark).unionByName(_table_records(spark, d)[0])).drop("dining")


def _field_values(rows):
    out = []
    for site, r in rows.items():
        for no, path in enumerate(vocab.PATHS):
            top, _, leaf = path.partition(".")
            v = r[top][leaf] if leaf else r[top]
            kind = "amenity" if top == "amenities" else "dining" if top == "dining" else "list" if isinstance(v, list) else "text"
            named = [x for x in v if x["restaurant_name"].strip()] if kind == "dining" else []
            told = any(x["hours"].strip() or x["menu_items"] for x in named)
            cells = [twin.q(site), str(no), twin.q(path), twin.q(kind), twin.q(v) if kind == "text" else "NULL", str(v).lower() if kind == "amenity" else "NULL", str(len(v)) if kind in ("list", "dining") else "NULL", str(len(named)), str(told).lower(), repr(_SURE.get(site, {}).get(path)) if path in _SURE.get(site, {}) else "NULL"]
            out.append("(" + ", ".join(cells) + ")")
    return f"(VALUES {', '.join(out)}) AS f(site_id, path_no, path, kind, text, present, n, named, told, c)"


DEMO_FIELDS = f"SELECT site_id, path_no::INT AS path_no, path, kind, text::VARCHAR AS text, present::BOOLEAN AS present, n::INT AS n FROM (SELECT * FROM {_field_values({'demo': DEMO})} UNION ALL SELECT * FROM {_MADE_FIELDS})"
_GAPS = f"""(SELECT site_id, path_no::INT AS path_no, path, CASE kind WHEN 'amenity' THEN CASE WHEN present THEN CASE WHEN coalesce(c, 0) >= 0.5 THEN 'complete' ELSE 'uncertain' END WHEN coalesce(c, 0) >= 0.55 THEN 'complete' WHEN coalesce(c, 0) > 0.2 THEN 'uncertain' ELSE 'missing' END
 WHEN 'dining' THEN CASE WHEN told THEN 'complete' WHEN named > 0 THEN 'partial' ELSE 'missing' END WHEN 'list' THEN CASE WHEN n > 0 THEN CASE WHEN c < 0.5 THEN 'partial' ELSE 'complete' END WHEN c > 0.25 AND c < 0.55 THEN 'uncertain' ELSE 'missing' END
 ELSE CASE WHEN trim(text) = '' THEN 'missing' WHEN c < 0.45 THEN 'partial' WHEN c < 0.65 THEN 'uncertain' ELSE 'complete' END END AS status, CASE WHEN kind = 'amenity' AND NOT present AND c >= 0.55 THEN {twin.q(gaps.NO_KEYWORD)} END AS note FROM (SELECT * FROM {_field_values({'demo': DEMO, 'plain': _PLAIN})} UNION ALL SELECT * FROM {_MADE_FIELDS}))"""


def gap_report(spark, d):
    return gaps.report(*_gap_inputs(spark, d))


GAP_REPORT = f"SELECT * FROM {_GAPS}"


def gap_counts(spark, d):
    return gaps.summary(gaps.report(*_gap_inputs(spark, d)))


GAP_COUNTS = f"SELECT site_id, count(*) FILTER (status <> 'complete') AS n_open, coalesce(string_agg(path, ',' ORDER BY path_no) FILTER (status <> 'complete'), '') AS open_paths, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in ('complete', 'partial', 'uncertain', 'missing'))} FROM {_GAPS} GROUP BY site_id"


def validation_issues(spark, d):
    return review.issues(_records(spark, {"demo": DEMO, "bad": _BAD, "warn": _WARN}))


def _values(rows, names):
    cell = lambda x: twin.q(x) if isinstance(x, str) else "NULL" if x is None else repr(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


_PHONE_N, _PLACE_N = "Additional phone {} must use a valid 10-digit phone format.", "Additional address {} must include a street address and ZIP code."
_ISSUES = [("contact.phone", "error", review.BAD_PHONE), ("contact.phones.0", "error", _PHONE_N.format(1)), ("contact.phones.2", "error", _PHONE_N.format(3)), ("contact.email", "error", review.BAD_EMAIL), ("contact.address", "error", review.BAD_ADDRESS),
           ("contact.addresses.0", "error", _PLACE_N.format(1)), ("policies.check_in", "warning", review.BAD_CHECK_IN), ("policies.check_out", "warning", review.BAD_CHECK_OUT), ("images.0", "error", "Image 1 must be an http(s) URL.")]
VALIDATION_ISSUES = f"SELECT * FROM {_values([('bad', n, *x) for n, x in enumerate(_ISSUES)] + [('warn', 0, 'policies.check_in', 'warning', review.BAD_CHECK_IN)], 'site_id, seq, field, severity, message')}"


def accepted_submissions(spark, d):
    return review.without_errors(_records(spark, {"demo": DEMO, "bad": _BAD, "warn": _WARN})).select("site_id", F.col("data")["hotel_name"].alias("hotel_name"))


ACCEPTED_SUBMISSIONS = f"SELECT site_id, {twin.q(DEMO['hotel_name'])} AS hotel_name FROM (VALUES ('demo'), ('warn')) t(site_id)"


def _merged(spark):
    return review.merge(_records(spark, {"demo": SCRAPED, "same": DEMO}), _records(spark, {"demo": STAFF, "same": DEMO}))


def staff_merge(spark, d):
    m = F.col("data")
    c, p = m["contact"], m["policies"]
    listed = lambda x: F.array_join(x, "|")
    flat = {
        "hotel_name": m["hotel_name"], "website": m["website"], "contact.phone": c["phone"], "contact.email": c["email"], "contact.address": c["address"], "contact.phones": checks.contact_lines(c["phones"]), "contact.addresses": checks.contact_lines(c["addresses"]),
        "services": listed(m["services"]), "room_types": listed(m["room_types"]), "images": listed(m["images"]), **{f"policies.{k}": p[k] for k, _ in vocab.POLICIES}, "details": F.size(m["metadata"]["image_details"]).cast("string"),
    }
    return _merged(spark).select("site_id", F.inline(F.array(*(F.struct(F.lit(k).alias("path"), v.alias("value")) for k, v in flat.items()))))


def _scalars(site, a, b):
    yield from ((site, "pick", "hotel_name", a["hotel_name"], b["hotel_name"]), (site, "own", "website", a["website"], b["website"]), (site, "phone", "contact.phone", a["contact"]["phone"], b["contact"]["phone"]))
    yield from ((site, "pick", f"contact.{f}", a["contact"][f], b["contact"][f]) for f in ("email", "address"))
    yield from ((site, "time", f"policies.{f}", a["policies"][f], b["policies"][f]) for f in ("check_in", "check_out"))
    yield from ((site, f"{f}_answer", f"policies.{f}_policy", a["policies"][f"{f}_policy"], b["policies"][f"{f}_policy"]) for f in vocab.ANSWER_SIGNAL)
    yield from ((site, "list", f, None, "|".join(b[f])) for f in ("services", "room_types", "images"))
    yield site, "count", "details", None, str(len(b["metadata"]["image_details"]))


def _entries(site, a, b):
    for kind in ("phones", "addresses"):
        yield from ((site, kind, n + 1, x["label"], x["value"], x["note"]) for n, x in enumerate(b["contact"][kind]))


_PAIRS = (("demo", SCRAPED, STAFF), ("same", DEMO, DEMO))
_ANSWERS = twin.trim(twin.swap(twin.swap(twin.swap(f"array_to_string({twin.question_free('string_split_regex(' + twin.swap('a', r'([?.!])\s+', chr(92) + '1' + chr(1), False) + ', ' + twin.q(chr(1) + '|\n+') + ')')}, ' ')", vocab.ANSWER_PREFIX, ""), vocab.STOCK_QUESTIONS, ""), r"\s+", " "))
STAFF_MERGE = f"""WITH t AS (SELECT * FROM {_values([x for s, a, b in _PAIRS for x in _scalars(s, a, b)], 'site_id, kind, path, a, b')}), p AS (SELECT *, CASE WHEN trim(b) = '' THEN {twin.trim('a')} ELSE {twin.trim('b')} END AS pick, {_ANSWERS} AS answer FROM t),
 l AS (SELECT site_id, path, list_filter(list_transform(string_split(b, '|'), lambda x: {twin.trim('x')}), lambda x: x <> '') AS l FROM t WHERE kind = 'list'), u AS (SELECT site_id, path, i, l[i] AS x, CASE WHEN path <> 'images' THEN i::VARCHAR WHEN l[i] LIKE '%://%' THEN lower(regexp_replace(l[i], '[?#].*$', '')) ELSE lower({twin.squeeze('l[i]')}) END AS k FROM (SELECT *, generate_subscripts(l, 1) AS i FROM l)),
 v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY site_id, path, k ORDER BY i) = 1),
 o AS (SELECT site_id, path, CASE kind WHEN 'own' THEN CASE WHEN a <> '' THEN a ELSE b END WHEN 'phone' THEN CASE WHEN length({twin.swap('pick', '[^0-9+]', '', False)}) < 10 THEN pick ELSE {twin.squeeze('pick')} END WHEN 'time' THEN CASE WHEN trim(b) <> '' THEN {twin.trim('b')} ELSE {twin.trim(twin.swap(twin.swap(twin.swap('a', r'\s+', ' '), r'\ba\.m\.', 'AM'), r'\bp\.m\.', 'PM'))} END
  WHEN 'count' THEN b {" ".join(f"WHEN '{k}_answer' THEN CASE WHEN trim(b) <> '' THEN {twin.trim('b')} WHEN {twin.has('answer', s)} THEN answer ELSE '' END" for k, s in vocab.ANSWER_SIGNAL.items())} ELSE pick END AS value FROM p WHERE kind <> 'list'),
 e0 AS (SELECT * FROM {_values([x for s, a, b in _PAIRS for x in _entries(s, a, b)], 'site_id, kind, n, label, value, note')}), e AS (SELECT site_id, 'phones' AS kind, 0 AS n, 'Primary' AS label, value, '' AS note FROM o WHERE path = 'contact.phone' UNION ALL SELECT site_id, 'addresses', 0, 'Primary', value, '' FROM o WHERE path = 'contact.address' UNION ALL SELECT * FROM e0),
 g AS (SELECT *, CASE WHEN kind = 'phones' AND regexp_matches(value, '[0-9]') THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(trim(value)) END AS k FROM e WHERE trim(value) <> ''), h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY site_id, kind, k ORDER BY n) = 1)
SELECT * FROM o UNION ALL SELECT site_id, path, string_agg(x, '|' ORDER BY i) FROM v GROUP BY ALL UNION ALL SELECT site_id, 'contact.' || kind, string_agg(CASE WHEN trim(label) <> '' THEN trim(label) WHEN kind = 'phones' THEN 'Contact' ELSE 'Address' END || ' | ' || trim(value) || ' | ' || trim(note), chr(10) ORDER BY n) FROM h GROUP BY ALL"""


def provenance(spark, d):
    return review.provenance(_merged(spark)).select("site_id", "path_no", "path", "source")


_CHANGED = {"demo": ("hotel_name", "contact.phone", "contact.email", "contact.phones", "contact.addresses", "services", "images", *(f"policies.{k}" for k, _ in vocab.POLICIES)), "same": ("contact.phones", "contact.addresses")}
PROVENANCE = f"SELECT site_id, path_no::INT AS path_no, path, source FROM {_values([(s, n, p, 'merged' if p == 'metadata' else 'hotel_staff' if p in c else 'scraper') for s, c in _CHANGED.items() for n, p in enumerate((*review.TRACKED, 'metadata'))], 'site_id, path_no, path, source')}"


def report_summary(spark, d):
    return report.summary_rows(_records(spark, {"demo": DEMO, "plain": _PLAIN}))


_OFF = "Gym / fitness, Parking, Spa, Accessible rooms, EV charging, Meeting / event space"
_CONTACT = "2 of 3 primary contact slots have text. 1 additional phone(s), 0 additional address(es)."
_POLICY = "Missing: Check-out time, Pet policy, Smoking policy."
REPORT_SUMMARY = f"""SELECT * FROM {_values([
    ("demo", "contact", _CONTACT, "Email"), ("demo", "amenities", f"Available: Pool, Wi‑Fi, Breakfast. Not offered or unchecked: {_OFF}.", ""), ("demo", "services", "Concierge; Laundry", ""), ("demo", "policies", _POLICY, "Check-out time; Pet policy; Smoking policy"), ("demo", "rooms", "2 room type line(s).", ""), ("demo", "dining", "1 dining entry.", ""),
    ("plain", "contact", _CONTACT, "Email"), ("plain", "amenities", "No amenity toggles are on. Not offered or unchecked: Pool, Gym / fitness, Wi‑Fi, Parking, Spa, Breakfast, Accessible rooms, EV charging, Meeting / event space.", ""), ("plain", "services", "No services list captured.", "Entire services list"), ("plain", "policies", _POLICY, "Check-out time; Pet policy; Smoking policy"),
    ("plain", "rooms", "No room types captured.", "Room types"), ("plain", "dining", "2 dining entries.", ""),
], "site_id, category, summary, missing")}"""


def report_fields(spark, d):
    return report.field_rows(_records(spark, {"demo": DEMO})).select("category", "field_key", "label", "value", "status")


def _export(spark):
    records = _records(spark, {"demo": DEMO})
    sources = review.provenance(review.merge(records, records))
    return records, gaps.report(records, demo.confidences(spark)), sources


def export_rows(spark, d):
    return report.export_rows(*_export(spark))


def csv_lines(spark, d):
    return report.csv_lines(report.export_rows(*_export(spark)))


_ADDRESS = '"120 Market Street, San Francisco, CA 94105"'
_URLS = DEMO["images"]
# The demo record's report, written out by hand.
CSV = [
    "section,field_key,label,value,status,source,scrape_gap_notes", "AT_A_GLANCE,hotel_name,Hotel name,Harbor & Pine Hotel,filled,scraper,complete", "AT_A_GLANCE,contact.phone,Phone,(415) 555-0198,filled,scraper,complete", "AT_A_GLANCE,contact.email,Email,,empty,scraper,missing",
    f"AT_A_GLANCE,contact.address,Address,{_ADDRESS},filled,scraper,complete", "", "SECTION_HEADER,— Categories —,,,,,", "", f'CATEGORY,contact,Contact,"{_CONTACT}",,,Email', "Contact,contact.phone,Phone,(415) 555-0198,filled,scraper,complete", "Contact,contact.email,Email,,empty,scraper,missing",
    f"Contact,contact.address,Address,{_ADDRESS},filled,scraper,complete", "Contact,contact.phones[0],Primary phone,(415) 555-0198 (Main phone found on the demo homepage.),filled,hotel_staff,", "Contact,contact.phones[1],Reservations,(415) 555-0144 (Separate reservations line found near booking copy.),filled,hotel_staff,",
    'Contact,contact.addresses[0],Hotel address,"120 Market Street, San Francisco, CA 94105 (Street address found in contact section.)",filled,hotel_staff,', "", f'CATEGORY,amenities,Amenities,"Available: Pool, Wi‑Fi, Breakfast. Not offered or unchecked: {_OFF}.",,,',
    *(f"Amenities,amenities.{a},{label},{'Yes' if DEMO['amenities'][a] else 'No'},filled,scraper,{s}" for (a, (_, _, label)), s in zip(vocab.AMENITIES.items(), ("complete", "missing", "complete", "missing", "missing", "uncertain", "missing", "missing", "missing"))),
    "", "CATEGORY,services,Services,Concierge; Laundry,,,", 'Services,services,Services (combined),"Concierge\nLaundry",filled,scraper,complete', "", f'CATEGORY,policies,Policies,"{_POLICY}",,,Check-out time; Pet policy; Smoking policy', "Policies,policies.check_in,Check-in time,3:00 PM,filled,scraper,uncertain",
    "Policies,policies.check_out,Check-out time,,empty,scraper,missing", "Policies,policies.pet_policy,Pet policy,,empty,scraper,missing", "Policies,policies.cancellation_policy,Cancellation policy,Flexible rates may be cancelled up to 48 hours before arrival.,filled,scraper,uncertain",
    "Policies,policies.smoking_policy,Smoking policy,,empty,scraper,missing", "", "CATEGORY,rooms,Room types,2 room type line(s).,,,", 'Room types,room_types,Room types (combined),"King Room\nTwo Queen Room",filled,scraper,complete', "", "SECTION_HEADER,— Dining —,,,,,",
    "Dining,dining[0].restaurant_name,Restaurant 1 name,Drift Kitchen,filled,scraper,complete", "Dining,dining[0].hours,Restaurant 1 hours,,empty,,", "Dining,dining[0].menu_items,Restaurant 1 menu items,Smoked salmon toast | Seasonal grain bowl,filled,,", "", "SECTION_HEADER,— Images —,,,,,",
    f"Images,images[0],Image 1,{_URLS[0]},filled,,alt=Hotel exterior; caption=Potential exterior image found on the homepage.", f"Images,images[1],Image 2,{_URLS[1]},filled,,alt=Guest room; caption=Potential guest room image found on the rooms page.",
]
CSV_LINES = f"SELECT site_id, seq::INT AS seq, line FROM {_values([('demo', n, x) for n, x in enumerate(CSV)], 'site_id, seq, line')}"


def csv_document(spark, d):
    return report.csv_documents(report.export_rows(*_export(spark))).select("site_id", F.md5("text").alias("text_md5"))


CSV_DOCUMENT = f"SELECT 'demo' AS site_id, md5({twin.q(chr(10).join(CSV))}) AS text_md5"


def json_document(spark, d):
    text = report.json_documents(*_export(spark), demo.AS_OF)
    at = lambda p: F.get_json_object("text", p)
    return text.select("site_id", at("$.readable.document_version").alias("version"), at("$.readable.categories[0].summary_line").alias("contact_summary"), at("$.scrape_gap_reference['contact.email'].status").alias("email_gap"), at("$.canonical_record.policies.check_in").alias("check_in"), at("$.readable.provenance['contact.phones']").alias("phones_source"))


JSON_DOCUMENT = f"SELECT 'demo' AS site_id, '2.0' AS version, {twin.q(_CONTACT)} AS contact_summary, 'missing' AS email_gap, '3:00 PM' AS check_in, 'hotel_staff' AS phones_source"


def form_venues(spark, d):
    rows = _records(spark, {"demo": DEMO, "plain": _PLAIN, "none": DEMO | {"dining": [{"restaurant_name": " ", "hours": "", "menu_items": [" "]}]}})
    sent = review.submitted_dining(F.col("data")["dining"])
    return rows.select("site_id", F.size(sent).alias("n_sent"), F.size(review.form_record(sent)).alias("n_shown"))


FORM_VENUES = "SELECT * FROM (VALUES ('demo', 1, 1), ('plain', 2, 2), ('none', 0, 1)) t(site_id, n_sent, n_shown)"


def site_records(spark, d):
    """A record for every site of the page table, with its gaps counted."""
    records, sure = assemble.extract(site_pages(spark, d), demo.AS_OF)
    counted = gaps.summary(gaps.report(records, sure))
    data = F.col("data")
    slim = records.select("site_id", data["hotel_name"].alias("hotel_name"), data["website"].alias("website"), data["contact"]["phone"].alias("phone"), F.size(data["metadata"]["source_pages"]).alias("n_pages"))
    return slim.join(counted, "site_id")


NAMES = (
    "demo_fields", "gap_report", "gap_counts", "validation_issues", "accepted_submissions", "staff_merge", "provenance", "report_summary", "report_fields", "export_rows", "csv_lines", "csv_document", "json_document", "form_venues", "site_records",
)
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES if n.upper() in globals()}
