"""Inputs of text queries: a few invented rows, and rows made of the given tables, the same for a Spark frame and for SQL text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.sources.tables import spread, table

_PET = "Pets\nPet policy: Are pets allowed? Dogs are welcome up to 40 pounds.\nA fee of $75 per stay applies to every room with an animal.\nParking\nValet parking is 20 USD."
_DINING = "Blue Door Restaurant\nOpen daily from 6\nMo-Fr 7:00-10:30, 17:00-22:00 | Sa 08:00-11:00\nAvocado toast with egg $14\nHouse Burger - $18.50\nPet fee $20 breakfast\nRooms and suites\nEnd of page"
_LODGING = {"@context": "https://schema.org", "@type": "Hotel", "name": "Pebble Quay", "telephone": ["(415) 555-0101", 7], "email": "mailto:stay@pebblequay.test", "address": {"streetAddress": "4 Quay St", "addressLocality": "Monterey", "postalCode": "93940"}}
_VENUES = {"@graph": [{"@type": ["Restaurant", "LocalBusiness"], "name": "Salt Room", "openingHours": ["Mo-Fr 07:00-10:00", "Sa 08:00-11:00"], "hasMenu": {"name": "Dinner"}}, {"@type": "Restaurant", "name": "restaurant"}, {"@type": "BarOrPub", "name": "SALT ROOM"}, {"@type": "CafeOrCoffeeShop", "name": "Low Tide", "openingHours": "Su 09:00-12:00", "menu": ["Scone", {"name": "Tea"}]}]}

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "fx_values": ("id long, v string", list(enumerate([
        "", "  ", "(415) 555-0198", "+1 415 555 0198", "415-555-019", "call 4155550198", "1 (415) 555.0198", "a@b.co", "a@b", "a b@c.com", "info@pebble.test", "12 Oak Street, Town 94105", "12 Oak Street", "Best 12345", "3:00 PM", "noon",
        "25:99", "call 7 days ahead", "https://a.test/x", "ftp://a.test", "a.test/x", "http://", "/relative/path", "  spaced   value ", "a.m. 3:00 p.m.", "one | two", "Harbor View - Rooms & Suites | Pebble Quay", "Home", "A-B", "Official  Site",
        "Mo-Fr 7:00-10:30,17:00-22:00 | Sa 08:00-11:00", "Item 3 Deluxe King Room", "Rooms & Suites Deluxe Suite", "Room: Queen Studio , city view", "guest photo 2 of 9 Link to Larger Image pool", "mailto:Stay@Quay.test).", "surname@quay.test", "logo@2x.png",
        'say "hi", twice', "line\nbreak", "photo.JPG", "my menu (v2)+final.webp", "../../etc/pass wd?.svg", "No crawlable HTML pages were retrieved from x", "other failure",
    ]))),
    "fx_urls": ("id long, page string, href string", [
        (0, "https://a.test/rooms/index.html?x=1#top", "deluxe"), (1, "https://a.test/rooms/", "/dining?m=1#a"), (2, "http://a.test:80/x", "//cdn.test/p.jpg"), (3, "https://A.test", "?page=2"), (4, "https://a.test/a/b", "#frag"),
        (5, "https://a.test/a/b", "https://a.test:443/contact//"), (6, "http://a.test/", "https://a.test/about"), (7, "https://a.test/x", "mailto:x@a.test"), (8, "https://a.test/x", "/IMG/Room-King.JPG?w=9"), (9, "https://a.test/x", "/icon/photo.png"), (10, "https://a.test/x", "/brochure.pdf?d=1"), (11, "https://a.test/x", "/amenities/pool"),
    ]),
    "fx_texts": ("site string, page_seq long, text string", [
        ("s1", 0, "Call (415) 555-0198 or 415.555.0198 today. Fax +1 415 555 0144.\nMail reserve@quay.test, info@quay.test; test@quay.test"), ("s1", 1, "Again 4155550198 and (212) 555-0100\nWrite sales@quay.test."), ("s2", 0, "No contact here 12345"),
        ("s3", 0, "Visit 12 Oak  Street , Springfield, IL 62704 or 9 Elm Ave, Shelbyville 62565-1234. Again 12 OAK STREET, Springfield, IL 62704"), ("s3", 1, "x@quay.test y@example.com logo@2x.png"),
        ("s4", 0, "Check-in: 3:00 PM and check-out 11 AM. Heated pool and swimming lessons, pool bar, pool deck. No gym. Free Wi-Fi; parking not available, wheelchair ramps. Concierge, room service and airport shuttle."),
        ("s5", 0, "Deluxe King Room\nOur deluxe room with view\n- Premier Queen Suite\nStandard Double\n1. Classic Twin Studio 2024\nPhoto gallery king"), ("s6", 0, _PET), ("s7", 0, "Pet-friendly stays and cat naps in every season\nSmoking\nNon-smoking property. Smoking is prohibited in rooms.\nCancellation\nCancel 48 hours before arrival for a full refund."),
        ("s8", 0, _DINING), ("s9", 0, ""),
    ]),
    "fx_titles": ("site string, page_seq long, title string, og_title string, og_site_name string", [
        ("s1", 0, "Home", "Home", ""), ("s1", 1, "Quay Rooms | Pebble", "Rooms - Pebble Quay", ""), ("s1", 2, "Quay Rooms | Pebbly", "Dining - Pebble Quay", ""), ("s1", 3, "x", "Dining - Pebble Quay", ""), ("s2", 0, "Two", "", "Pebble"), ("s2", 1, "Two plus", "t", "Quay"), ("s2", 2, "", "t", " Quay "),
        ("s2", 3, "", "", "Pebble"), ("s3", 0, "Long Name - of it", "welcome", " "), ("s4", 0, "", "", ""),
    ]),
    "fx_robots": ("site string, line_no int, line string", [
        ("r1", i, x) for i, x in enumerate(["# intro", "User-agent: *", "Disallow: /private # no", "Allow: /private/open", "Disallow: /tie", "Allow: /tie", "Disallow: /dir/", "Disallow: q?x=1", "User-agent: bot", "Disallow: /bot"])
    ] + [("r2", 0, "User-Agent: *"), ("r2", 1, "Disallow:"), ("r2", 2, "Allow: /ok"), ("r3", 0, "User-agent: *"), ("r3", 1, "User-agent: other"), ("r3", 2, "Disallow: /")]),
    "fx_targets": ("site string, url string", [
        *(("r1", f"https://r1.test{p}") for p in ("/", "/private", "/private/x", "/privateer", "/private/open/y", "/tie/x", "/dir", "/dir/z", "/q", "/bot", "", "/private?x=1")), ("r2", "https://r2.test/any"), ("r2", "https://r2.test/ok/1"), ("r3", "https://r3.test/x"), ("r4", "https://r4.test/x"), ("r1", "not a url"),
    ]),
    "fx_sitemap": ("site string, origin string, file string, xml string", [
        ("m1", "https://m1.test", "1-sitemap.xml", "<urlset><url><loc>https://m1.test/a</loc></url><url><loc> https://m1.test/b </loc></url><loc>https://m1.test/a</loc><loc>https://m1.test.evil/c</loc><loc>https://m1.test/d.pdf</loc></urlset>"),
        ("m1", "https://m1.test", "2-nested.xml", "<LOC>https://m1.test/b</LOC><loc>https://m1.test/e?x=1</loc>"), ("m2", "http://m2.test", "1", "<loc>https://m2.test/a</loc>"), ("m3", "https://m3.test", "1", "".join(f"<loc>https://m3.test/p{k}</loc>" for k in range(100))),
    ]),
    "fx_graph": ("site string, src string, href string, pos int, score double", [
        ("g1", "A", "B", 0, 2.0), ("g1", "A", "C", 1, 3.0), ("g1", "A", "B", 2, 5.0), ("g1", "B", "A", 0, 1.0), ("g1", "B", "D", 1, 2.0), ("g1", "C", "D", 0, 0.0), ("g1", "C", "E", 1, 3.0), ("g1", "E", "X", 0, 6.0), ("g1", "D", "F", 0, 1.0),
        *(("g2", f"N{k}", f"N{k + 1}", 0, 1.0) for k in range(12)),
    ]),
    "fx_graph_pages": ("site string, url_key string", [*(("g1", x) for x in "ABCDEF"), *(("g2", f"N{k}") for k in range(13))]),
    "fx_graph_seeds": ("site string, url string, score double, seq long", [("g1", "A", 100.0, 0), ("g1", "F", 38.0, 1), ("g2", "N0", 100.0, 0)]),
    "fx_html": ("site string, page_seq long, url string, html string", [
        ("h1", 0, "https://h1.test/rooms", "<html><head><title> Quay &amp; Co | Rooms </title><meta property='og:title' content='Quay Rooms'><meta content='Quay' property='og:site_name'></head><body><p>One<b>two</b></p><div>three<br>four &amp;lt; 5</div><script>var x='</p>';</script><!-- no --><td>cell</td><ul><li>a</li><li>b</li></ul>\n\n\n\n<h1>Head</h1>"
         "<a href='/dining'>Our <i>menu</i></a><a href=\"mailto:x@y.z\">m</a><a href='https://other.test/x'>o</a><a href='/a.pdf'>p</a><button data-href='/spa'>Spa</button><div onclick=\"go('/contact/us')\">Go</div></body></html>"),
        ("h1", 1, "https://h1.test/gallery", "<body><meta name='twitter:image' content='/img/front.jpg'><figure><img src='/img/King-Suite.jpg?w=3' alt='King suite photo 1 of 3'><figcaption> The suite </figcaption></figure><h2>Our pool</h2><div><img data-src='/img/pool.png' title='By the pool'></div><img src='/img/king-suite.jpg?w=9'>"
         "<img srcset='/img/bar.webp 1x, /img/bar2.webp 2x' src='/x.gif' alt='Cocktail bar'><img src='/icon/a.png'><img src='/img/none.svg'></body>"),
        ("h2", 0, "https://h2.test/", "<title>Only</title><body>text only</body>"),
    ]),
    "fx_jsonld": ("site string, page_seq long, script_no int, body string", [
        ("j1", 0, 0, json.dumps([_LODGING, {"@type": "Thing", "name": "No"}])), ("j1", 1, 0, json.dumps({"@type": "Resort", "name": "Second", "telephone": "x", "address": "1 Road"})), ("j1", 1, 1, json.dumps(_VENUES)), ("j1", 2, 0, "{bad json"), ("j2", 0, 0, json.dumps({"@graph": {"@type": "Motel", "name": " Inn "}})),
        ("j3", 0, 0, json.dumps({"@type": "Restaurant", "name": "Lone", "openingHoursSpecification": [{"dayOfWeek": ["Mo", "Tu"], "opens": "07:00", "closes": "09:00"}, "Sa 10:00-11:00"]})),
    ]),
    "fx_images": ("site string, page_seq long, page_url string, pos int, url string, alt string, title string, caption string", [
        ("i1", 0, "https://i1.test/", 0, "https://i1.test/a.jpg?x=1", "Front entrance", "", ""), ("i1", 0, "https://i1.test/", 1, "https://i1.test/A.JPG?x=2", "dup", "", ""), ("i1", 0, "https://i1.test/", 2, "https://i1.test/icon/b.png", "", "", ""), ("i1", 0, "https://i1.test/", 3, "https://i1.test/c.webp#f", "", "", ""),
        ("i1", 0, "https://i1.test/", 4, "https://i1.test/d.png", "Item 3 King bed", "", "photo 1 of 4 by the bar"), ("i1", 1, "https://i1.test/dining", 0, "https://i1.test/e.gif", "", "The  chef", ""), ("i1", 1, "https://i1.test/dining", 1, "https://i1.test/a.jpg", "", "", ""), ("i2", 0, "https://i2.test/x", 0, "https://i2.test/z.jpeg", "", "", "Fitness lobby"),
    ]),
    "fx_contacts": ("id long, text string", [(0, "Front desk | (415) 555-0198 | day\n\n 415 555 0100 \nBar | 1 | a | b\n | 2 |"), (1, ""), (2, "only | ")]),
    "fx_sites": ("site_id string, review_token string, operator_token string, status string, scraped string, normalized string", [("a", "ra", "oa", "pending_review", "A0", None), ("b", "rb", "ob", "completed", "B0", "B1"), ("c", "rc", None, "completed", "C0", None), ("d", "rd", "od", "pending_review", "D0", "D1")]),
    "fx_requests": ("site_id string, token string", [("a", "ra"), ("a", "oa"), ("b", "ob"), ("c", "rc"), ("c", ""), ("d", "od"), ("x", "ox")]),
    "fx_uploads": ("site_id string, name string, bytes long, created_at string", [("a", "dir/room photo?.png", 100, "t1"), ("a", "big.gif", 9000000, "t2"), ("b", "", 5, "t3"), ("b", "é+x (1).webp", 8388608, "t4")]),
    "fx_bodies": ("id long, text string", [(0, '{"url": " https://a.test ", "demo": false}'), (1, '{"demo": true}'), (2, "nope"), (3, '{"url": 5}'), (4, "[]")]),
    "fx_issues": ("field string, severity string", [("contact.phone", "error"), ("contact.phones.0", "error"), ("images.1", "error"), ("policies.check_in", "warning")]),
    "fx_paths": ("path string", [("contact",), ("contact.phone",), ("contact.phones",), ("images",), ("image",), ("policies",)]),
    "fx_probe": ("id long, format string, width long, height long, bytes long, error string", [(0, "png", 10, 20, 300, None), (1, None, 0, 5, 9, "x"), (2, None, None, None, None, "http_404")]),
}


def _cases(key: str, *parts: str) -> str:
    """One of the expressions for each remainder of ``key``."""
    return f"CASE {key} % {len(parts)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(parts)) + " END"


def _lines(*parts: str) -> str:
    return f"concat_ws(chr(10), {', '.join(parts)})"


def _only(key: str, of: int, text: str) -> str:
    return f"CASE WHEN {key} % {of} <> 0 THEN {text} END"


def _s(x: str) -> str:
    return f"cast({x} as string)"


def _phone(key: str) -> str:
    return f"'(' || {_s(f'200 + {key} % 700')} || ') 555-' || lpad({_s(f'{key} % 10000')}, 4, '0')"


_P, _C = "p_partkey", "c_custkey"
_HOST = f"'https://h' || {_s(f'{_P} % 50')} || '.test'"
_MAP = f"'https://m' || {_s('p_size')} || '.test'"

#: Rows made of given tables, as expressions that mean the same to both engines.
FROM_TABLES: dict[str, tuple[str, list[str]]] = {
    "fx_values": ("part", [f"1000 + {_P}", _cases(
        _P, _phone(_P), f"'+1 ' || {_s(f'200 + {_P} % 700')} || ' 555 ' || lpad({_s(f'{_P} % 10000')}, 4, '0')", f"'call ' || {_s(_P)} || ' days ahead'", f"'desk' || {_s(_P)} || '@quay' || {_s(f'{_P} % 9')} || '.test'",
        f"'logo' || {_s(_P)} || '@2x.png'", f"{_s(_P)} || ' Oak Street, Springfield, IL ' || {_s(f'10000 + {_P} % 80000')}", f"{_s(_P)} || ' Elm Avenue'", f"{_s(f'1 + {_P} % 12')} || ':' || lpad({_s(f'{_P} % 60')}, 2, '0') || ' p.m.'",
        f"{_s(f'{_P} % 30')} || ':99'", f"{_HOST} || '/x?y=' || {_s(_P)}", "'ftp://' || p_brand", "p_name || ' - Rooms & Suites | Quay ' || p_brand", "'Home'", f"'Mo-Fr 7:00-' || {_s(f'8 + {_P} % 3')} || ':30,17:00-22:00 | Sa 08:00-11:00'",
        "'Deluxe King Room'", f"'Item ' || {_s(f'{_P} % 9')} || ' Queen Suite'", "'Rooms & Suites ' || p_type || ' Suite'", f"'guest photo 2 of ' || {_s(_P)} || ' Link to Larger Image ' || p_name", "'say \"' || p_name || '\", twice'", "'line' || chr(10) || p_name",
        "p_name || '.JPG'", f"'dir/' || p_name || ' (v' || {_s(f'{_P} % 5')} || ')?.webp'", "'  ' || p_name || '   ' || p_type || ' '", "'No crawlable HTML pages were retrieved from ' || p_name", f"'mailto:info' || {_s(_P)} || '@quay.test'", "p_type || ' Restaurant'", "'http://'", "p_name",
    )]),
    "fx_urls": ("part", [
        f"1000 + {_P}", f"{_HOST} || " + _cases(_P, "'/rooms/index.html?x=1#top'", "'/rooms/'", "''", "'/a/b'", f"'/p' || {_s(_P)}"),
        _cases(f"({_P} + p_size)", "'deluxe'", "'/dining?m=1#a'", "'//cdn.test/p.jpg'", "'?page=2'", "'#top'", f"{_HOST} || ':443/contact//'", "'mailto:x@a.test'", "'/IMG/Room-King.JPG'", "'menu.pdf'", "'https://other.test/rooms'", "'/sprite/a.png'", "'gallery/photo.webp?w=1'", f"'/amenities/' || {_s(_P)}"),
    ]),
    "fx_texts": ("customer", ["'c' || " + _s("c_nationkey"), f"1000 + {_C}", _lines(
        f"'Call ' || {_phone(_C)} || ' or mail ' || " + _cases(_C, f"'desk' || {_s(_C)}", "'reservations'", "'x'") + f" || '@quay' || {_s(f'{_C} % 40')} || '.test, fax ' || {_phone(f'({_C} + 1)')}",
        _only(_C, 3, f"{_s(f'1 + {_C} % 900')} || ' Oak Street , Springfield, IL ' || {_s(f'10000 + {_C} % 80000')}"),
        _only(_C, 4, f"'Check-in: ' || {_s(f'1 + {_C} % 11')} || ':00 PM and check-out ' || {_s(f'1 + {_C} % 11')} || ' AM.'"),
        _cases(_C, "'Heated pool, pool bar and pool deck. Free Wi-Fi.'", "'No gym. Parking is not available, spa and sauna.'", "'Wheelchair ramps, airport shuttle and a fitness center.'", "'Concierge, laundry and room service.'", "'c_mktsegment ' || c_mktsegment"),
        _only(_C, 5, "'Pets'"), _only(_C, 5, f"'Pet policy: Are pets allowed? Dogs are welcome up to ' || {_s(f'20 + {_C} % 60')} || ' pounds.'"), _only(_C, 2, f"'A fee of $' || {_s(f'25 + {_C} % 100')} || ' per stay applies to every room with an animal.'"), _only(_C, 7, "'Parking'"),
        _only(_C, 6, "'Cancellation policy'"), _only(_C, 6, f"'Reservations may be cancelled up to ' || {_s(f'{_C} % 72')} || ' hours before arrival without charge.'"), _only(_C, 8, f"'Smoking policy: this is a smoke-free hotel and a fee of $' || {_s(f'100 + {_C} % 200')} || ' applies.'"),
        _only(_C, 3, "'Blue Door Restaurant'"), _only(_C, 3, f"'Open daily from ' || {_s(f'5 + {_C} % 5')}"), _only(_C, 2, f"'Avocado toast with egg $' || {_s(f'8 + {_C} % 9')}"), _only(_C, 5, f"'House Burger - $' || {_s(f'10 + {_C} % 9')} || '.50'"), "'Rooms and suites'",
        _cases(_C, "'Deluxe King Room'", "'- Premier Queen Suite'", "'Standard Double'", "'Photo gallery king'"), "'Classic Twin Studio'",
    )]),
    "fx_robots": ("part", ["'b' || " + _s("p_size"), _P, _cases(f"({_P} % 11 + p_size)", "'User-agent: *'", f"'Disallow: /p' || {_s(f'{_P} % 40')}", f"'Allow: /p' || {_s(f'{_P} % 40')} || '/open # yes'", "'# note'", f"'Disallow: q' || {_s(f'{_P} % 40')} || '?x=1'", "'User-agent: bot'", "'USER-AGENT: *'", f"'Disallow: /p' || {_s(f'{_P} % 40')} || '/'")]),
    "fx_targets": ("customer", ["'b' || " + _s(f"{_C} % 50"), f"'https://b' || {_s(f'{_C} % 50')} || '.test/' || " + _cases(_C, f"'p' || {_s(f'{_C} % 41')} || '/z'", f"'p' || {_s(f'{_C} % 41')} || '/open/z'", f"'q' || {_s(f'{_C} % 41')} || '/z'", "''") + f" || {_s(_C)}"]),
    "fx_sitemap": ("part", ["'m' || " + _s("p_size"), _MAP, f"lpad({_s(_P)}, 9, '0')", f"'<urlset><url><loc>' || {_MAP} || '/a' || {_s(f'{_P} % 300')} || '</loc></url><LOC> ' || {_MAP} || '/b' || {_s(f'{_P} % 30')} || '?x=1 </LOC><loc>https://other.test/c</loc><loc>' || {_MAP} || '/d.pdf</loc></urlset>'"]),
    "fx_titles": ("part", ["'t' || " + _s("p_size"), _P, "p_name || ' | ' || p_brand", _cases(_P, "'Home'", "''", "p_type", "p_brand || ' - Quay'"), _cases(_P, "''", "p_brand", "' '")]),
    "fx_images": ("part", ["'q' || " + _s("p_size"), _P, f"'https://q' || {_s('p_size')} || '.test/' || " + _cases(_P, "'dining'", "'rooms'", "''"), "0", f"'https://q' || {_s('p_size')} || '.test/img' || {_s(f'{_P} % 200')} || " + _cases(_P, "'.jpg?x=1'", "'.PNG'", "'.svg'", "'.webp#f'", "'/icon/b.png'"), _cases(_P, "p_name", "'Item 3 King bed'", "''"), _cases(_P, "''", "p_type"), _cases(_P, "''", "'photo 1 of 4 by the bar'", "p_brand", "'the  pool'")]),
    "fx_uploads": ("part", ["'u' || " + _s("p_size"), "'dir/' || p_name || ' photo?.png'", f"{_P} * 5000", "'t' || " + _s(_P)]),
    "fx_sites": ("customer", ["'k' || " + _s(_C), _cases(_C, f"'r' || {_s(_C)}", "NULL"), f"'o' || {_s(_C)}", _cases(_C, "'pending_review'", "'completed'", "'completed'"), f"'A' || {_s(_C)}", _cases(_C, "NULL", f"'B' || {_s(_C)}")]),
    "fx_requests": ("customer", ["'k' || " + _s(_C), _cases(_C, f"'r' || {_s(_C)}", f"'o' || {_s(_C)}", "''")]),
}


def frame(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The invented rows, and those that the given tables' rows make."""
    columns, rows = TABLES[name]
    made = spark.createDataFrame(rows, columns)
    if name not in FROM_TABLES:
        return made
    source, expressions = FROM_TABLES[name]
    kinds = [c.split() for c in columns.split(", ")]
    return made.unionByName(spread(table(spark, d, source)).select(*(F.expr(e).cast(k).alias(c) for e, (c, k) in zip(expressions, kinds))))


def sql(name: str) -> str:
    """The same rows as a SQL table expression named ``name``."""
    columns, rows = TABLES[name]
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    kinds = [{"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}[k] for k in kinds]

    def cell(v, kind):
        text = "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
        return f"{text}::{kind}"

    made = f"VALUES {', '.join('(' + ', '.join(map(cell, r, kinds)) + ')' for r in rows)}"
    if name in FROM_TABLES:
        source, expressions = FROM_TABLES[name]
        made += f" UNION ALL SELECT {', '.join(f'({e})::{k}' for e, k in zip(expressions, kinds))} FROM {source}"
    return f"({made}) AS {name}({', '.join(names)})"
