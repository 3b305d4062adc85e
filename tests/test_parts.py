"""Column functions, file readers and streams by themselves."""

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitefacts.functions import checks, urls
from sitefacts.functions.rx import first_wins, has, rx, trim
from sitefacts.operators import images, pages, review
from sitefacts.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, pattern, expected",
    [("x café y", r"\bcaf\b", True), ("xcaf", r"\bcaf\b", False), ("ÉTÉ", "été", True), ("a\n", r"^a$", False), ("a b", r"a\sb", True), ("a b", r"a[^\s]b", False), ("CAFÉ bar", r"\bcafé\b", False)],
)
def test_patterns_mean_what_they_mean_in_a_browser(spark, text, pattern, expected):
    assert one(spark, has(F.lit(text), pattern)) is expected


def test_rx_keeps_classes_and_escapes():
    assert rx(r"[a$]\$") == r"(?iu)[a$]\$"


def test_white_space_of_any_kind_is_trimmed(spark):
    assert one(spark, trim(F.lit(" \n a b ﻿"))) == "a b"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["a", "A", "b", "", "c", " b"]), max_size=12))
def test_first_of_each_key_stays(spark, items):
    expected, seen = [], set()
    for x in items:
        if x.lower() and x.lower() not in seen:
            seen.add(x.lower())
            expected.append(x)
    column = F.array(*map(F.lit, items)).cast("array<string>")
    assert one(spark, first_wins(column, F.lower)) == expected
    assert one(spark, first_wins(first_wins(column, F.lower), F.lower)) == expected


def test_null_and_empty_pages(spark):
    rows = spark.createDataFrame([(1, None, "<p>x"), (2, "https://a.test/", None), (3, "nourl", "x"), (4, "https://a.test/b", "")], "page_id long, url string, html string")
    found = pages.site_pages(rows)
    assert sorted((r.site, r.page_seq) for r in found.collect()) == [("a.test", 2), ("a.test", 4)]
    assert pages.links(found).count() == 0
    assert [r.t for r in found.select(pages.visible_text(F.col("html")).alias("t")).collect()] == ["", ""]


def _png(width, height):
    body = b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body))


def test_image_files_are_measured(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\x03" * 12
    found = {"a.png": _png(3, 4), "b.JPG": jpeg, "c.gif": b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0" * 8, "d.webp": b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (6).to_bytes(3, "little") + (7).to_bytes(3, "little"), "e.png": b"broken", "f.png": b"\x89PNG\r\n\x1a\n" + b"\0" * images.PROBE_BYTES}
    for name, data in found.items():
        (tmp_path / name).write_bytes(data)
    rows = files.files(spark, str(tmp_path))
    assert {r.name: r.mime for r in rows.collect()}["b.JPG"] == "image/jpeg"
    asked = rows.select(F.lit("s").alias("site"), F.lit(1).alias("n"), F.col("name").alias("url"), "content")
    probed = {r.url: (r.format, r.width, r.height, r.error) for r in images.probe(asked).collect()}
    assert probed == {"a.png": ("png", 3, 4, None), "b.JPG": ("jpeg", 30, 20, None), "c.gif": ("gif", 5, 6, None), "d.webp": ("webp", 7, 8, None), "e.png": (None, None, None, "unsupported"), "f.png": (None, None, None, "too_large")}


def test_lines_are_written_in_order(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("b", 0, "x")], "site_id string, seq int, line string").repartition(3)
    files.write_text(lines, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out/site_id=a")).collect()] == ["one", "two"]


def test_plausible_urls(spark):
    for text, ok in (("", True), ("https://a.test/x?y=1", True), ("HTTP://A", True), ("mailto:a@b", False), ("/x", False), ("https://", False)):
        assert one(spark, urls.plausible(F.lit(text))) is ok, text


def test_contacts_go_there_and_back(spark):
    text = "Desk | 1 | day\nBar | 2 | "
    assert one(spark, checks.contact_lines(checks.contacts_of(F.lit(text)))) == text


def test_first_submission_wins_in_a_batch(spark):
    batch = review.first_submissions(spark.createDataFrame([("a", 2), ("a", 1)], "site_id string, submitted_at int"))
    assert batch.first().submitted_at == 1


@pytest.mark.parametrize(
    "href, expected",
    [
        ("../e/./f?x=../y#./z", "http://a.test/c/e/f?x=../y#./z"), ("../../../x", "http://a.test/x"), ("..", "http://a.test/c/"), (".", "http://a.test/c/d/"), ("/a/b/../c/", "http://a.test/a/c/"),
        ("./", "http://a.test/c/d/"), ("a..b/.c", "http://a.test/c/d/a..b/.c"), ("https://o.test/p/../q", "https://o.test/q"), ("mailto:a@b/../c", "mailto:a@b/../c"), ("//o.test/./p", "http://o.test/p"),
    ],
)
def test_dot_segments_are_worked_out(spark, href, expected):
    assert one(spark, urls.resolve(F.lit(href), F.lit("http://a.test/c/d/page?q"))) == expected


def test_structured_data_opens_at_any_depth(spark):
    import json

    from sitefacts.operators import jsonld

    node, deep = {"@type": "Hotel", "name": "Deep Inn"}, {"@type": "Hotel", "name": "First Inn"}
    for k in range(9):
        node = [node] if k % 2 else {"@graph": [{"@type": "Thing"}, node]}
    bodies = [("a", 0, 0, json.dumps(node)), ("a", 1, 0, json.dumps(deep)), ("b", 0, 0, "{bad"), ("b", 0, 1, json.dumps({"@graph": {"@graph": {"@type": "Hotel", "name": "One Graph"}}})), ("c", 0, 0, None)]
    found = jsonld.nodes(spark.createDataFrame(bodies, "site string, page_seq long, script_no int, body string"))
    assert found.where("site = 'a'").count() == 5 + 1 + 1
    assert {r.site: r.name for r in jsonld.hints(found).collect()} == {"a": "Deep Inn", "b": "One Graph"}
    assert jsonld.nodes(spark.createDataFrame([], "site string, page_seq long, script_no int, body string")).count() == 0


def test_scripts_of_structured_data_are_found(spark):
    from sitefacts.operators import jsonld

    html = """<script type="application/ld+json">{"a": 1}</script><SCRIPT id=x TYPE='application/ld+json' >
 [2]</script ><script>var x = '{}';</script><script type="application/json">{}</script>"""
    rows = jsonld.scripts(spark.createDataFrame([("s", 3, html), ("s", 4, None), ("t", 0, "")], "site string, page_seq long, html string")).collect()
    assert [(r.page_seq, r.script_no, r.body.strip()) for r in rows] == [(3, 0, '{"a": 1}'), (3, 1, "[2]")]


@given(st.lists(st.sampled_from(["", "a", "b", "A", "c"]), max_size=12))
@settings(max_examples=15, deadline=None)
def test_first_of_equal_keys_wins_in_order(spark, items):
    seen, expected = set(), []
    for k, x in enumerate(items):
        if x and x.lower() not in seen:
            seen.add(x.lower())
            expected.append((x, k))
    given_ = F.lit(None).cast("array<struct<v:string,k:int>>") if items is None else F.expr("cast(array() as array<struct<v:string,k:int>>)") if not items else F.array(*(F.struct(F.lit(x).alias("v"), F.lit(k).alias("k")) for k, x in enumerate(items)))
    assert [tuple(x) for x in one(spark, first_wins(given_, lambda x: F.lower(x["v"])))] == expected


def test_verification_reads_start_and_root_with_their_titles(spark):
    from sitefacts.functions import vocab

    far = "x " * (vocab.VERIFY_CUT // 2) + "hotel resort suites check-in reservations"
    near = far[4:200] + far[-50:]
    sites = spark.createDataFrame([("a", "https://plain.test/start/?x=1#top")], "site string, url string")
    none = sites.select("site", *(F.lit(False).alias(c) for c in ("has_name", "has_address", "has_phone")))

    def score(*rows):
        own = spark.createDataFrame([("a", k, *r) for k, r in enumerate(rows)], "site string, page_seq long, url string, title string, text string")
        return pages.site_scores(sites, own, none).select("score", "accepted").first()

    start, root, other = "https://plain.test/start?x=1", "https://plain.test/", "https://plain.test/rooms"
    assert score((start, "", far)) == (0, False) and score((start, "", near)).score > 0
    assert score((other, "", near), (start, "x", "")) == (0, False)  # no other page counts
    assert score((root, "", near)).score == score((start, "", near)).score
    assert score((start, "Hotel", ""), (root, "Resort", "inn")).score == 3  # titles count too
    assert score((start, "bed", "and"), (root, "breakfast", "")).score == 1  # as one text
    assert score((start, "", "hotel"), (start, "", "hotel hotel")).score == 1  # a page is read once
    assert score((root, "hotel inn", "lodge motel resort rooms check-in amenities reservations"), (start, "", "pool spa parking")).accepted
    assert pages.site_scores(sites, spark.createDataFrame([], "site string, page_seq long, url string, title string, text string"), none).first().accepted is False
