"""Records of small sites, worked out by hand: which pages count, and what image heads add."""

import struct

from sitefacts.operators import assemble, pages
from sitefacts.sources import demo


def _site(spark):
    body = lambda *x: "<!DOCTYPE html><body>" + "".join(x)
    link = lambda *paths: "".join(f"<a href='{p}'>to {p}</a><br>" for p in paths)
    rows = [
        ("https://q.test/start", "<title>Quay Hotel | Home</title>" + body(link("/deep", "/gone"), "<p>Call (415) 555-0198<p>Check-in: 3:00 PM<img src=/a.png alt='Front entrance'><img src=/b.jpg>")),
        ("https://q.test/deep", body(link("/deeper"), "<figure><img src='/c.gif'><figcaption>The pool</figcaption></figure>", "<table><tr><td>Heated pool and free Wi-Fi<tr><td>x</table>")),
        ("https://q.test/deeper", body("end <img src=/d.webp> <img src=/e.png>")),
    ]
    rows += [(f"https://q.test/p{k}", body(f"page {k}")) for k in range(120)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    return pages.site_pages(frame)


def test_a_record_holds_the_pages_that_a_crawl_reads(spark):
    found = assemble.crawled(pages.parsed(_site(spark))).select("page_seq", "url").orderBy("page_seq").collect()
    got = [r.url.removeprefix("https://q.test") for r in found]
    # The start, then what a site map names (80 urls, the linked page among them), then links by score: deeper comes last.
    assert [r.page_seq for r in found] == list(range(len(found))) and len(found) == 81
    assert got[:4] == ["/start", "/deep", "/deeper", "/p0"] and got[-1] == "/p77"


def test_a_crawl_follows_links_beyond_the_site_map(spark):
    chain = [(k, f"https://z.test/n{k}", f"<a href='/n{k + 1}'>next</a>") for k in range(300)]
    shuffled = [(0, *chain[0][1:])] + [(1 + (k * 7) % 299, f"https://z.test/n{k}", html) for k, _, html in chain[1:]]
    found = assemble.crawled(pages.parsed(pages.site_pages(spark.createDataFrame(shuffled, "page_id long, url string, html string"))))
    urls = [r.url for r in found.orderBy("page_seq").collect()]
    assert len(urls) == 90 and urls[0] == "https://z.test/n0" and "https://z.test/n1" in urls


def test_image_heads_are_joined_into_records(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 40) + b"\x08\x02\0\0\0"
    gif = b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0" * 8
    files = spark.createDataFrame([("https://q.test/a.png", png), ("https://q.test/b.jpg", b"\xff\xd8\xff\xc0\x00"), ("https://q.test/c.gif", gif), ("https://q.test/e.png", png)], "url string, content binary")
    records, sure = assemble.extract(_site(spark), demo.AS_OF, files)
    data = records.first().data
    assert [(p.url.rsplit("/")[-1], p.format, p.width, p.height, p.error) for p in data.metadata.image_probe] == [("a.png", "png", 30, 40, None), ("b.jpg", None, None, None, "unsupported"), ("c.gif", "gif", 5, 6, None), ("d.webp", None, None, None, "unreadable")]
    assert data.website == "https://q.test/start" and data.contact.phone == "(415) 555-0198" and data.policies.check_in.endswith("00 PM") and data.amenities.pool and data.amenities.wifi
    assert [x.caption for x in data.metadata.image_details][:3] == ["", "", "The pool"] and len(data.metadata.source_pages) == 81
    assert records.count() == 1 and sure.where("path = 'amenities.pool'").first().confidence > 0
    plain = assemble.extract(_site(spark), demo.AS_OF)[0].first().data
    assert plain.metadata.image_probe is None and plain.images == data.images
