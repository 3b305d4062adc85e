"""Images of pages with their captions, and image files."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.functions import checks, urls
from sitefacts.operators.pages import parsed

PER_PAGE, DETAILS, PROBED, PROBE_BYTES = 80, 60, 4, 2_500_000


def tags(pages: DataFrame) -> DataFrame:
    """``site, page_seq, page_url, pos, url, alt, title, caption``: image tags as written, metadata first."""
    return of_parsed(parsed(pages.where(F.lower("html").rlike("<ima?ge?|og:image|twitter:image"))))


def of_parsed(found: DataFrame) -> DataFrame:
    """``tags`` of pages that are parsed."""
    rows = found.select("site", "page_seq", F.col("url").alias("page_url"), F.posexplode("images").alias("pos", "x"))
    return rows.select("site", "page_seq", "page_url", "pos", urls.resolve(F.col("x.src"), F.col("page_url")).alias("url"), "x.alt", "x.title", "x.caption")


def assets(found: DataFrame) -> DataFrame:
    """``site, page_seq, pos, url, alt, caption, category``: likely photos of each page, one for each address."""
    rows = found.where(urls.is_photo(F.col("url"))).withColumn("key", urls.image_key(F.col("url")))
    rows = rows.withColumn("alt", checks.image_text(F.col("alt"))).withColumn("caption", checks.image_text(F.when(F.col("caption") != "", F.col("caption")).otherwise(F.col("title"))))
    rows = rows.withColumn("category", checks.image_category(F.col("page_url"), F.col("alt"), F.col("caption")))
    first = rows.groupBy("site", "page_seq", "key").agg(F.min(F.struct("pos", "url", "alt", "caption", "category")).alias("x")).select("site", "page_seq", "x.*")
    turn = F.row_number().over(Window.partitionBy("site", "page_seq").orderBy("pos"))
    return first.withColumn("turn", turn).where(F.col("turn") <= PER_PAGE).drop("turn")


def site_images(found: DataFrame, most: int | None = DETAILS) -> DataFrame:
    """``site, n, url, alt, caption, category``: photos of a site's pages in order, one for each address; all without ``most``."""
    rows = found.withColumn("key", urls.image_key(F.col("url"))).groupBy("site", "key").agg(F.min(F.struct("page_seq", "pos", "url", "alt", "caption", "category")).alias("x")).select("site", "x.*")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("page_seq", "pos"))).select("site", "n", "url", "alt", "caption", "category")
    return rows if most is None else rows.where(F.col("n") <= most)


def grouped(images: DataFrame, most: int = 12) -> DataFrame:
    """``site, category, group_no, n, url``: a site's photos by category, groups in order of appearance, ``most`` of each."""
    own = Window.partitionBy("site", "category").orderBy("n")
    rows = images.withColumn("first", F.min("n").over(Window.partitionBy("site", "category"))).withColumn("k", F.row_number().over(own)).where(F.col("k") <= most)
    return rows.select("site", "category", F.dense_rank().over(Window.partitionBy("site").orderBy("first")).alias("group_no"), F.col("k").alias("n"), "url")


def with_details(images: DataFrame, details: DataFrame) -> DataFrame:
    """``site, n, url`` with ``alt, caption`` of the first detail of exactly that address."""
    first = details.groupBy("site", "url").agg(F.min_by(F.struct("alt", "caption"), "n").alias("d"))
    return images.join(first, ["site", "url"], "left").select("site", "n", "url", "d.alt", "d.caption")


def measured(data: bytes | None) -> dict:
    """Format, width and height that an image file's head tells."""
    if data is None:
        return {"error": "unreadable"}
    if len(data) > PROBE_BYTES:
        return {"bytes": len(data), "error": "too_large"}
    out = {"bytes": len(data)}
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return out | {"format": "png", "width": struct.unpack(">I", data[16:20])[0], "height": struct.unpack(">I", data[20:24])[0]}
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return out | dict(zip(("width", "height"), struct.unpack("<HH", data[6:10]))) | {"format": "gif"}
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                size = [1 + int.from_bytes(data[k : k + 3], "little") for k in (24, 27)]
            elif data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                size = [1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)]
            else:
                size = [x & 0x3FFF for x in struct.unpack("<HH", data[26:30])]
            return out | {"format": "webp", "width": size[0], "height": size[1]}
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return out | {"format": "jpeg", "width": width, "height": height}
                at += 2 + length
    except struct.error:
        pass
    return out | {"error": "unsupported"}


def probe(files: DataFrame, most: int = PROBED) -> DataFrame:
    """``site, n, url, bytes, format, width, height, error`` of the first ``most`` files of each site, ``site, n, url, content``."""
    fields = [("bytes", pa.int64()), ("format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("error", pa.string())]

    def run(batches):
        for batch in batches:
            found = [measured(x) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("site", "n", "url")] + [pa.array([f.get(k) for f in found], t) for k, t in fields], ["site", "n", "url", *(k for k, _ in fields)])

    rows = files.select("site", F.col("n").cast("long").alias("n"), "url", "content").where(F.col("n") <= most)
    return rows.mapInArrow(run, "site string, n long, url string, bytes long, format string, width long, height long, error string")
