"""Url columns: keys, resolution, origins, and how promising a link is."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefacts.functions import vocab
from sitefacts.functions.rx import has, let, swap, trim


def part(url, name: str):
    return F.try_parse_url(url, F.lit(name))


def with_scheme(url):
    """Trimmed input, https assumed where no scheme is given."""
    url = trim(url)
    return F.when(has(url, "^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url):
    return F.lower(part(url, "HOST"))


def origin(url):
    """Scheme, host and port, the scheme's own port left out; null if the url has none."""
    joined = F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "AUTHORITY")))
    return F.regexp_replace(F.regexp_replace(joined, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")


def same_origin(a, b):
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def url_key(url):
    """Without fragment and trailing slashes of the path; the query stays."""

    def of(u):
        path = F.regexp_replace(F.coalesce(part(u, "PATH"), F.lit("")), "/+$", "")
        query = F.coalesce(F.concat(F.lit("?"), F.nullif(part(u, "QUERY"), F.lit(""))), F.lit(""))
        return F.coalesce(F.concat(origin(u), let(path, lambda p: F.when(p == "", "/").otherwise(p)), query), F.regexp_replace(u, "#.*$", ""))

    return let(url, of)


def image_key(url):
    """Without query and fragment, in lower case."""
    return F.lower(F.regexp_replace(url, "[?#].*$", ""))


_DOTS = r"(?i)^https?://[^/?#]*[^?#]*/[.]{1,2}(/|[?#]|\z)"
_SPLIT = r"^([^:/?#]+://[^/?#]*)([^?#]*)((?s:.*))\z"


def without_dots(url):
    """``url`` with the segments ``.`` and ``..`` of its path worked out."""

    def of(u):
        segments = F.split(F.regexp_extract(u, _SPLIT, 2), "/")
        add = lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.lit(1), F.size(held) - 1))).otherwise(F.array_append(held, x))
        held = F.aggregate(segments, F.expr("cast(array() as array<string>)"), add)
        closed = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
        path = F.concat(F.array_join(held, "/"), closed)
        return F.concat(F.regexp_extract(u, _SPLIT, 1), path, F.regexp_extract(u, _SPLIT, 3))

    return F.when(url.rlike(_DOTS), of(url)).otherwise(url)


def resolve(href, page):
    """``href`` as an absolute url of ``page``, dot segments worked out."""

    def of(href):
        base, path = origin(page), F.coalesce(F.nullif(part(page, "PATH"), F.lit("")), F.lit("/"))
        return (
            F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(F.lower(part(page, "PROTOCOL")), F.lit(":"), href))
            .when(href.startswith("/"), F.concat(base, href))
            .when(href.startswith("?"), F.concat(base, path, href))
            .when(href.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), href))
            .otherwise(F.concat(base, F.regexp_replace(path, "[^/]*$", ""), href))
        )

    return let(let(trim(href), of), without_dots)


def is_asset(url):
    return has(url, vocab.ASSET)


def is_photo(url):
    return has(url, vocab.PHOTO) & ~has(url, vocab.NOT_PHOTO)


def link_score(url, anchor):
    url, anchor = F.lower(url), F.lower(anchor)
    hit = lambda text, words, points: F.when(text.rlike(words), points).otherwise(0)
    return hit(url, vocab.LINK_PRIORITY, 3) + hit(anchor, vocab.LINK_PRIORITY, 2) + hit(url, vocab.LINK_KEY, 1)


def child_priority(score, parent_score):
    return score + 0.01 * parent_score


def plausible(url):
    url = trim(url)
    return (url == "") | F.coalesce(F.lower(part(url, "PROTOCOL")).isin("http", "https") & (part(url, "HOST") != ""), F.lit(False))


def safe_basename(name):
    """A file name for storage: last path part, other characters replaced, 120 characters at most."""
    return F.left(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"[^A-Za-z0-9_.\-()+ ]", "_"), F.lit(120))


def mime_type(name):
    out = F.lit("application/octet-stream")
    for ending, kind in reversed(vocab.MIME):
        out = F.when(F.lower(name).endswith(f".{ending}"), kind).otherwise(out)
    return out


def display_name(url):
    """The url as a title: scheme and ``www.`` left out."""
    return swap(swap(url, "^https?://", ""), r"^www\.", "")
