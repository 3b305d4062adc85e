"""Amenities, services, room types and times as columns over a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefacts.functions import vocab
from sitefacts.functions.rx import count_of, first_of, has, let, swap, trim

PRESENT = 0.55


def term_score(hits, negated):
    """Confidence from a count of hits and whether any is negated."""
    score = F.lit(0.55) - F.when(negated, 0.25).otherwise(0.0) + F.when(hits > 1, 0.15).otherwise(0.0) + F.when(hits > 3, 0.1).otherwise(0.0)
    return F.when(hits > 0, F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.0), score)), 2)).otherwise(0.0)


def amenity_scores(text):
    """A map of amenity to confidence."""
    low = F.lower(text)

    def score(yes, no):
        return let(count_of(low, yes), lambda hits: term_score(hits, has(low, no)))

    return F.create_map(*(x for name, (yes, no, _) in vocab.AMENITIES.items() for x in (F.lit(name), score(yes, no))))


def services(text):
    return F.filter(F.array(*(F.when(has(text, p), F.lit(label)) for label, p in vocab.SERVICES)), lambda x: x.isNotNull())


def check_in(text):
    return trim(first_of(text, vocab.CHECK_IN, 2))


def check_out(text):
    return trim(first_of(text, vocab.CHECK_OUT, 2))


def room_name(text):
    """A room type without gallery captions and section labels."""
    text = swap(swap(text, r"\bItem\s*\d+\b", " "), r"\bLink to Larger Image\b", " ")
    text = swap(swap(text, r"^\s*Rooms?\s*&\s*Suites?\s*", ""), r"^\s*(?:Rooms?|Suites?|Accommodations?)\s*[:\-]\s*", "")
    return trim(swap(swap(text, r"\s+", " "), r"\s+([,.;:])", "$1"))


def is_room(text):

    def named(name):
        said = has(name, vocab.ROOM_NAME) & has(name, vocab.SUITE_WORDS) & ~has(name, vocab.ROOM_NOISE) & ~has(name, vocab.ROOM_PROSE)
        return (F.length(name) >= 4) & (F.length(name) <= 70) & ~has(name, r"\||\d{3,}|[.!?]") & said & (F.size(F.split(name, r"\s+")) <= 7)

    return ~has(text, r"^\s*[•*-]") & let(room_name(text), named)


def rooms(text):
    """Room types: lines first, bulleted lines then, each once."""
    bullets = F.regexp_extract_all(text, F.lit(vocab.ROOM_BULLET.replace(r"\s", r"[\s\x{A0}]")), F.lit(1))
    names = F.transform(F.concat(F.split(text, "\n"), bullets), room_name)
    return F.slice(F.array_distinct(F.filter(names, is_room)), 1, vocab.MAX_ROOMS)


def venue_is_weak(name, hours, menu, titles):
    """A venue that says nothing: no name, a generic name or a page's title without hours or menu, or a very short one."""
    name = trim(name)
    bare = (trim(hours) == "") & (F.size(menu) == 0)
    page = F.exists(titles, lambda t: (trim(t) != "") & (F.lower(trim(t)) == F.lower(name)))
    return (F.length(name) < 3) | (bare & (has(name, vocab.GENERIC_RESTAURANT) | page))


