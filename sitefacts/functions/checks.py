"""Plausibility of field values and their normal forms. Blank values are plausible."""

# The short patterns inside the functions below, which must read values as they are read elsewhere.

from __future__ import annotations

from pyspark.sql import functions as F

from sitefacts.functions import vocab
from sitefacts.functions.rx import blank, has, squeeze, swap, trim


def digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def phone(value):
    n = digits(value)
    return blank(value) | (has(trim(value), vocab.PLAUSIBLE_PHONE) & ((F.length(n) == 10) | ((F.length(n) == 11) & n.startswith("1"))))


def email(value):
    return blank(value) | has(trim(value), vocab.PLAUSIBLE_EMAIL)


def address(value):
    return blank(value) | (has(trim(value), vocab.STREET) & has(trim(value), vocab.ZIP))


def time(value):
    return blank(value) | has(trim(value), vocab.PLAUSIBLE_TIME)


def bad_email(value):
    low = F.lower(value)
    out = F.lit(False)
    for x in vocab.BAD_EMAIL_PARTS:
        out = out | low.contains(x)
    for x in vocab.BAD_EMAIL_ENDS:
        out = out | low.endswith(x)
    return out


def clean_email(value):
    """As written in structured data: ``mailto:`` and closing punctuation gone, blank if it is no real address."""
    value = swap(swap(trim(value), "^mailto:", ""), "[),.;:]+$", "")
    return F.when(bad_email(value), "").otherwise(value)


def normal_phone(value):
    return F.when(F.length(F.regexp_replace(value, r"[^0-9+]", "")) < 10, trim(value)).otherwise(squeeze(value))


def normal_time(value):
    return trim(swap(swap(swap(value, r"\s+", " "), r"\ba\.m\.", "AM"), r"\bp\.m\.", "PM"))


def pick(staff, scraped):
    """The reviewer's value, or the extracted one where that is blank."""
    return F.when(blank(staff), trim(scraped)).otherwise(trim(staff))


def hours(value):
    """Opening hours, one range a line, weekdays by three letters."""

    def one(x):
        for short, name in vocab.DAYS.items():
            x = swap(x, rf"\b{short}\b", name, fold=False)
        return squeeze(swap(swap(x, r"\b(\d{1,2}):(\d{2})-(\d{1,2}):(\d{2})\b", "$1:$2 - $3:$4"), r",\s*", ", "))

    return F.array_join(F.filter(F.transform(F.split(value, r"\s*\|\s*"), one), lambda x: x != ""), "\n")


def title(value):
    """The longest part of a title between bars and dashes, if it has over four characters; else its first part."""
    parts = F.transform(F.split(value, r"\s*[|\-–]\s*"), trim)
    longest = F.aggregate(parts, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when((F.size(parts) >= 2) & (F.length(longest) > 4), longest).otherwise(F.get(parts, F.lit(0)))


def generic_title(value):
    return has(trim(value), vocab.GENERIC_TITLE)


def image_text(value):
    value = swap(swap(swap(value, r"\bItem\s*\d+\b", " "), r"\bLink to Larger Image\b", " "), r"\b(image|photo)\s+\d+\s+of\s+\d+\b", " ")
    return F.left(squeeze(value), F.lit(220))


def image_category(page_url, alt, caption):
    text = F.lower(F.concat_ws(" ", page_url, alt, caption))
    out = F.lit("General")
    for name, words in reversed(vocab.IMAGE_CATEGORIES):
        out = F.when(has(text, words, fold=False), name).otherwise(out)
    return out


def csv_field(value):
    return F.when(value.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def public_error(message):
    return F.when(has(message, vocab.UNREADABLE), vocab.UNREADABLE_PUBLIC).otherwise(message)


def contact_lines(contacts):
    """Contacts as lines ``label | value | note``."""
    return F.array_join(F.transform(contacts, lambda c: F.concat_ws(" | ", c["label"], c["value"], c["note"])), "\n")


def contacts_of(text):
    """Lines ``label | value | note`` as contacts; a line without a value part is itself the value, blank labels get numbers."""

    def one(line, n):
        parts = F.transform(F.split(line, r"\|"), trim)
        at = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
        number = F.concat(F.lit("Item "), (n + 1).cast("string"))
        full = at(1) != ""
        return F.struct(F.when(full & (at(0) != ""), at(0)).otherwise(number).alias("label"), F.when(full, at(1)).otherwise(at(0)).alias("value"), F.when(full, at(2)).otherwise("").alias("note"))

    return F.transform(F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != ""), one)
