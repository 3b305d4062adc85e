"""Pieces of DuckDB SQL that say what the column functions say."""

from __future__ import annotations

from sitefacts.functions import vocab


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(x, pattern, fold=True):
    return f"regexp_matches({x}, {q(pattern)}{', ' + q('i') if fold else ''})"


def first(x, pattern, group=0, fold=True):
    return f"regexp_extract({x}, {q(pattern)}, {group}{', ' + q('i') if fold else ''})"


def every(x, pattern, group=0, fold=True):
    return f"regexp_extract_all({x}, {q(pattern)}, {group}{', ' + q('i') if fold else ''})"


def count(x, pattern, fold=True):
    return f"len({every(x, pattern, 0, fold)})::BIGINT"


def swap(x, pattern, to, fold=True):
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, {q('gi' if fold else 'g')})"


def trim(x):
    return swap(x, r"^\s+|\s+$", "", False)


def squeeze(x):
    return trim(swap(x, r"\s+", " ", False))


def host(url):
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def origin(url):
    raw = f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
    return f"nullif(regexp_replace(regexp_replace({raw}, '^(http://[^/]*):80$', '\\1'), '^(https://[^/]*):443$', '\\1'), '')"


def path(url):
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def url_key(url):
    p = f"regexp_replace({path(url)}, '/+$', '')"
    return f"CASE WHEN {origin(url)} IS NULL THEN regexp_replace({url}, '#.*$', '') ELSE {origin(url)} || CASE WHEN {p} = '' THEN '/' ELSE {p} END || regexp_extract({url}, '^[^?#]*([?][^#]+)', 1) END"


def visible(html):
    out = swap(swap(html, r"(?is)^.*?<body\b[^>]*>", "", False), r"(?is)</body\b.*$", "", False)
    for name in ("script", "style", "noscript", "svg"):
        out = swap(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "", False)
    out = swap(out, r"(?s)<!--.*?-->", "", False)
    out = swap(out, rf"(?i)<br\b[^>]*>|</(?:{'|'.join(vocab.BLOCK_TAGS[1:])})\s*>", "\n", False)
    out = entities(swap(out, "<[^>]*>", "", False))
    out = swap(swap(out, r"[ \t\f\v]+", " ", False), r"\n[ \t]+", "\n", False)
    return trim(swap(out, r"\n{3,}", "\n\n", False))


def entities(x):
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def tag_text(html):
    return trim(entities(swap(html, "<[^>]*>", "", False)))


def title(html):
    return tag_text(first(html, r"(?is)<title[^>]*>(.*?)</title>", 1, False))


def phone_ok(v):
    n = swap(v, "[^0-9]", "", False)
    return f"({trim(v)} = '' OR ({has(trim(v), vocab.PLAUSIBLE_PHONE)} AND (length({n}) = 10 OR (length({n}) = 11 AND {n} LIKE '1%'))))"


def bad_email(v):
    parts = [f"contains(lower({v}), {q(x)})" for x in vocab.BAD_EMAIL_PARTS] + [f"ends_with(lower({v}), {q(x)})" for x in vocab.BAD_EMAIL_ENDS]
    return "(" + " OR ".join(parts) + ")"


def hours(v):
    out = "p"
    for short, name in vocab.DAYS.items():
        out = swap(out, rf"\b{short}\b", name, False)
    out = squeeze(swap(swap(out, r"\b(\d{1,2}):(\d{2})-(\d{1,2}):(\d{2})\b", r"\1:\2 - \3:\4", False), r",\s*", ", ", False))
    return f"array_to_string(list_filter(list_transform(string_split_regex({v}, '\\s*\\|\\s*'), lambda p: {out}), lambda p: p <> ''), chr(10))"


def clean_title(v):
    parts = f"list_transform(string_split_regex({v}, '\\s*[|\\-–]\\s*'), lambda p: {trim('p')})"
    long = f"list_reduce({parts}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"
    return f"CASE WHEN len({parts}) >= 2 AND length({long}) > 4 THEN {long} ELSE ({parts})[1] END"


def image_text(v):
    out = swap(swap(swap(v, r"\bItem\s*\d+\b", " "), r"\bLink to Larger Image\b", " "), r"\b(image|photo)\s+\d+\s+of\s+\d+\b", " ")
    return f"left({squeeze(out)}, 220)"


def category(v):
    return "CASE " + " ".join(f"WHEN {has(f'lower({v})', p, False)} THEN {q(n)}" for n, p in vocab.IMAGE_CATEGORIES) + " ELSE 'General' END"


def room_name(v):
    out = swap(swap(v, r"\bItem\s*\d+\b", " "), r"\bLink to Larger Image\b", " ")
    out = swap(swap(out, r"^\s*Rooms?\s*&\s*Suites?\s*", ""), r"^\s*(?:Rooms?|Suites?|Accommodations?)\s*[:\-]\s*", "")
    return trim(swap(swap(out, r"\s+", " "), r"\s+([,.;:])", r"\1"))


def question_free(parts):
    return f"list_filter({parts}, lambda p: NOT {has('p', vocab.QUESTION)})"


def sentences(v, also=""):
    return f"string_split_regex({swap(v, r'([?.!])\s+', chr(92) + '1' + chr(1), False)}, {q(chr(1) + also)})"


def menu_line(v):
    out = swap(swap(v, r"\s+", " "), r"\s+([.,;:])", r"\1")
    return f"left({trim(swap(out, vocab.MENU_EXTRA, ''))}, 140)"


def dish(v):
    return f"(NOT {has(v, vocab.MENU_REJECT)} AND ({has(v, vocab.FOOD)} OR {has(v, vocab.MENU_SHAPE, False)}) AND length({v}) >= 6)"


def csv(v):
    return f"""CASE WHEN regexp_matches({v}, '[",\n]') THEN '"' || replace({v}, '"', '""') || '"' ELSE {v} END"""


def score(hits, negated):
    return f"CASE WHEN {hits} = 0 THEN 0.0::DOUBLE ELSE round(least(0.95, 0.55 - CASE WHEN {negated} THEN 0.25 ELSE 0 END + CASE WHEN {hits} > 1 THEN 0.15 ELSE 0 END + CASE WHEN {hits} > 3 THEN 0.1 ELSE 0 END), 2)::DOUBLE END"
