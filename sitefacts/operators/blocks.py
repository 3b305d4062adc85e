"""Blocks of lines in a text: policies, dining venues and menus. All are column expressions over one row's text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefacts.functions import checks, vocab
from sitefacts.functions.rx import all_of, first_of, first_wins, has, let, lines_of, swap, trim
from sitefacts.operators.facts import venue_is_weak


def _grown(lines, start, stops, ends, most_lines: int):
    """The block that begins at line ``start``, of ``most_lines`` at most: lines follow until ``stops(line, chars)``; ``ends(line, chars)`` closes it after a line."""
    head = F.get(lines, start)
    begin = F.struct(F.lit(False).alias("done"), F.array(head).alias("lines"), F.length(head).alias("chars"))

    def add(state, line):
        chars = state["chars"] + 1 + F.length(line)
        longer = F.struct(ends(line, chars).alias("done"), F.array_append(state["lines"], line).alias("lines"), chars.alias("chars"))
        stopped = F.struct(F.lit(True).alias("done"), state["lines"].alias("lines"), state["chars"].alias("chars"))
        return F.when(state["done"], state).when(stops(line, state["chars"]), stopped).otherwise(longer)

    rest = F.slice(lines, start + 2, F.lit(most_lines - 1))
    return F.aggregate(rest, begin, add, lambda s: s["lines"])


def _starts(lines, pattern):
    """Positions of the lines that match."""
    return F.filter(F.transform(lines, lambda x, i: F.when(has(x, pattern), i)), lambda i: i.isNotNull())


def without_questions(parts):
    return F.filter(parts, lambda x: ~has(x, vocab.QUESTION))


def policy_text(lines):
    """The statement in lines of a policy section: questions, its label and stock questions go."""
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[?.!])\s+")))
    text = swap(F.array_join(without_questions(parts), " "), vocab.POLICY_PREFIX, "")
    text = swap(without_stock_questions(text), r"\s+", " ")
    return trim(swap(text, r"\s+([.,;:])", "$1"))


def without_stock_questions(text):
    return let(text, lambda x: F.when(x.contains("?"), swap(x, vocab.STOCK_QUESTIONS, "")).otherwise(x))


def policies(text):
    """``pet, cancellation, smoking``: the block of each, over lines that are read once."""
    return let(
        lines_of(text),
        lambda lines: F.struct(
            _unless_advert(_policy_among(lines, vocab.PET_LABEL, vocab.PET_SIGNAL)).alias("pet"), _policy_among(lines, vocab.CANCEL_LABEL, vocab.CANCEL_SIGNAL).alias("cancellation"), _policy_among(lines, vocab.SMOKE_LABEL, vocab.SMOKE_SIGNAL).alias("smoking")
        ),
    )


def policy_block(text, label: str, signal: str):
    """``value, confidence`` of the first block under a label line that says something about the matter; blank and 0 if none."""
    return let(lines_of(text), lambda lines: _policy_among(lines, label, signal))


def _policy_among(lines, label: str, signal: str):
    stops = lambda x, chars: (chars >= vocab.POLICY_GROW) | (F.length(x) < 3) | (has(x, vocab.SECTION_STOP) & ~has(x, label))
    ends = lambda x, chars: (chars > vocab.POLICY_SENTENCE) & x.rlike(r"[.!?]\z")
    most = vocab.POLICY_GROW // 4 + 2  # a line that is added has three characters or more, and one joins it

    def told(grown):
        return F.struct(F.left(policy_text(grown), F.lit(vocab.POLICY_CUT)).alias("value"), F.when(F.size(grown) > 1, 0.62).otherwise(0.48).alias("confidence"))

    none = F.struct(F.lit("").alias("value"), F.lit(0.0).alias("confidence"))
    fits = lambda b: (F.length(b["value"]) >= vocab.POLICY_LEAST) & has(b["value"], signal)

    def first(held, start):
        # A block that fits has text; none is worked out after it.
        return F.when(held["value"] != "", held).otherwise(let(let(_grown(lines, start, stops, ends, most), told), lambda b: F.when(fits(b), b).otherwise(held)))

    return F.coalesce(F.aggregate(_starts(lines, label), none, first), none)


def pet_policy(text):
    """As ``policy_block``; a block that only advertises is none."""
    return _unless_advert(policy_block(text, vocab.PET_LABEL, vocab.PET_SIGNAL))


def _unless_advert(block):

    def told(found):
        only_advert = has(found["value"], vocab.PET_MARKETING) & ~has(found["value"], vocab.PET_DETAIL)
        return F.when(only_advert, F.struct(F.lit("").alias("value"), F.lit(0.0).alias("confidence"))).otherwise(found)

    return let(block, told)


def policy_answer(kind: str, text):
    """A policy statement cleaned of questions and labels; blank if it does not speak of the matter."""
    return let(answer_text(text), lambda x: told_of(kind, x))


def told_of(kind: str, statement):
    return F.when(has(statement, vocab.ANSWER_SIGNAL[kind]), statement).otherwise("")


def answer_text(text):
    """A policy statement without questions and labels."""
    parts = F.split(text, r"(?<=[?.!])\s+|\n+")
    text = swap(F.array_join(without_questions(parts), " "), vocab.ANSWER_PREFIX, "")
    return trim(swap(without_stock_questions(text), r"\s+", " "))


def dining_blocks(text):
    """Text blocks that begin at each line about food; kept if a price, a meal or a time stands in them."""
    stops = lambda x, chars: (has(x, vocab.DINING_STOP) & ~has(x, vocab.DINING_START)) | (F.length(x) > vocab.DINING_LONGEST)
    never = lambda x, chars: F.lit(False)
    blocks = let(lines_of(text), lambda lines: F.transform(_starts(lines, vocab.DINING_START), lambda i: F.array_join(_grown(lines, i, stops, never, vocab.DINING_LINES), "\n")))
    return F.slice(F.filter(blocks, lambda b: has(b, vocab.PRICE) | has(b, vocab.DINING_KEEP)), 1, vocab.DINING_BLOCKS)


def menu_line(line):
    line = swap(swap(line, r"\s+", " "), r"\s+([.,;:])", "$1")
    return F.left(trim(swap(line, vocab.MENU_EXTRA, "")), F.lit(140))


def _dish(line):
    return (F.length(line) >= 6) & (has(line, vocab.FOOD) | has(line, vocab.MENU_SHAPE, fold=False)) & ~has(line, vocab.MENU_REJECT)


def menu_items(block):
    """Priced dishes: by line, then by name and price within lines; each once."""
    lines = F.transform(F.split(block, "\n|•"), menu_line)
    own = F.filter(lines, lambda x: has(x, vocab.PRICE) & _dish(x) & ~((F.length(x) < 24) & has(x, vocab.MENU_NOISE)))
    own = F.transform(own, lambda x: swap(x, r"\s[-–—]\s*", " - "))
    names, prices = (all_of(block, vocab.MENU_INLINE, g, fold=False) for g in (1, 3))
    inline = F.filter(F.zip_with(names, prices, lambda n, p: menu_line(F.concat(n, F.lit(" - "), p))), _dish)
    return F.slice(F.array_distinct(F.concat(own, inline)), 1, vocab.MAX_MENU)


def venues(text, titles):
    """Venues that a text describes; ``titles`` are the site's page titles."""

    def venue(block):
        parts = F.struct(trim(first_of(block, vocab.VENUE_NAME, 1, fold=False)).alias("name"), F.array_join(all_of(block, vocab.HOURS_LINE, 0), " | ").alias("ranges"), menu_items(block).alias("priced"))
        other = F.slice(F.transform(all_of(block, vocab.DISH_PHRASE, 0), trim), 1, 10)

        def told(p):
            said = F.when(p["ranges"] != "", p["ranges"]).otherwise(first_of(block, vocab.OPEN_DAILY, 0))
            return F.struct(
                F.when(p["name"] != "", p["name"]).when(F.size(p["priced"]) > 0, "Dining").otherwise("").alias("restaurant_name"),
                checks.hours(said).alias("hours"),
                F.when(F.size(p["priced"]) > 0, p["priced"]).otherwise(other).alias("menu_items"),
            )

        return let(parts, told)

    rows = F.transform(F.slice(dining_blocks(text), 1, vocab.DINING_USED), venue)
    return merged_venues(F.filter(rows, lambda v: ~venue_is_weak(v["restaurant_name"], v["hours"], v["menu_items"], titles)))


def merged_venues(*lists):
    """Venues of the lists in order, one for each name."""
    return first_wins(F.concat(*lists), lambda v: F.lower(trim(v["restaurant_name"])), vocab.MAX_VENUES)
