"""Patterns with ECMAScript meaning on Spark's engine, and the small text functions built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

# Both are built in to Spark's engine and cost no folding of case: ASCII letters, digits and _; blanks, and all separators.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_FRONT = r"(?<!\w)(?=\w)"
_BLANK = r"\s\p{Z}\x{FEFF}"


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    parts, depth, inside, k = [""], 0, False, 0
    while k < len(pattern):
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        inside = c == "[" or (inside and c != "]")
        depth += 0 if inside else (c == "(") - (c == ")")
        if c == "|" and not depth and not inside:
            parts.append("")
        else:
            parts[-1] += c
        k += len(c)
    return parts


def _opens_word(pattern: str) -> bool:
    """Whether all that ``pattern`` matches surely begins with an ASCII letter or digit (of either case)."""
    if pattern.startswith("("):
        depth, inside, k = 1, False, 0
        body = pattern[1:].removeprefix("?:")
        while k < len(body) and depth:
            c = body[k : k + 2] if body[k] == "\\" else body[k]
            inside = c == "[" or (inside and c != "]")
            depth += 0 if inside else (c == "(") - (c == ")")
            k += len(c)
        return not body.startswith("?") and body[k : k + 1] not in ("?", "*", "{") and all(map(_opens_word, _alternatives(body[: k - 1])))
    atom = 2 if pattern.startswith(r"\d") else int(pattern[:1].isascii() and pattern[:1].isalnum())
    return atom > 0 and (pattern[atom : atom + 1] not in ("?", "*", "{") or pattern[atom : atom + 3] == "{1,")


def rx(pattern: str, fold: bool = True) -> str:
    r"""``pattern`` with ASCII word edges, wide ``\s``, ``$`` only at the very end and, with ``fold``, letters of either case."""
    parts = _alternatives(pattern)
    if len(parts) > 1 and all(p.startswith(r"\b") for p in parts):  # one test of the edge for all
        pattern = r"\b(?:" + "|".join(p[2:] for p in parts) + ")"
    out, inside, k = [], False, 0
    if pattern.startswith(r"\b") and all(map(_opens_word, _alternatives(pattern[2:]))):  # the commonest case, and a third of the work
        out, k = [_FRONT], 2
    many = pattern.startswith("(?m)")
    while k < len(pattern):
        pair, c = pattern[k : k + 2], pattern[k]
        if c == "\\":
            out.append({r"\b": _EDGE, r"\s": _BLANK if inside else f"[{_BLANK}]"}.get(pair, pair))
            k += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(r"\z" if c == "$" and not inside and not many else c)
        k += 1
    return ("(?iu)" if fold else "") + "".join(out)


def let(value, then):
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def has(text, pattern: str, fold: bool = True):
    return text.rlike(rx(pattern, fold))


def count_of(text, pattern: str, fold: bool = True):
    return F.regexp_count(text, F.lit(rx(pattern, fold)))


def all_of(text, pattern: str, group: int = 0, fold: bool = True):
    return F.regexp_extract_all(text, F.lit(rx(pattern, fold)), F.lit(group))


def first_of(text, pattern: str, group: int = 0, fold: bool = True):
    return F.regexp_extract(text, rx(pattern, fold), group)


def swap(text, pattern: str, to: str, fold: bool = True):
    return F.regexp_replace(text, F.lit(rx(pattern, fold)), F.lit(to))


def trim(text):
    """Without white space of any kind at both ends."""
    return swap(text, r"^\s+|\s+$", "", fold=False)


def squeeze(text):
    return trim(swap(text, r"\s+", " ", fold=False))


def key(text):
    """Lower case with single spaces: what texts are compared by."""
    return squeeze(F.lower(text))


def blank(text):
    return trim(text) == ""


def lines_of(text):
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n+"), trim), lambda x: x != "")


def first_wins(items, key_of, most: int | None = None):
    """Items of an array whose key was not seen before them, in order; items with a blank key go.

    Equal keys are found by sorting keys with their places, so a long array costs no more than its sort.
    """
    def kept(values):
        places = F.array_sort(F.transform(values, lambda x, i: F.struct(key_of(x).alias("k"), i.alias("i"))))
        first = lambda p: F.filter(p, lambda x, n: (x["k"] != "") & ((n == 0) | (F.get(p, n - 1)["k"] != x["k"])))
        return F.transform(F.array_sort(F.transform(let(places, first), lambda x: x["i"])), lambda i: F.get(values, i))

    found = let(items, kept)
    return found if most is None else F.slice(found, 1, most)
