"""Suffix arrays of one shard by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller or larger than their successor; leftmost smaller substrings are sorted by inducing, named,
and, while names repeat, their sequence is sorted by the same function; the order of all suffixes is then induced in linear time.
Inducing works on blocks of the order instead of single suffixes.
"""

from __future__ import annotations

import numpy as np

#: Elements of the first block of a scan, and of one too short to be worth it.
FIRST, SHORT = 128, 12


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order; its last symbol is 0 and stands nowhere else."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    found = _induced(text, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found = found[is_lms[found]]
    names = _names(text, lms, found)
    if names[-1] + 1 < len(found):
        reduced = np.empty(n, "int32")
        reduced[found] = names
        found = lms[suffix_array(reduced[lms])]
    return _induced(text, smaller, found)


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts behind it; equal symbols are as their successor."""
    rises = np.append(text[:-1] < text[1:], True)
    differs = np.flatnonzero(np.append(text[:-1] != text[1:], True))
    return np.repeat(rises[differs], np.diff(differs, prepend=-1))


def _names(text: np.ndarray, lms: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Ranks of the substrings at ``found``, which are in order; equal substrings have one rank."""
    n = len(text)
    length = np.empty(n, "int32")
    length[lms] = np.append(np.diff(lms), 0) + 1  # with the first symbol of the next one
    a, b = found[:-1], found[1:]
    equal = length[a] == length[b]
    live = np.flatnonzero(equal)
    k = 0
    while len(live):
        same = text[a[live] + k] == text[b[live] + k]
        equal[live[~same]] = False
        k += 1
        live = live[same]
        live = live[length[a[live]] > k]
    return np.concatenate([[0], np.cumsum(~equal)])


def _induced(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order induced from that of ``lms``: upwards for larger suffixes, then downwards for smaller ones."""
    n = len(text)
    sizes, held = np.bincount(text), np.bincount(text[lms], minlength=int(text.max()) + 1)
    ends = np.cumsum(sizes)
    order = np.zeros(n, "int32")  # the whole text induces nothing, so 0 stands for an empty place too
    turn = np.argsort(text[lms], kind="stable")
    symbol = text[lms][turn]
    order[(ends - np.cumsum(held))[symbol] + np.arange(len(lms))] = lms[turn]
    _scan(order, text, ~smaller, ends - sizes)
    _scan(order[::-1], text, smaller, n - ends)
    return order


def _scan(order: np.ndarray, text: np.ndarray, wanted: np.ndarray, head: np.ndarray) -> None:
    """Puts the wanted predecessor of each suffix in ``order``, a block at a time, at the next free place of its symbol.

    A block ends before the first place that one of its own predecessors goes to, so all that it reads is final. Where
    blocks get short, as in runs of one symbol, a stretch is done element by element.
    """
    n, at, step = len(order), 0, FIRST
    while at < n:
        block = order[at : at + step]
        found = block[block > 0] - 1
        found = found[wanted[found]]
        symbol = text[found]
        free = int(head[symbol].min()) if len(found) else n
        if free < at + len(block):
            if free - at < SHORT:
                for k in range(at, min(n, at + FIRST)):
                    i = order[k] - 1
                    if i >= 0 and wanted[i]:
                        c = text[i]
                        order[head[c]] = i
                        head[c] += 1
                at += FIRST
                continue
            block = order[at:free]
            found = block[block > 0] - 1
            found = found[wanted[found]]
            symbol = text[found]
        turn = np.argsort(symbol, kind="stable")
        symbol = symbol[turn]
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else np.empty(0, "int64")
        count = np.diff(np.append(first, len(symbol)))
        order[np.repeat(head[symbol[first]] - first, count) + np.arange(len(symbol))] = found[turn]
        head[symbol[first]] += count
        at += len(block)
        step = max(FIRST, 2 * len(block))


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each start in text order, the length that it shares with the suffix before it in ``order``.

    Where the symbols before both starts are equal, the value is that of the start before, less one; only the others
    are compared, eight symbols at a time. ``text`` is of single bytes.
    """
    n = len(text)
    before = np.full(n, -1, "int64")
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (text[:-1] == text[before[1:] - 1])
    fresh = np.flatnonzero(~follows)
    padded = np.append(text, np.zeros(8, "uint8"))
    words = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view("<u8").ravel()
    shared = np.zeros(len(fresh), "int64")
    live = np.flatnonzero(before[fresh] >= 0)
    a, b = fresh[live], before[fresh[live]]
    while len(live):
        differ = words[a] ^ words[b]
        same = differ == 0
        low = differ[~same]
        low &= ~low + np.uint64(1)
        shared[live[~same]] += np.log2(low.astype("float64")).astype("int64") >> 3  # the first byte that differs
        live = live[same]
        shared[live] += 8
        a, b = a[same] + 8, b[same] + 8
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
    last = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, n)))
    return shared[last] - (np.arange(n) - fresh[last])
