"""Toxicity scores over deobfuscated text.

Obfuscation is undone as a noisy channel. A token with digits or signs among or in place of its letters, with marks between
them, or with a doubled letter spans a lattice, and so do three or more single characters with blanks of any kind between
them: each observed character may stand for itself, for the letter it imitates, for a separator to drop, or repeat the
letter before it. Viterbi picks the path of the best sum of channel cost and character trigram likelihood; the trigrams are
counted over every document and every letter that occurs, so the model grows with the corpus (letters beyond the Latin
ones count by their block of 128 code points, which bounds the alphabet). Tokens of any length are decoded, letters on
which all paths agree being given out on the way. Tokens without such signs have one path only, themselves.

The score is a logistic function of summed word evidence: the strongest weights among a text's distinct words, a word and
what it is restored to being one. Words and word beginnings are weighted by their log odds in labelled training documents,
which are restored once and written. Learned: rows whose crc32(doc_id) mod 4 is not 2, at most ``MAX_LABELLED`` of them, in
hash order. Labels, language, source and id are no inputs of a score.

Null and empty texts carry no evidence and get the score of the intercept. Without labels every score is the prior, 0.
Repeated rows get equal scores; other columns, whatever their names, stay behind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import Memo, cut, small_batches, texts

#: Bound on labelled training rows.
MAX_LABELLED = 200_000
SUPPORT, LEAST_WEIGHT, STRONGEST = 5, 3.0, 4
PREDICT_AT = 0.3
#: Letters of the word beginnings that are weighted.
BEGINNINGS = (4, 5, 6)
#: Restored tokens a task remembers, tokens without weight it remembers, and features it counts before it hands them on.
REMEMBERED, UNMARKED, COUNTED = 50_000, 150_000, 100_000

#: Characters and the letters they imitate.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i"}
SEPARATORS = set(" .-_*'~,·/\\")
#: Log costs of the channel; the last two are added where a character that imitates a letter, or one outside words, goes.
IMITATE, REPEAT, DROP, BREAK, WASTE, OUTSIDE = -0.7, -0.5, -0.3, -7.0, -4.0, -2.0

#: Marks around words that imitate no letter; what else stands at a word's ends is for the lattice to judge.
SIGNS = "!$|(+@"
MARKS = " \t\r\n.,;:?\"')[]{}<>«»“”‘’…*#%&"
OPENING, CLOSING = "\"'([{<«“‘", ".,;:!?\"')]}>»”’…"
SPACED = re.compile(rf"(?<!\S)[{re.escape(OPENING)}]*\S(?:\s+\S){{2,}}[{re.escape(CLOSING)}]*(?!\S)")
#: Letters with one sign behind them, however often: its readings are those letters, and words of the sign's one letter.
TAILED = re.compile(r"([^\W\d_]+)[.,;:]?([!$+@])\2*")
RUN, RUNS = re.compile(r"(.)\1"), re.compile(r"(.)\1+")
#: Characters between two looks for letters on which all paths agree.
COMMIT = 256
#: Bits of a symbol in a trigram's code, and where the symbols of blocks of letters begin.
BITS, BLOCKS = 13, 0x1000
PLAIN = 28  # a boundary, a to z, and room for any other letter


def symbol(c: str) -> int:
    """0 for a boundary, 1 to 26 for a to z, a number of its own for other Latin letters, one for each block of the rest."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 0 if not c.isalpha() else ord(c) if c < "\u0250" else BLOCKS + (ord(c) >> 7)


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """``symbol`` of every code point that may be a letter; the last entry is for those beyond."""
    return np.array([symbol(chr(k)) for k in range(0x32400)] + [0], "int32")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``code, n``: counts of letter trigrams over all texts in lower case.

    A word's ends count as boundaries, and its first letter as standing after two of them, whatever the word before.
    """

    def run(batches):
        table = symbols()
        dense, rest = np.zeros(PLAIN**3, "int64"), Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if text:
                    points = np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le", "replace"), "<u4")
                    ids = table[np.minimum(points, len(table) - 1)]
                    plain = np.minimum(ids, PLAIN - 1)
                    begins = plain[1:-1] == 0
                    codes = np.where(begins, 0, plain[:-2] * PLAIN**2) + plain[1:-1] * PLAIN + plain[2:]
                    dense += np.bincount(codes, minlength=PLAIN**3)
                    other = plain == PLAIN - 1
                    if other.any():
                        at = np.flatnonzero((other[:-2] & ~begins) | other[1:-1] | other[2:])
                        wide = ids.astype("int64")
                        found, n = np.unique(np.where(begins[at], 0, wide[at] << 2 * BITS) | (wide[at + 1] << BITS) | wide[at + 2], return_counts=True)
                        rest.update(dict(zip(found.tolist(), n.tolist())))
        dense[0] = 0  # between words nothing is said
        codes = np.flatnonzero(dense)
        a, b, c = codes // PLAIN**2, codes // PLAIN % PLAIN, codes % PLAIN
        own = (a < PLAIN - 1) & (b < PLAIN - 1) & (c < PLAIN - 1)
        found = np.concatenate([((a << 2 * BITS) | (b << BITS) | c)[own], np.fromiter(rest, "int64", len(rest))])
        n = np.concatenate([dense[codes[own]], np.fromiter(rest.values(), "int64", len(rest))])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    return texts(docs).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes and their counts: a row for each trigram of letters and blocks that occurs."""
    rows = trigram_counts(docs).orderBy("code").collect()
    return np.array([r["code"] for r in rows], "int64"), np.array([r["n"] for r in rows], "int64")


class Model(dict):
    """Log probabilities of a symbol after two others, by trigram code; made when first asked for."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        super().__init__()
        self.three = dict(zip(codes.tolist(), counts.tolist()))
        self.two, self.after_two, self.after_one = Counter(), Counter(), Counter()
        mask = (1 << 2 * BITS) - 1
        for code, n in self.three.items():
            self.two[code & mask] += n
            self.after_two[code >> BITS] += n
            self.after_one[(code & mask) >> BITS] += n
        self.letters = len(self.after_one) + 1

    def __missing__(self, code: int) -> float:
        pair, last = code & ((1 << 2 * BITS) - 1), code >> BITS
        backed = (self.two[pair] + 0.5) / (self.after_one[pair >> BITS] + 0.5 * self.letters)
        value = math.log((self.three.get(code, 0) + 2.0 * backed) / (self.after_two[last] + 2.0))
        if len(self) > 300_000:
            self.clear()
        self[code] = value
        return value


class Signs(dict):
    """``symbol`` of characters, remembered."""

    def __missing__(self, c: str) -> int:
        value = self[c] = symbol(c)
        return value


class Channel:
    """Restores obfuscated tokens under a character language model."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]):
        self.model = Model(*model)
        self._steps: dict[tuple[str, bool, bool], tuple] = {}
        self._signs = Signs()

    def options(self, c: str, again: bool, whole: bool = False) -> tuple[tuple[str, int, float], ...]:
        """What ``c`` may stand for, with the letter's symbol and the cost; ``again`` if the same character is before it.

        In a ``whole`` reading what may be a letter is one.
        """
        found = self._steps.get((c, again, whole))
        if found is None:
            if c.isalpha():
                ways = [(c, 0.0)] + [("", REPEAT)] * (again and not whole)
            elif whole and c in LOOKALIKES:
                ways = [(letter, IMITATE) for letter in LOOKALIKES[c]]
            else:
                ways = [(letter, IMITATE) for letter in LOOKALIKES.get(c, "")]
                if c in SEPARATORS:
                    ways.append(("", DROP))
                elif again:
                    ways.append(("", REPEAT))
                ways.append((" ", BREAK + WASTE * (c in LOOKALIKES)))
            found = tuple((letter, symbol(letter) if letter else -1, cost) for letter, cost in ways)
            if len(self._steps) < 100_000:
                self._steps[c, again, whole] = found
        return found

    def decode(self, text: str, whole: bool = False) -> str:
        """The best path through the lattice of ``text`` (lower case); words of the result are split by spaces.

        A state is the last two symbols; ties go to the path that was found first.
        """
        model, options, mask = self.model, self.options, (1 << 2 * BITS) - 1
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        out: list[str] = []
        before = ""
        for at, c in enumerate(text):
            steps = options(c, c == before, whole)
            if whole and len(steps) > 1:  # nobody writes one of two equal letters with a sign
                beside = before + text[at + 1 : at + 2]
                steps = [x for x in steps if x[0] not in beside] or steps
            before = c
            after: dict[int, tuple[float, tuple | None]] = {}
            for last, (score, path) in states.items():
                for letter, sign, cost in steps:
                    if sign < 0:
                        key, total, way = last, score + cost, path
                    elif not sign:  # the word ends, or a character outside words goes
                        key, total, way = 0, score + cost + (model[last << BITS] if last else OUTSIDE), (path, letter)
                    else:
                        code = (last << BITS) | sign
                        key, total, way = code & mask, score + cost + model[code], (path, letter)
                    known = after.get(key)
                    if known is None or known[0] < total:
                        after[key] = (total, way)
            states = after
            if at % COMMIT == COMMIT - 1:
                states = self._committed(states, out)
        best = max(states.items(), key=lambda x: x[1][0] + (model[x[0] << BITS] if x[0] else 0.0))
        return "".join(out + self._letters(best[1][1]))

    def alphabetic(self, word: str) -> str:
        """``decode`` of a word of letters; where one letter stands twice, the two paths are compared directly."""
        at = RUN.search(word).start()
        if RUN.search(word, at + 1):
            return self.decode(word)
        short = word[:at] + word[at + 1 :]
        return short if self._likelihood(short) + REPEAT > self._likelihood(word) else word

    def _likelihood(self, word: str) -> float:
        model, signs, mask = self.model, self._signs, (1 << 2 * BITS) - 1
        total, last = 0.0, 0
        for c in word:
            code = (last << BITS) | signs[c]
            total += model[code]
            last = code & mask
        return total + model[last << BITS]

    @staticmethod
    def _letters(path: tuple | None) -> list[str]:
        out = []
        while path:
            path, letter = path
            out.append(letter)
        return out[::-1]

    def _committed(self, states: dict, out: list[str]) -> dict:
        """Moves the letters with which all paths begin to ``out``; the states keep what follows."""
        found = [self._letters(path) for _, path in states.values()]
        low, high = min(found), max(found)
        same = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        if not same:
            return states
        out += low[:same]
        kept = {}
        for (key, (score, _)), letters in zip(states.items(), found):
            path = None
            for letter in letters[same:]:
                path = (path, letter)
            kept[key] = score, path
        return kept

    @staticmethod
    def core(token: str) -> str:
        """A token without the marks around it; a bracket that is closed again is one of them."""
        core = token.strip(MARKS)
        return core.lstrip("(").strip(MARKS) if core[:1] == "(" and ")" in token else core

    def words(self, token: str) -> list[str]:
        """The word of a token, and its restored words if it looks obfuscated.

        Where signs may be letters the reading that takes all of them for letters comes too: a language model that has never
        met the word would rather drop one.
        """
        word = self.core(token.lower())
        if word.isalpha():
            return [word, self.alphabetic(word)] if RUN.search(word) else [word]
        if not any(c.isalpha() or c in LOOKALIKES for c in word):
            return [word] if word else []
        found = [word.strip(SIGNS) or word]
        for part in dict.fromkeys((word, word.lstrip("(").rstrip("!"))):  # most likely marks, but they may be letters
            if not part.isalpha():
                found += self.decode(part).split()
                if any(c in LOOKALIKES for c in part):
                    found += self.decode(part, True).split()
        return found

    def spaced(self, text: str) -> list[list[str]]:
        """For each word spelt as single characters with spaces between them: the joined characters and the decoded words."""
        out = []
        for run in SPACED.findall(text):
            parts = self._singles(run)
            out.append(["".join(parts), *self.decode(" ".join(parts)).split()])
        return out

    @staticmethod
    def _singles(run: str) -> list[str]:
        """The characters of a spaced word; the marks beside its first and last one go."""
        parts = run.lower().split()
        return [parts[0][-1], *parts[1:-1], parts[-1][0]]

    def restore(self, text: str) -> str:
        """The whole text with obfuscated tokens and spaced words replaced by what they stand for."""
        text = SPACED.sub(lambda m: self.decode(" ".join(self._singles(m[0]))).strip(), text)
        return re.sub(r"\S+", lambda m: self._token(m[0]), text)

    def _token(self, token: str) -> str:
        word = self.core(token.lower())
        if word.isalpha():
            return self.alphabetic(word) if RUN.search(word) else token
        return self.decode(word).strip() if any(c.isalpha() or c in LOOKALIKES for c in word) else token


def features(word: str) -> list[str]:
    """A word and its beginnings, these with a mark that no word has."""
    return [word, *(f"{word[:k]}~" for k in BEGINNINGS if len(word) > k)]


def heads(found) -> set[str]:
    """The first four letters of features: a word of another beginning has none of them."""
    return {f[:4] for f in found}


class Words:
    """The distinct words of texts: a token is its word and what that is restored to, in one string."""

    def __init__(self, channel: Channel):
        self.channel = channel
        self.memo = Memo(self._words, REMEMBERED)

    def _words(self, token: str) -> str:
        return " ".join(dict.fromkeys(self.channel.words(token)))

    def of(self, text: str) -> set[str]:
        found = set()
        for token in set(text.lower().split()):
            plain = token.isalpha() and not RUN.search(token)
            found.add(token if plain else self.memo[token])
        found.update(" ".join(dict.fromkeys(w)) for w in self.channel.spaced(text))
        found.discard("")
        return found


class Scorer:
    """Evidence of words: the sum of the strongest weights.

    Most tokens weigh nothing; they are remembered as a set that a text's tokens are compared with at once. A word of
    letters is not decoded if no path of it, all of which are the same letters but for repeats, can begin like a feature.
    """

    def __init__(self, channel: Channel, weights: dict[str, float]):
        self.channel, self.weights = channel, weights
        #: The first four letters of every feature, and the same without repeats; of word beginnings shorter than that, all.
        self.heads = heads(weights)
        single = {RUNS.sub(r"\1", f) for f in weights}
        self.single = {f[:4] for f in single if "~" not in f[:4]} | {f.rstrip("~") for f in single if "~" in f[:4]}
        self.short = {f.rstrip("~") for f in single if "~" in f[:4]}
        self.one_letter = any(len(set(f.rstrip("~"))) == 1 for f in weights)
        self.nothing: set[str] = set()
        self.before: set[str] = set()
        self.hopeful = Memo(self._hopeful, REMEMBERED)
        self.memo = Memo(self._judged, REMEMBERED)

    def _hopeful(self, start: str) -> bool:
        """Whether a word that begins with these letters, none of them twice in a row, may be or become a feature's."""
        return start in self.single or any(start[:k] in self.short for k in (1, 2, 3))

    def may_weigh(self, word: str) -> bool:
        start = word[:4]
        return self.hopeful[RUNS.sub(r"\1", word)[:4] if RUN.search(start) else start]

    def weight(self, word: str) -> float:
        if word[:4] not in self.heads:
            return 0.0
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def _judged(self, token: str) -> tuple[str, float]:
        words = list(dict.fromkeys(self.channel.words(token)))
        return " ".join(words), max(map(self.weight, words), default=0.0)

    def weighed(self, words: set[str]) -> tuple[float, int]:
        """Evidence of words that are restored already."""
        hopeful = [x for x in words if x[:4] in self.heads or " " in x]
        found = [w for w in (max(map(self.weight, x.split(" "))) for x in hopeful) if w]
        return sum(nlargest(STRONGEST, found)), len(found)

    def evidence(self, text: str) -> tuple[float, int]:
        found: dict[str, float] = {}
        for token in set(text.lower().split()) - self.nothing - self.before:
            word = token if token.isalpha() else self.channel.core(token)
            tailed = None if self.one_letter or word.isalpha() else TAILED.fullmatch(word)
            if tailed and len(RUNS.sub(r"\1", tailed[1])) >= 4:  # as many letters as say whether a word may weigh
                word = tailed[1]
            if word.isalpha() and not self.may_weigh(word):
                self._nothing(token)
                continue
            words, weight = self.memo[token]
            if weight:
                found[words] = weight
            else:
                self._nothing(token)
        for words in self.channel.spaced(text):
            weight = max(map(self.weight, words))
            if weight:
                found[" ".join(dict.fromkeys(words))] = weight
        return sum(nlargest(STRONGEST, found.values())), len(found)

    def _nothing(self, token: str) -> None:
        if len(token) <= self.memo.longest:
            if len(self.nothing) >= UNMARKED:
                self.before, self.nothing = self.nothing, set()
            self.nothing.add(token)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``most`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts(docs).join(F.broadcast(known), "doc_id")  # at most ``most`` rows of 12 bytes


def restored(rows: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``toxic`` (0 or 1) and the distinct ``words`` of each training row."""

    def run(batches):
        words = Words(Channel(model))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = [list(words.of(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], ["toxic", "words"])

    return rows.select((F.col("toxic") > 0).cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, words array<string>")


def _feature_documents(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """``feature, n``: in how many of ``rows`` each feature occurs, or each one of ``only``."""

    starts = only and {k: {f[:-1] for f in only if len(f) == k + 1 and f.endswith("~")} for k in BEGINNINGS}

    def run(batches):
        n: Counter[str] = Counter()
        for batch in batches:
            for found in batch.column(0).to_pylist():
                words = set(" ".join(found).split(" "))
                if only is None:
                    n.update({f for w in words for f in features(w)})
                else:
                    n.update(only & words)
                    for k in BEGINNINGS:
                        n.update([f"{x}~" for x in starts[k] & {w[:k] for w in words if len(w) > k}])
                if len(n) > COUNTED:
                    yield pa.RecordBatch.from_pydict({"feature": list(n), "n": list(n.values())})
                    n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

    return rows.select("words").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict:
    """Language model, feature weights and the two numbers of the logistic curve.

    What is learned from labels is bounded by ``most`` rows: features are those of ``SUPPORT`` toxic ones or more.
    """
    model = language_model(docs)
    rows = cut(restored(training_rows(docs, labels, most), model))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = size.get(1, 0), size.get(0, 0)
    if not yes:
        return {"model": model, "weights": {}, "slope": 0.0, "shift": -20.0}
    hits = {r["feature"]: r["n"] for r in _feature_documents(rows.where("toxic = 1"), None).where(F.col("n") >= SUPPORT).orderBy("feature").collect()}
    misses = {r["feature"]: r["n"] for r in _feature_documents(rows.where("toxic = 0"), frozenset(hits)).collect()}
    weights = {f: math.log((n + 0.5) / (yes + 1)) - math.log((misses.get(f, 0) + 0.5) / (no + 1)) for f, n in hits.items()}
    weights = {f: w for f, w in weights.items() if w >= LEAST_WEIGHT}

    def judged(batches):
        scorer = Scorer(Channel(model), weights)
        for batch in batches:
            found = [scorer.weighed(set(words))[0] for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["y", "evidence"])

    binned = rows.mapInArrow(judged, "y int, evidence double").groupBy(F.round("evidence", 1).alias("x"), "y").agg(F.count("*").alias("n"))
    x, y, n = (np.array(c, float) for c in zip(*[(r["x"], r["y"], r["n"]) for r in binned.orderBy("x", "y").collect()]))
    a = b = 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p)
        gradient = np.array([(n * (y - p) * x).sum() - a, (n * (y - p)).sum() - 0.01 * b])
        curve = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(curve, gradient), -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return {"model": model, "weights": weights, "slope": max(0.0, round(a, 6)), "shift": round(b, 6)}


def evidence(text, fitted: dict):
    """Column of ``evidence`` and ``n_flagged`` of a text column; only the texts go to Python."""
    model, weights = fitted["model"], fitted["weights"]

    @F.arrow_udf("struct<evidence: double, n_flagged: long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(Channel(model), weights)
        for batch in batches:
            found = [scorer.evidence(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([e for e, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["evidence", "n_flagged"])

    return of(F.coalesce(text, F.lit("")))


def probability(evidence, fitted: dict):
    return 1 / (1 + F.exp(-(F.lit(fitted["slope"]) * evidence + F.lit(fitted["shift"]))))


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_flagged`` of every row."""
    out = texts(docs).select("doc_id", evidence(F.col("text"), fitted).alias("found"))
    out = out.select("doc_id", probability(F.col("found.evidence"), fitted).alias("score"), F.col("found.n_flagged").alias("n_flagged"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "n_flagged")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, fitted: dict) -> DataFrame:
    """Rows of ``docs``, all columns as they are, without those predicted toxic; judged in the same pass."""
    small_batches(docs.sparkSession)
    return docs.where(probability(evidence(F.col("text"), fitted)["evidence"], fitted) < PREDICT_AT)
