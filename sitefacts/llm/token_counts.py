"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

``Lattice`` holds, for each prefix, the number of tokens of exactly that prefix: one more than the count of the prefix
before its last piece. A stretch between two points that no piece crosses (line ends, the start of a word's space mark)
has a table of its own prefix counts; a text's table is the tables of its stretches, each raised by the total before it.
Counts equal ``len(library.encode(text[:i]))`` for every i. Totals, truncation and budgets are read from these tables:
``token_counts`` looks a budget up in the stretches it has just counted, ``within`` and ``at`` ask tables that
``prefix_counts`` wrote. Nothing is encoded again.

Tables of short stretches are remembered; long ones are counted in a window of about twice the longest piece.

Null text counts as empty: 0 bytes, 0 tokens. A null doc_id is carried along. Rows are kept one to one, repeats included;
columns of other names stay behind.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import Memo, texts
from sitefacts.llm.pieces import SPACE, Lattice, Vocabulary, model_path, vocabulary
from sitefacts.llm.sentencepiece_codec import MODEL, STRETCH

BUDGET = 4096


class PrefixCounter:
    """Token counts of texts and of all their prefixes, one per Python worker."""

    def __init__(self, vocab: Vocabulary, remember: int = 250_000):
        self.vocab = vocab
        self.marked = Memo(lambda word: self.table(SPACE + word), remember)
        self.plain = Memo(self.table, remember // 4)
        self.line_end = self.table("\n")

    def table(self, stretch: str) -> bytes | array:
        """Counts of the prefixes of a marked stretch, the empty one included."""
        lattice, step = Lattice(self.vocab), self.vocab.longest
        if len(stretch) <= 2 * step:
            lattice.feed(stretch)
            counts = lattice.count
        else:
            counts, before = array("I", [0]), 0
            for at in range(0, len(stretch), step):
                chunk = stretch[at : at + step]
                lattice.feed(chunk)
                counts.extend([before + c for c in lattice.count[-len(chunk) :]])
                if len(lattice.text) > 2 * step:
                    total = lattice.count[-1]
                    lattice.commit()
                    before += total - lattice.count[-1]
        return counts if isinstance(counts, array) else bytes(counts) if max(counts) < 256 else array("I", counts)

    def stretches(self, text: str):
        """The stretches of the marked text, in order; no piece crosses from one to the next."""
        if not self.vocab.words_apart:
            yield SPACE + text.replace(" ", SPACE)
            return
        for k, line in enumerate(text.split("\n")):
            if k:
                yield "\n"
            line = line.replace(" ", SPACE)
            line = line if k else SPACE + line
            at = line.find(SPACE)
            at = len(line) if at < 0 else at
            if at:
                yield line[:at]
            yield from STRETCH.findall(line[at:])

    def tables(self, text: str) -> list:
        """The tables of the text's stretches in order, line ends among them."""
        if not text:
            return []
        if not self.vocab.words_apart or SPACE in text:
            return [self.table(s) for s in self.stretches(text)]
        marked, plain = self.marked.__getitem__, self.plain.__getitem__
        out = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out.append(self.line_end)
            if "" in words:
                line = line.replace(" ", SPACE)
                line = line if k else SPACE + line
                at = line.find(SPACE)
                at = len(line) if at < 0 else at
                if at:
                    out.append(plain(line[:at]))
                out += [marked(s[1:]) for s in STRETCH.findall(line[at:])]
            elif k:
                if words[0]:
                    out.append(plain(words[0]))
                out += map(marked, words[1:])
            else:
                out += map(marked, words)
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """``out[i]``: the number of tokens of ``text[:i]``."""
        out, before = [0], 0
        for counts in self.tables(text):
            out.extend([before + c for c in counts[1:]])
            before += counts[-1]
        # The mark before the first character counts only together with it.
        return np.array(out[:1] + out[2:], "int32")


def longest_within(tables: list, budget: int) -> int:
    """The longest prefix, in characters, of at most ``budget`` tokens; totals grow from stretch to stretch."""
    at = before = 0
    for counts in tables:
        if before + counts[-1] > budget:
            at += max(k for k, c in enumerate(counts) if before + c <= budget)
            break
        before += counts[-1]
        at += len(counts) - 1
    return max(0, at - 1)  # the mark before the first character is none of the text


def token_counts(docs: DataFrame, model: str = MODEL, budget: int = BUDGET) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` and ``budget_chars``: the longest prefix that fits the budget."""

    def run(batches):
        counter = PrefixCounter(vocabulary(model_path(model)))
        for batch in batches:
            found = batch.column(1).to_pylist()
            counts, fits = [], []
            for text in found:
                tables = counter.tables(text)
                n = sum([t[-1] for t in tables])
                counts.append(n)
                fits.append(len(text) if n <= budget else longest_within(tables, budget))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > budget for n in counts], pa.bool_()), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "budget_chars"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_chars long")


def prefix_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``counts``: the token count of every prefix, from the empty one to the whole text."""

    def run(batches):
        counter = PrefixCounter(vocabulary(model_path(model)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([counter.prefixes(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "counts"])

    return texts(docs).mapInArrow(run, "doc_id long, counts array<int>")


def within(stored: DataFrame, budget: int) -> DataFrame:
    """``doc_id, chars, n_tokens`` from stored prefix counts: the longest prefix of at most ``budget`` tokens, and its tokens."""
    fits = F.array_max(F.transform("counts", lambda n, k: F.when(n <= budget, k)))
    return stored.select("doc_id", "counts", fits.cast("long").alias("chars")).select("doc_id", "chars", F.get("counts", F.col("chars")).cast("long").alias("n_tokens"))


def at(stored: DataFrame, chars: int) -> DataFrame:
    """``doc_id, n_tokens`` from stored prefix counts: the tokens of the first ``chars`` characters, of all where there are fewer."""
    return stored.select("doc_id", F.get("counts", F.least(F.lit(chars), F.size("counts") - 1)).cast("long").alias("n_tokens"))
