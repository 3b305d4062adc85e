"""SentencePiece encoding and decoding by a streaming lattice.

A text is read in chunks; the lattice keeps a window of about twice the longest piece and commits ids as soon as all
paths that may go on lead through one boundary. Where the vocabulary itself makes paths meet (before every space, as no
piece crosses from a letter to a space mark), the stretch between two such points is encoded once and remembered, in a
memo of bounded size. Ids equal the library's for BPE models; unigram models use the same lattice with summed scores.

Null text encodes as empty text. Rows are never dropped, repeated rows give repeated rows, and columns of other names
pass by untouched. The result of a text depends on that text only.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitefacts.llm.common import Memo, texts
from sitefacts.llm.pieces import SPACE, Lattice, Vocabulary, model_path, vocabulary

MODEL = "piece_bpe_32k.model"
STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")


def stream_ids(vocab: Vocabulary, chunks: Iterable[str]) -> Iterator[int]:
    """Ids of the marked text that ``chunks`` spell, each given out as soon as it is final."""
    lattice, step = Lattice(vocab), vocab.longest
    for chunk in chunks:
        for at in range(0, len(chunk), step):
            lattice.feed(chunk[at : at + step])
            if len(lattice.text) > 2 * step:
                yield from lattice.commit()
    yield from lattice.finish()


class Codec:
    """Encodes whole texts to packed ids and back, one per Python worker."""

    def __init__(self, vocab: Vocabulary, remember: int = 150_000):
        self.vocab = vocab
        self.code = "H" if vocab.dtype.itemsize == 2 else "I"
        self.marked = Memo(lambda word: self._ids(SPACE + word), remember)
        self.plain = Memo(self._ids, remember // 4)
        self.line_end = self._ids("\n")

    def _ids(self, stretch: str) -> bytes:
        if len(stretch) <= 2 * self.vocab.longest:  # within the window nothing is committed early
            lattice = Lattice(self.vocab)
            lattice.feed(stretch)
            return array(self.code, lattice.finish()).tobytes()
        return array(self.code, stream_ids(self.vocab, [stretch])).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids as fixed-width little-endian integers."""
        if not text:
            return b""
        if not self.vocab.words_apart or SPACE in text:
            return self._ids(SPACE + text.replace(" ", SPACE))
        marked, plain, out = self.marked.__getitem__, self.plain.__getitem__, []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" in words:
                line = line.replace(" ", SPACE)
                if k == 0:
                    line = SPACE + line
                head = len(line) - len(line.lstrip(SPACE)) == 0
                cut = line.find(SPACE) if head else 0
                cut = len(line) if cut < 0 else cut
                ids = (plain(line[:cut]) if cut else b"") + b"".join(marked(s[1:]) for s in STRETCH.findall(line[cut:]))
            elif k == 0:
                ids = b"".join(map(marked, words))
            else:
                ids = plain(words[0]) + b"".join(map(marked, words[1:]))
            out.append(ids)
        return self.line_end.join(out)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids`` (array of int), ``n_tokens`` and ``round_trip``: whether decoding gives the text again.

    A text that holds the space mark itself decodes to spaces in its place, as it does in the library; ``round_trip``
    compares with that.
    """

    def run(batches):
        vocab = vocabulary(model_path(model))
        codec = Codec(vocab)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                packed, same = [], []
                for text in part.column(1).to_pylist():
                    ids = codec.packed(text)
                    packed.append(np.frombuffer(ids, vocab.dtype))
                    same.append(vocab.decode(packed[-1].tolist()) == text.replace(SPACE, " "))
                sizes = np.array([len(x) for x in packed], "int32")
                flat = np.concatenate(packed).astype("int32") if packed else np.array([], "int32")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"), flat), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids``; null ids decode to empty text."""

    def run(batches):
        vocab = vocabulary(model_path(model))
        for batch in batches:
            out = [vocab.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
