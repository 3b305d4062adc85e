"""Subword vocabulary and the prefix lattice that encoding and counting walk.

For a BPE vocabulary, a sequence of pieces is the encoding of its text exactly when every two neighbours stay apart
under the merge rules. So every prefix of a text has one legal last piece, found from the shorter prefixes alone; the
same step with summed scores in place of legality is the unigram lattice.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces, scores and byte ids of a SentencePiece model with an identity normaliser."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        processor = SentencePieceProcessor(model_file=model_file)
        spec = proto.ModelProto()
        spec.ParseFromString(processor.serialized_model_proto())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("only models that keep their text as it is are supported")
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback are supported")
        kinds = proto.ModelProto.SentencePiece
        self.bpe = spec.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.size = len(spec.pieces)
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = [p.score for p in spec.pieces]
        self.names = [p.piece for p in spec.pieces]
        self.byte_ids = [0] * 256
        self.raw = [b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else p.piece.encode() for p in spec.pieces]
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value] = i
                self.raw[i] = bytes([value])
        self.longest = max(map(len, self.ids))
        #: Every ending of a piece, with the piece's id if it is one itself, else -1.
        self.endings = {p[k:]: -1 for p in self.ids for k in range(len(p))} | self.ids
        self.unknown = min(self.scores) - UNKNOWN_PENALTY
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._apart: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        #: No piece crosses from another character to a space mark: there all paths meet.
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def merged(self, text: str) -> list[str]:
        """The pieces that the merge rules leave: the best scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                pid = self.ids.get(parts[k] + parts[k + 1])
                if pid is not None and (best is None or self.scores[pid] > best):
                    best, at = self.scores[pid], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, piece: int) -> bool:
        """Whether the rules build this piece from its own characters."""
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = len(self.merged(self.names[piece])) == 1
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether the rules leave these neighbours as they are."""
        key = left * self.size + right
        known = self._apart.get(key)
        if known is None:
            a, b = self.names[left], self.names[right]
            if len(self._apart) > 1_000_000:
                self._apart.clear()
            known = self._apart[key] = self.whole(left) and self.whole(right) and self.merged(a + b) == [a, b]
        return known

    def decode(self, ids) -> str:
        """The text of ``ids``: bytes joined, marks read as spaces, the first space removed."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def model_path(model: str) -> str:
    """A path as it stands, or the name of a file among the public tokenizers."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class Lattice:
    """Prefix dynamic programme over one stretch of text, fed in chunks.

    For each prefix it keeps where its last piece starts, that piece, and the number of ids so far. ``commit`` drops
    what no future piece can change: every path that may go on leads back to one boundary, and the ids before it are final.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.text, self.base = "", 0
        self.start, self.last, self.count, self.best = [0], [-1], [0], [0.0]

    def feed(self, chunk: str) -> None:
        vocab = self.vocab
        endings, bpe, known, size, scores = vocab.endings.get, vocab.bpe, vocab._apart.get, vocab.size, vocab.scores
        first = len(self.text) + 1
        text = self.text = self.text + chunk
        start, last, count, best = self.start, self.last, self.count, self.best
        for i in range(first, len(text) + 1):
            found, top, j = -1, None, i - 1
            while j >= 0:
                piece = endings(text[j:i])
                if piece is None:
                    break
                if piece >= 0:
                    if bpe:
                        before = last[j]
                        if before < 0:
                            fits = vocab.whole(piece)
                        else:
                            fits = known(before * size + piece)
                            if fits is None:
                                fits = vocab.apart(before, piece)
                        if fits:
                            found, at = piece, j
                            break
                    elif top is None or best[j] + scores[piece] > top:
                        found, at, top = piece, j, best[j] + scores[piece]
                j -= 1
            if found >= 0:
                start.append(at)
                last.append(found)
                count.append(count[at] + 1)
                if not bpe:
                    best.append(top)
            else:
                start.append(i - 1)
                last.append(-1)
                count.append(count[i - 1] + len(text[i - 1].encode("utf-8", "replace")))
                if not bpe:
                    best.append(best[i - 1] + vocab.unknown)

    def ids_to(self, end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            if self.last[end] >= 0:
                out.append(self.last[end])
            else:
                out.extend(self.vocab.byte_ids[b] for b in reversed(self.text[end - 1].encode("utf-8", "replace")))
            end = self.start[end]
        out.reverse()
        return out

    def meeting(self) -> int:
        """The last boundary that lies on the path of every prefix from which a later piece may start."""
        paths = set(range(max(0, len(self.text) - self.vocab.longest + 1), len(self.text) + 1))
        while len(paths) > 1:
            far = max(paths)
            paths.discard(far)
            paths.add(self.start[far])
        return paths.pop()

    def commit(self) -> list[int]:
        """Final ids up to the meeting point; the window then begins there, its left neighbour remembered."""
        at = self.meeting()
        if not at:
            return []
        out = self.ids_to(at)
        self.text = self.text[at:]
        self.start = [0] + [max(0, s - at) for s in self.start[at + 1 :]]
        self.last = self.last[at:]
        self.count = [c - self.count[at] for c in self.count[at:]]
        if not self.vocab.bpe:
            self.best = [b - self.best[at] for b in self.best[at:]]
        return out

    def finish(self) -> list[int]:
        return self.ids_to(len(self.text))
