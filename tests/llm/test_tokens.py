"""Encoding, decoding and prefix counts against the library itself."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from sitefacts.llm import sentencepiece_codec, token_counts
from sitefacts.llm.pieces import Lattice, vocabulary

PARTS = ["a", "b", " ", "  ", "\n", "é", "ß", "1", "$", "<s>", "</s>", "▁", "梦", "😀", "\t", "the", "ing", "ñ", "\x00", "<0x0A>", "....", "    ", "="]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    return [None, "", " ", "\n", "x" * 5000, "the " * 3000, *made, made[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, n_tokens string")


def test_ids_are_the_library_s_and_decode(spark, library, odd_texts):
    encoded = sentencepiece_codec.encode(frame(spark, odd_texts))
    rows = {r.doc_id: r for r in encoded.collect()}
    assert len(rows) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        assert rows[i].ids == library.encode(text or "")
        assert rows[i].round_trip == (library.decode(rows[i].ids) == (text or "").replace("▁", " "))
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded).collect()}
    assert all(back[i] == library.decode(rows[i].ids) for i in rows)


def test_streaming_commits_early_and_keeps_a_short_window(library):
    vocab = vocabulary(public_tokenizers.path(sentencepiece_codec.MODEL))
    rnd = random.Random(2)
    text = "▁" + "".join(rnd.choice(["un", "believ", "able", "ß", "0", "the", "▁"]) for _ in range(4000))
    lattice, out, widest = Lattice(vocab), [], 0
    for c in range(0, len(text), 7):
        lattice.feed(text[c : c + 7])
        out += lattice.commit()
        widest = max(widest, len(lattice.text))
    assert out + lattice.finish() == library.encode(text[1:].replace("▁", " "))
    assert widest <= 4 * vocab.longest
    whole = Lattice(vocab)
    whole.feed(text)
    assert whole.finish() == list(sentencepiece_codec.stream_ids(vocab, [text]))


def test_unigram_paths_have_the_best_score():
    vocab = vocabulary(public_tokenizers.path(sentencepiece_codec.MODEL))
    vocab.bpe = False
    try:
        for text in ("▁abab", "▁there", "▁xyzzy", "in"):
            lattice = Lattice(vocab)
            lattice.feed(text)
            best = max(sum(vocab.scores[vocab.ids[p]] for p in cut) for cut in cuts(text) if all(p in vocab.ids for p in cut))
            assert sum(vocab.scores[i] for i in lattice.finish()) == pytest.approx(best)
    finally:
        vocab.bpe = True


def cuts(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in cuts(text[k:]):
            yield [text[:k], *rest]


def test_counts_of_every_prefix(spark, library, odd_texts):
    short = [t for t in odd_texts if t is None or len(t) < 200]
    tables = {r.doc_id: r.counts for r in token_counts.prefix_counts(frame(spark, short)).collect()}
    for i, text in enumerate(short):
        text = text or ""
        assert tables[i] == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
    for budget in (0, 3, 8):
        for r in token_counts.token_counts(frame(spark, short), budget=budget).collect():
            text = short[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), tables[r.doc_id][-1], tables[r.doc_id][-1] > budget)
            assert r.budget_chars == max(k for k, n in enumerate(tables[r.doc_id]) if n <= budget)


def test_stored_counts_answer_budgets_and_truncation(spark, library, odd_texts):
    short = [t for t in odd_texts if t is None or len(t) < 200][:80]
    stored = token_counts.prefix_counts(frame(spark, short)).cache()
    for budget in (0, 3, 8):
        direct = {r.doc_id: r.budget_chars for r in token_counts.token_counts(frame(spark, short), budget=budget).collect()}
        for r in token_counts.within(stored, budget).collect():
            assert r.chars == direct[r.doc_id] and r.n_tokens == len(library.encode((short[r.doc_id] or "")[: r.chars])) <= budget
    for chars in (0, 2, 50):
        assert all(r.n_tokens == len(library.encode((short[r.doc_id] or "")[:chars])) for r in token_counts.at(stored, chars).collect())


def test_long_stretches_are_counted_in_a_window(spark, library, monkeypatch):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcdefth019+/ß") for _ in range(6000)), "x" * 3000, "né" * 900 + " tail", None]
    widest = []
    monkeypatch.setattr(Lattice, "feed", lambda self, chunk, f=Lattice.feed: (f(self, chunk), widest.append(len(self.text)))[0])
    counter = token_counts.PrefixCounter(vocabulary(public_tokenizers.path(sentencepiece_codec.MODEL)))
    for text in texts[:3]:
        counts = counter.prefixes(text)
        assert all(counts[k] == len(library.encode(text[:k])) for k in (*range(0, 200), *range(200, len(text) + 1, 97), len(text)))
    assert max(widest) <= 5 * counter.vocab.longest and all(len(k) <= 64 for k in counter.marked)
    rows = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_counts.token_counts(rows).collect()) == sorted(len(library.encode(t or "")) for t in texts)
    assert all(r.doc_id is None and r.round_trip for r in sentencepiece_codec.encode(rows).collect())


def test_no_rows(spark):
    assert sentencepiece_codec.encode(frame(spark, []).limit(0)).count() == 0
    assert token_counts.token_counts(frame(spark, []).limit(0)).count() == 0
