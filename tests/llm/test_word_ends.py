"""Punctuation cut from ends of words: the ids stay the library's, and a word goes to the library once whatever ends it."""

import random

from attestor.llm import tokens

ENDS = ["", ".", ",", "!!", "%%%", "...'", '"),', "'"]


def test_a_word_goes_to_the_library_once_whatever_ends_it(monkeypatch):
    enc, sent = tokens.Encoder(tokens.vocabulary_path()), []
    library = enc._library
    monkeypatch.setattr(enc, "_library", lambda texts: sent.extend(texts) or library(texts))
    texts = [" ".join(f"w{i}ö{end}" for i in range(at, at + 20)) for at in range(0, 200, 20) for end in ENDS]
    ids = [x.tolist() for x in enc.encode(texts)]
    assert sum(map(len, sent)) < 2 * sum(map(len, texts[:: len(ENDS)]))
    assert ids == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ends_of_words_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_UNITS", 300)
    rng, enc = random.Random(11), tokens.Encoder(tokens.vocabulary_path())
    parts = ["a", "Z", "9", "é", "ÿ", "×", "÷", "ª", "º", "ß", "ã", "Ā", "日", "́", "٣", "²", "😀", "\x00", "\x7f", "​", "'s", "'ll", "don't", "I'm", *map(chr, range(33, 48)), "…", "«", "!" * 15, "?" * 16, "-" * 17]
    for _ in range(12):
        texts = ["".join(rng.choice(" \n") + "".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 30)))[1:] for _ in range(40)]
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode(texts)] == want
        assert enc.count(texts).tolist() == list(map(len, want))
