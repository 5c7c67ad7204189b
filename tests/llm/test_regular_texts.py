"""Which texts are cut at separators, by its definition, and ids of units that are encoded many at a time."""

import random

from attestor.llm import tokens


def test_regular_texts_and_their_ids():
    rng, enc = random.Random(5), tokens.Encoder(tokens.vocabulary_path())
    white = [c for c in map(chr, range(0x3001)) if c.isspace()]
    made = ["", " ", "\n", "a", "ä", " a", "a ", "\na", "a\n", "a  b", "a\n\nb", "a \nb", "a\n b", "<|endoftext|>", *(f"a{c}b" for c in white), *(f"{c}a" for c in white)]
    words = ["one", "zwölf", "x,", "don't", "3.5", "中文", "\U0001f600", "...", "á"]
    made += ["".join(rng.choice(words) + rng.choice(" \n") for _ in range(40)) + "end" for _ in range(30)]
    for text in made:
        plain = bool(text) and " ".join(text.split()) == text.replace("\n", " ") and "<|endoftext|>" not in text
        assert (enc._regular(text) is not None) == plain, repr(text)
    for texts in (made, made[::-1]):
        assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert enc.count(texts).tolist() == [len(x) for x in enc.encode(texts)]
