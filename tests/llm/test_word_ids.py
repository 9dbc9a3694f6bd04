"""Ids by words are the plain tokenizer's, over all of Unicode."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ranklab.llm import catalog
from ranklab.llm.word_ids import WordTokenizer

HARD = "aAbzZ019'.,!-_ \n\t\x0b\x1c\x85 ßéÉİıŉſÀÖ×÷ŸøΣςσÅḰ̸̇क़क़שׁﬁ中٣²½<|>"


@pytest.fixture(scope="module")
def coders():
    return WordTokenizer(catalog.TOKENIZER, added_tokens=True), Tokenizer.from_file(catalog.TOKENIZER)


def same(coders, texts):
    words, plain = coders
    want = plain.encode_batch_fast(texts, add_special_tokens=False)
    for t, got, x in zip(texts, words.encode(texts), want):
        assert got == np.array(x.ids, "<u4").tobytes(), ascii(t)


def test_random_strings(coders):
    rng = random.Random(7)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    same(coders, ["".join(rng.choice(every) for _ in range(10)) for _ in range(50_000)])
    same(coders, ["".join(rng.choice(HARD) for _ in range(rng.randint(0, 25))) for _ in range(50_000)])


def test_every_character_beside_letters_and_marks(coders):
    same(coders, [f"ab{chr(c)}. {chr(c)}1{chr(c)}{chr(c)}'s{chr(c)}! {chr(c)}?" for c in range(1, 0x11000) if not 0xD800 <= c <= 0xDFFF])


def test_added_tokens_and_long_words(coders):
    same(coders, ["", "a <|endoftext|> b<|startoftext|>", "<|ENDOFTEXT|>", "x" * 5000, "it's we'll THEY'RE 'tis l'été 12.5% don''t"])


def test_added_tokens_as_text(coders):
    plain = Tokenizer.from_file(catalog.TOKENIZER)
    plain.encode_special_tokens = True
    text = "a <|endoftext|> b"
    assert WordTokenizer(catalog.TOKENIZER).encode([text]) == [np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
