import random
from types import SimpleNamespace

import numpy as np
import pytest
from tokenizers import Tokenizer

from marketlens.llm import tokens
from marketlens.llm.tokens import WordTokenizer, tokenizer, tokenizer_path

SPECIAL = [0x130, 0x958, 0x9DC, 0x9DF, 0xA33, 0xA5E, 0xB5C, 0xFB1D, 0xFB4E]


@pytest.fixture(scope="module")
def both():
    return tokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


def same(both, texts):
    words, plain = both
    got = [np.frombuffer(x, words.dtype).tolist() for x in words.encode([t.encode() for t in texts])]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b in zip(texts, got, want) if a != b]
    assert not wrong, (len(wrong), [hex(ord(c)) for t in wrong[:3] for c in t])


def test_signs_behind_every_character(both):
    points = [chr(c) for c in range(0x21, 0x30000) if not 0xD800 <= c < 0xE000]
    for word in ("a{}.", "{},", "{}b!?", "a{}b(", "A{}'s"):
        same(both, [word.format(c) for c in points])


def test_turkish_capitals(both):
    same(both, ["BELEDİYESİ.", "ANİ,", "İ!", "İSTANBUL'DA...", "é.", "É!", "İ?"])


def test_mixed_words(both):
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0x21, 0x180), *range(0x300, 0x310), *SPECIAL, 0x3A3, 0xDF, 0x1E9E, 0x4E00, 0x1F600]]
    same(both, [" ".join("".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(8)) for _ in range(20_000)])


def test_new_words_are_merged_together(both, monkeypatch):
    words = WordTokenizer(tokenizer_path())
    calls, encode = [], words.merges.encode
    monkeypatch.setattr(words, "merges", SimpleNamespace(encode=lambda text, **kw: calls.append(text) or encode(text, **kw)))
    rng = random.Random(7)
    text = " ".join("".join(rng.choices("abcdeéß", k=9)) + rng.choice(["", ".", ",", "!!"]) for _ in range(5000))
    same((words, both[1]), [text])
    assert 0 < len(calls) < 100, len(calls)


def test_a_small_cache_and_awkward_texts(both, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    monkeypatch.setattr(tokens, "CHUNK", 300)
    words = WordTokenizer(tokenizer_path())
    rng = random.Random(8)
    pool = ["the", "The", "the,", "(the)", "...", "don't", "É.", "é", "x1", "日本語", "İ!", "é."]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 400))) for _ in range(200)]
    texts += ["", " ", "\n\n", "a\x0bb\x0cc\td\re", "a\x1cb\x1fc", " a <|endoftext|> b ", "".join(rng.choices("abc \n", k=5000))]
    for _ in range(2):
        same((words, both[1]), texts)
