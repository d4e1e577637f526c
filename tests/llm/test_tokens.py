"""The encoder against plain encoding of whole texts, and how much it encodes."""

import random

import numpy as np
import tokenizers

from plumbline.llm import tokens

PARTS = [*"ab1_'.,&|<> \n\t\0", "don't", "word", "Word.,&", "naïve,", "Straße!!", "ǅx", "ª", "²", "½", "Ⅷ", "漢字", "\u180e", "\u200b", "\u0301", "'s", "'S", "x'll,", "<|endoftext|>", "<|endoftext", "|>", "\x1c", "\x85", "\xa0", "\u3000", "  ", "\r\n", "23.4", "foo.bar(baz)", "É'", "ɏ!", "ɐ!", "🙂.", "á÷", "Ġword", "Ċ"]


def plain(texts):
    t = tokenizers.Tokenizer.from_file(tokens.default_path())
    return [np.array(x.ids, dtype="<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_are_exact():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS if rng.random() < 0.6 else " \n.") for _ in range(rng.randrange(15))) for _ in range(20_000)]
    texts += [" ".join(rng.choice(PARTS) for _ in range(rng.randrange(9))) for _ in range(10_000)]
    e = tokens.Encoder(tokens.default_path(), most=50)
    got = [ids for at in range(0, len(texts), 997) for ids in e.ids(texts[at : at + 997])]
    assert [t for t, a, b in zip(texts, got, plain(texts)) if a != b] == []


def test_nul_after_a_space_keeps_the_space():
    texts = ["a \0b", "a\n\0b", "\0b", "a \0"]
    assert tokens.Encoder(tokens.default_path()).ids(texts) == plain(texts)


def test_no_texts_and_empty_ones():
    e = tokens.Encoder(tokens.default_path())
    assert e.ids([]) == [] and e.ids(["", ""]) == [b"", b""]


def test_known_words_are_not_encoded_again_with_new_marks(monkeypatch):
    seen, load = [], tokenizers.Tokenizer.from_file

    class Watched:
        def __init__(self, path):
            self.__dict__["inner"] = load(path)

        from_file = classmethod(lambda cls, path: cls(path))

        def encode(self, text, **how):
            seen.append(text)
            return self.inner.encode(text, **how)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

    expected = plain(["one elaborately two\nthorough", "x elaborately.,& y elaborately) z\nthorough!"])
    monkeypatch.setattr(tokenizers, "Tokenizer", Watched)
    e = tokens.Encoder(tokens.default_path())
    assert e.ids(["one elaborately two\nthorough"]) == expected[:1]
    seen.clear()
    assert e.ids(["x elaborately.,& y elaborately) z\nthorough!"]) == expected[1:]
    assert seen and not any("elaborately" in t or "thorough" in t for t in seen)
