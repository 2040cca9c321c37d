import random

import pytest

from quadloom.llm import tokens as T

WHITE = [" ", "\n", "\t", "　", "\xa0", " "]


def check(text):
    for special, own in ((True, T.encode), (False, T.ordinary)):
        assert own(text).tolist() == T.library(T.BYTE_BPE, special).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("before", ["", "a", "a ", "<|endoftext|>"])
@pytest.mark.parametrize("after", ["", "b", "!", "<|endoftext|>", "\x1c"])
def test_long_white_space(before, after):
    rng = random.Random(len(before) * 10 + len(after))
    check(before + " " * 300_000 + after)
    check(before + "".join(rng.choice(WHITE) for _ in range(50_000)) + after)


def test_a_million_white_space_characters():
    for text in (" " * 1_100_000, "\n" * 1_100_000, "x" + " \n" * 550_000 + "y"):
        check(text)


def test_runs_of_all_lengths_among_words():
    rng = random.Random(5)
    for _ in range(60):
        check("".join(rng.choice(["a", rng.choice(WHITE) * rng.randint(1, 3 * T.LONG), "bc d", "<|endoftext|>", "\xe9", "word " * 2000]) for _ in range(rng.randint(1, 8))))


def test_long_words():
    check("a" * 200_000)
    check("日本" * 50_000)


def test_audit_sees_another_segmentation(monkeypatch):
    texts = ["some words", "more of them", "x" * (3 * T.AUDIT_CHARS)]
    T.audit(texts)
    assert list(T.audited([])) == [] and T.audited(texts) is not None
    assert all(len(part) <= T.AUDIT_CHARS for _, part in T.audited(texts))
    plain = T.encode
    monkeypatch.setattr(T, "encode", lambda t, path: plain(t, path)[:-1])
    with pytest.raises(T.ParityError):
        T.audit(texts)
