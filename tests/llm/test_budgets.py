"""kept_chars inside the boundary word, from the stored prefix counts."""

import random

import pytest

from tessera.llm import pieces, tokens

PARTS = ["internationalization", "don't", "WE'LL", "x're", "'", "''ve", "<|endoftext|>", "<|endof", "<|ENDOFTEXT|>", "!!!???...", "12", "\u0130", "\u00e9", "e\u0301", "\u4e2d\u6587\u5b57", "\U0001f44d\U0001f3fd", "\u3000", "\u3000\u3000", "\x85", "\u1112\u1161\u11ab", "\u0e01\u0e49", "a" * 24, "!"]


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.tokenizer_path())


def test_kept_inside_equals_the_library(counter):
    rng, library = random.Random(4), tokens.library(tokens.tokenizer_path())
    for _ in range(150):
        word = "".join(rng.choices(PARTS, k=rng.randint(1, 5)))
        each = [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(1, len(word))]
        assert [n for _, n in counter.prefix_runs(word)][:-1] == each, word
        for limit in range(max(each, default=0) + 2):
            assert counter.kept_inside(word, limit) == max((i for i, n in enumerate(each, 1) if n <= limit), default=0)


@pytest.mark.parametrize("letters", ["abcdefghij", "\u4e2d\u6587\u5b57\u7b26"])
def test_a_long_word_is_split_once(counter, letters, monkeypatch):
    rng, calls = random.Random(1), []
    word = "".join(rng.choices(letters, k=20_000))
    prefix = counter.prefix.word
    monkeypatch.setattr(counter.prefix, "word", lambda x: calls.append(len(x)) or prefix(x))
    kept = tokens.budget_prefix(counter, word.encode(), 2048)
    assert sum(calls) <= 4 * len(word.encode()) and len(counter.words) < 1000
    assert 0 < kept < len(word) and counter.count(word[:kept].encode()) <= 2048


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_BYTES", 1 << 20)
    known = tokens.Known(lambda key: key * 2)
    for i in range(400):
        known["x" * 4000 + str(i)]
    assert sum(len(k) + len(v) for k, v in known.items()) <= 1 << 20
    assert len(known["y" * 50_000]) == 100_000 and "y" * 50_000 not in known
    monkeypatch.setattr(pieces, "MOST_BYTES", 1 << 20)
    recent = pieces.Recent(lambda key: key * 2)
    for i in range(400):
        recent["x" * 4000 + str(i)]
    assert sum(len(k) + len(v) for held in (recent, recent.old) for k, v in held.items()) <= 2 << 20
    assert len(recent["y" * 50_000]) == 100_000 and "y" * 50_000 not in recent
