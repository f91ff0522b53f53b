"""The packed automaton against all windows of small items and texts, and its size a word."""

import random

import numpy as np
import pytest

from scorelake.llm import automaton
from scorelake.llm.decontam import words_of


def plain(items, window, texts):
    named = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            named.setdefault(tuple(words[i : i + size]), set()).add(item)
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for size in {len(k) for k in named}:
            for i in range(len(words) - size + 1):
                if own := named.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        yield len(words), hit, sorted(found)


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_against_all_windows(monkeypatch, stretch):
    monkeypatch.setattr(automaton, "STRETCH", stretch)
    r = random.Random(stretch)
    for _ in range(200):
        window, letters = r.randint(1, 6), [b"a", b"b", b"c", b"d", b"zz"][: r.randint(1, 5)]
        text = lambda *sizes: b" ".join(r.choice(letters) for _ in range(r.choice(sizes)))  # noqa: B023, E731
        items = [(str(r.randint(0, 6)), text(0, 1, 2, 3, 8, 20)) for _ in range(r.randint(0, 6))]
        texts = [b" ".join([text(0, 1, 5, 30), *([b"other", text(0, 5)] if r.random() < 0.5 else [])]) for _ in range(r.randint(0, 5))]
        sizes, (at, first, end), (item_at, names) = automaton.Automaton(items, window, words_of).match(texts)
        assert len(at) == len(item_at) == len(texts) + 1
        for i, (n, hit, found) in enumerate(plain(items, window, texts)):
            own = list(zip(first[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist(), strict=True))
            assert sizes[i] == n and names[item_at[i] : item_at[i + 1]] == found
            assert {k for a, b in own for k in range(a, b)} == hit
            assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))  # apart and in order


def test_size_a_word():
    z = np.random.default_rng(3)
    words = [b"w%d" % k for k in z.zipf(1.2, 100_000).clip(1, 50_000).tolist()]
    own = automaton.Automaton([(str(i), b" ".join(words[i : i + 500])) for i in range(0, len(words), 500)], 10, words_of)
    assert own.nbytes() < 80 * len(words)
    sizes, (at, first, end), (_, names) = own.match([b" ".join(words[1000:1600])])
    assert (sizes.tolist(), first.tolist(), end.tolist(), "1000" in names) == ([600], [0], [600], True)
