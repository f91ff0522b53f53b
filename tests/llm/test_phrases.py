"""Phrase mining against plain counts, whatever the shards."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import phrases
from scorelake.llm.phrases import Transform, collocations, index_of


def plain(rows, least, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(zip(*(w[i:] for i in range(k)), strict=False))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        held = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        gone = {s for k, v in held.items() if len(k) == 3 for s in (k[:2], k[1:]) if 100 * v >= 50 * held[s]}
        own = []
        for k, a in held.items():
            if k not in gone:
                score, _, left, right = min((1000000 * a * a // (c[k[:i]] * c[k[i:]]), i, c[k[:i]], c[k[i:]]) for i in range(1, len(k)))
                own.append((-score, -a, " ".join(k).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])]
    return sorted(out)


def found(df, **options):
    return sorted(map(tuple, collocations(df, **options).collect()))


@pytest.mark.parametrize("shard_words, window, listed", [(7, 3, True), (7, 1 << 20, False), (100, 50, True), (1 << 20, 3, False), (1 << 20, 1 << 20, True)])
def test_against_plain(spark, monkeypatch, shard_words, window, listed):
    """Texts longer than a shard, pieces over cuts, ties, both cases, null and empty texts and languages, repeated rows; with a list of the
    frequent words, and without as where they are too many for one."""
    monkeypatch.setattr(phrases, "WINDOW_BYTES", window)
    if not listed:
        monkeypatch.setattr(phrases, "MOST_WORDS", 0)
    rng = random.Random(window)
    words = ["a", "B", "cc", "é", "New", "YORK", "-", "x" * 30, "日本"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " ;", "\x1f"]) for _ in range(n))
    rows = [(text(n), rng.choice(["en", "de", None])) for n in (0, 1, 2, 3, 40, 400, 300)] + [(None, "en"), ("", "fr"), ("New york " * 30, "en"), (" .. ", None), ("one two", "fr")]
    rows += rows[-3:]
    df = spark.createDataFrame([(t, lang, "clash") for t, lang in rows], "text string, lang string, f string").coalesce(2)
    got = found(df, min_count=3, shard_words=shard_words)
    assert got == plain(rows, 3)
    assert len(got) > 20


def test_given_documents(spark, docs):
    assert found(docs, min_count=10, shard_words=3000) == plain([(r.text, r.lang) for r in docs.collect()], 10)


def test_top_and_ties(spark):
    """Phrases of equal score go by their bytes; top cuts after that."""
    rows = [(f"p{i:02d} q{i:02d}.", "en") for i in range(40) for _ in range(12)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df, top=7) == plain(rows, 10, 7)
    assert {r["rank"] for r in collocations(df, top=None).collect()} == {None}


def test_empty(docs, empty):
    assert collocations(empty).collect() == []
    assert collocations(empty.selectExpr("lang", "text")).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_counts_of_many_digits(spark):
    """Products past 64 bits, and quotients that double precision would round up."""
    n = 10**13
    rows = [(n, n, n), (n - 1, n, n), (9_999_999_999_999, 99_999_999_999_999, 10_000_000_000_001), (10, 10, 3 * n), (123_456_789_012, 987_654_321_987, 55_555_555_555_555)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r[0] for r in df.select(phrases.score(df.a, df.l, df.r)).collect()]
    assert got == [10**6 * a * a // (left * right) for a, left, right in rows]


def test_driver_gets_pages_only(spark, monkeypatch):
    """Neither the frequent words nor the bits of their bitmaps come to the driver a row each."""
    rows = [(f"w{i} v{i} u{i}.", "en") for i in range(1500) for _ in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    want, brought = plain(rows, 3), []
    kind = type(df)
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toArrow", "toLocalIterator"):
            m.setattr(kind, name, lambda self, *a, f=getattr(kind, name), **b: (brought.append(len(out := f(self, *a, **b))), out)[1])
        out = collocations(df, min_count=3)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 1000
    assert sum(brought) < 100


def test_words_of_one_hash(spark, monkeypatch):
    """A frequent word whose hash another one has, even a rare one, isn't told by its hash; rare ones of one hash don't matter."""
    words = spark.createDataFrame([("en", "aa", 50), ("en", "ab", 3), ("en", "ba", 60), ("en", "ca", 2), ("en", "cb", 1)], "lang string, w1 string, f long")
    assert phrases.told_apart(words, 10)
    monkeypatch.setattr(phrases, "full_hash", lambda lang, word: F.ascii(word))
    assert not phrases.told_apart(words, 10)
    assert phrases.told_apart(words.where("w1 != 'ab'"), 10)


def test_extension_both_ways():
    """Intervals of every phrase in both transforms, found by extension to the right and to the left, hold its occurrences."""
    rng = np.random.default_rng(5)
    t = np.concatenate([[0], rng.integers(0, 5, 300), [0]]).astype(np.int32)
    forward, backward = map(Transform, index_of(t, 4))
    sizes = np.bincount(t, minlength=5)
    lows = np.cumsum(sizes) - sizes
    w = np.arange(1, 5)
    at, y, back, ahead, n = backward.extend(lows[w], lows[w], sizes[w], 5)
    want = Counter(zip(t[:-1].tolist(), t[1:].tolist(), strict=True))
    assert {(a, b): c for a, b, c in zip(w[at].tolist(), y.tolist(), n.tolist(), strict=True)} == {k: v for k, v in want.items() if 0 not in k}
    for way in ("left", "right"):
        if way == "left":
            up, x, *_, m = forward.extend(ahead, back, n, 5)
            got = zip(x.tolist(), w[at][up].tolist(), y[up].tolist(), m.tolist(), strict=True)
        else:
            up, x, *_, m = backward.extend(back, ahead, n, 5)
            got = zip(w[at][up].tolist(), y[up].tolist(), x.tolist(), m.tolist(), strict=True)
        want = Counter(zip(t[:-2].tolist(), t[1:-1].tolist(), t[2:].tolist(), strict=True))
        assert {(a, b, c): v for a, b, c, v in got} == {k: v for k, v in want.items() if 0 not in k}
