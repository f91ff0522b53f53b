"""Operators 2, 3, 6 to 10 and the pipeline against plain versions."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from test_similar import plain_groups
from scorelake.llm import decontam, gam, hilbert, langid, repetition, simhash, url_rules
from scorelake.llm.common import shared_path
from scorelake.llm.queries import PIECES, QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
LABELS = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
ITEMS = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}


# 2


def test_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        at = hilbert.curve_index(list(points.T), bits)
        assert sorted(at) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def laws(rows, n):
    by = Counter(r.shard for r in rows)
    assert len(rows) == n and (n < 8 or set(by) == set(range(8))) and max(by.values(), default=0) - min(by.values(), default=0) <= 1
    for k in by:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(by[k]))


def test_op2(spark):
    rows = QUERIES["op2_hilbert_shards"](spark, SF).collect()
    laws(rows, len(TEXTS))
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_shards_of_odd_repeated_and_no_rows(spark, odd, empty):
    both = odd.union(odd).union(odd)
    for df, n in ((both, both.count()), (empty, 0)):
        path = shared_path(spark, "t")
        hilbert.write_shards(df, path, ("n_chars", "lang", "source"), "doc_id", "text")
        laws(hilbert.read_shards(spark, path, 8).collect(), n)


def test_equal_texts_are_neighbours_and_long_texts_whole(spark):
    long = "word " * 400_000
    rows = [(i, ["same text", f"own {i}", long][i % 3 if i < 60 else 1], "en", None, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = shared_path(spark, "t")
    hilbert.write_shards(df, path, ("n_chars", "lang", "source"), "doc_id", "text")
    got = hilbert.read_shards(spark, path, 8).select("row.doc_id", F.length("row.text").alias("n"), (F.col("row.text") == "same text").alias("same"), "shard", "slot").collect()
    laws(got, 300)
    assert sum(r.n == len(long) for r in got) == 20
    order = [r.same for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert "".join("x" if o else "." for o in order).strip(".") == "x" * 20


def test_names_with_dots_and_long_shared_prefixes(spark):
    df = spark.range(2000).select(F.col("id").alias("doc.id"), F.lit("x").alias("the.text"), F.concat(F.lit("https://host/path/"), F.pmod(F.xxhash64("id"), F.lit(500))).alias("url.of"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n.of"))
    path = shared_path(spark, "t")
    hilbert.write_shards(df, path, ("url.of", "n.of"), "doc.id", "the.text")
    want = {r[0] for r in df.where(F.col("`url.of`").between("https://host/path/10", "https://host/path/19") & F.col("`n.of`").between(100, 900)).collect()}
    within = {"url.of": ("https://host/path/10", "https://host/path/19"), "n.of": (100, 900)}
    assert {r.row["doc.id"] for r in hilbert.read_within(spark, path, within).collect()} == want
    laws(hilbert.read_shards(spark, path, 8).select("row.`doc.id`", "shard", "slot").withColumnRenamed("doc.id", "doc_id").collect(), 2000)


def test_filters_on_any_dimension_leave_files_unread(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), (F.xxhash64("id") % 1000).alias("n_chars"), F.concat(F.lit("l"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5))).alias("lang"), F.concat(F.lit("source/"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(90))).alias("source"))
    path = shared_path(spark, "t")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        hilbert.write_shards(df, path, ("n_chars", "lang", "source"), "doc_id", "text")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = spark.read.parquet(f"{path}/manifest").count()
    assert files > 50
    for within in ({"n_chars": (-100, 20)}, {"lang": ("l2", "l2")}, {"source": ("source/40", "source/49")}, {"n_chars": (0, 300), "lang": ("l0", "l1")}):
        want = df
        for d, (low, high) in within.items():
            want = want.where(F.col(d).between(low, high))
        assert hilbert.files_within(spark, path, within).count() < 0.6 * files
        assert {r.doc_id for r in hilbert.read_within(spark, path, within).select("row.doc_id").collect()} == {r.doc_id for r in want.collect()}
    assert hilbert.read_within(spark, path, {"lang": ("x", "y")}).count() == 0


# 3


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids, root = sorted(prints), {}
    for i in ids:
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op3(spark):
    got = QUERIES["op3_simhash"](spark, SF).collect()
    prints = {i: plain_fingerprint(t) for i, t in TEXTS.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints)


def test_long_chains_and_hubs_of_fingerprints(spark, monkeypatch):
    prints = {k: (1 << k) - 1 for k in range(0, 64, 2)} | {100 + k: (1 << 63) | (0b101 << (k % 60)) for k in range(30)} | {200 + k: 0 for k in range(50)}
    prints |= {900: 0xF0F0 << 40}
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: df)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == plain_components(prints)


def test_clashing_names_and_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in enumerate([long, long + " x", "a b c", None])], "doc_id long, text string, fp long, id long, first long, key long, component_id long")
    for how in ({}, {"words": 5, "similarity": 0.8}):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, **how).collect()}
        assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_odd_texts_repeated_rows_and_no_rows(spark, odd, empty):
    got = simhash.near_duplicates(odd.union(odd)).collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in odd.collect()}
    assert len(got) == 2 * len(prints) and {r.doc_id: r.component_id for r in got} == plain_components(prints)
    assert not simhash.near_duplicates(empty).count()


# 6 and 7


def test_op6_on_held_out_rows(spark):
    got = QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.93 * len(held)


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.Gam().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert (gam.Gam().fit(x[:0], y[:0]).score(x) == 0.5).all()


def test_features_ignore_neighbours(odd):
    texts = [(r.text or "").encode() for r in odd.collect()]
    assert np.allclose(gam.features(texts), np.concatenate([gam.features([t]) for t in texts]), equal_nan=False)


def plain_features(text):
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", text), [x for x in text.split(b"\n") if x]
    if not words:
        return [0.0] * len(gam.FEATURES)
    n, size = len(words), sum(map(len, words))
    counts = [sum(text.count(bytes([c])) for c in kind) / size for kind in gam._CLASSES]
    seen, again = set(), 0
    for x in lines:
        again += len(x) * (x in seen)
        seen.add(x)
    return [np.log1p(n), size / n, *counts, n / max(1, len(lines)), sum(a == b for a, b in zip(words, words[1:])) / n, (n - len(set(words))) / n, again / size]  # noqa: B905


def test_op6_features_and_scores_are_sums_of_tables(spark):
    confused = ["c", "d"]
    for _ in range(10):
        confused = [confused[0] + confused[1], confused[1] + confused[0]]
    texts = [(t or "").encode() for t in [*TEXTS.values(), "\n".join(confused), " ".join(confused), "a a b\na a b\n\nc"]]
    x = gam.features(texts)
    assert np.allclose(x, [plain_features(t) for t in texts], rtol=1e-5)
    model = gam.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for row, score in zip(x.tolist(), model.score(x).tolist(), strict=True):
        total = model.base + sum(float(t[sum(v >= e for e in edges)]) for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        cell = lambda j, row=row: sum(row[j] >= e for e in model.coarse[j])
        total += sum(float(t[cell(a), cell(b)]) for a, b, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
    got = {r.doc_id: r.score for r in QUERIES["op6_quality"](spark, SF).collect()}
    assert np.allclose([got[i] for i in TEXTS], model.score(gam.features([(t or "").encode() for t in TEXTS.values()])))


def test_quality_of_repeated_rows_and_clashing_names(spark):
    rows = [(i % 40, f"good text number {i}, it has commas and stops." if i % 2 else "x x x x x x", 1, 2, 3, 4) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y long, x long, label_id long, id long")
    labels = spark.createDataFrame([(i, i % 2, 9, 9) for i in range(40)] * 3 + [(1, 0, 9, 9)], "doc_id long, quality int, y int, label_id int")
    model = gam.fit_quality(df, labels)
    got = df.select("y", "label_id", gam.quality_score(model, F.col("text")).alias("s"), (F.col("doc_id") % 2).alias("want")).collect()
    assert len(got) == 400 and all((r.s >= 0.5) == bool(r.want) for r in got)


def test_quality_of_odd_and_no_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        model = gam.fit_quality(odd, rows)
        assert all(0 <= r.s <= 1 for r in odd.select(gam.quality_score(model, F.col("text")).alias("s")).collect())
        assert not empty.select(gam.quality_score(model, F.col("text"))).count()


def test_op7_on_held_out_rows(spark):
    got = QUERIES["op7_language"](spark, "/root/testdata/sf0.01").collect()
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def plain_log(word, number, p):
    """Sum over all segmentations, in whole numbers' fractions."""
    from fractions import Fraction

    q = [Fraction(float(x)) for x in p]
    sums = [Fraction(1)]
    for j in range(1, len(word) + 1):
        sums.append(sum(sums[i] * q[number[word[i:j]] if word[i:j] in number else 1 if j - i == 1 else 0] for i in range(max(0, j - 6), j)))
    return float(np.log(float(sums[-1] * 10**300))) - 300 * np.log(10) if sums[-1] > Fraction(1, 10**290) else None


def test_very_long_words_by_stretches(monkeypatch):
    """Equal to the recurrence a letter at a time, whatever the steps and stretches; and a long one in bounded time."""
    rng = np.random.default_rng(3)
    pieces = ["a", "b", "ab", "ba", "aab", "abab", "bbbbb"]
    lattice = langid.Lattice(pieces)
    p = np.vstack([np.zeros(3), rng.random((len(pieces) + 1, 3)) * 10.0 ** -rng.integers(0, 9, (len(pieces) + 1, 3))])
    words = ["".join(rng.choice(["a", "b", "c"], n)) for n in (1, 5, 16, 300, 1000, 5000)]
    monkeypatch.setattr(langid, "LONG_WORD", 10**9)
    want = langid.log_probabilities(lattice, words, p)
    for step, stretch in ((7, 3), (64, 16), (1000, 999), (1 << 17, 256)):
        monkeypatch.setattr(langid, "LONG_STEP", step)
        monkeypatch.setattr(langid, "STRETCH", stretch)
        for w, own in zip(words, want, strict=True):
            assert np.allclose(langid.long_log_probability(lattice, w, p), own, rtol=1e-9)
    monkeypatch.setattr(langid, "LONG_WORD", 1 << 12)
    began = time.process_time()
    got = langid.log_probabilities(lattice, ["ab" * 500_000, "ab"], p)
    assert np.isfinite(got).all()
    assert time.process_time() - began < 60


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "abab", "\u0436", "\u0436\u0438", " \u0436"]
    lattice, number = langid.Lattice(pieces), {x: i + 2 for i, x in enumerate(pieces)}
    p = np.array([0.0, 0.01, 0.3, 0.2, 0.1, 0.4, 0.05, 0.2, 0.3, 0.15])
    words = ["abab", "ba", "xab", " \u0436\u0438\u0436", "\u0436\u0438" * 30, "ab" * 40, "x", "\U0001f600a"]
    got = langid.log_probabilities(lattice, words, p[:, None])[:, 0]
    assert np.allclose(got, [plain_log(w, number, p) for w in words])
    counts = langid.expected(lattice, ["ba"], np.array([2.0]), p)
    both = p[5] + p[4] * p[2]
    assert np.allclose(counts[[2, 4, 5]], [2 * p[4] * p[2] / both, 2 * p[4] * p[2] / both, 2 * p[5] / both])


def test_words_of_any_length_stay_in_scale():
    lattice = langid.Lattice(["a", "ab", "b"])
    p = np.array([[0.0, 0.0], [1e-9, 1e-9], [0.3, 1e-4], [0.2, 1e-5], [0.1, 1e-4]])
    for unit, one in (("a", p[2]), ("x", p[1])):
        got = langid.log_probabilities(lattice, [unit * 5000, unit], p)
        assert np.allclose(got[0], 5000 * np.log(one)) and np.allclose(got[1], np.log(one))
    long = langid.log_probabilities(lattice, ["ab" * 3000, "ab" * 6000], p)
    assert np.isfinite(long).all() and np.allclose(long[1], 2 * long[0])
    counts = langid.expected(lattice, ["ab" * 3000], np.array([1.0]), p[:, 0])
    assert np.allclose(counts[2] + counts[3], 3000) and np.allclose(counts[4] + counts[3], 3000)


def test_words_are_lower_case_in_every_script():
    texts = ["\u041f\u0440\u0418\u0432\u0435\u0442, \u039a\u0391\u039b\u0397! \u00c9t\u00c9 x9y", "\u65e5\u672c\u8a9e\u3002\u6587", "\u0939\u093f\u0928\u094d\u0926\u0940 \u0130x", "PLAIN a1b", "\u00d7\u00f7 \u00aa"]
    want = [["\u043f\u0440\u0438\u0432\u0435\u0442", "\u03ba\u03b1\u03bb\u03b7", "\u00e9t\u00e9", "x", "y"], ["\u65e5\u672c\u8a9e", "\u6587"], ["\u0939\u093f\u0928\u094d\u0926\u0940", "i\u0307x"], ["plain", "a", "b"], ["\u00aa"]]
    assert [[w for b in langid.words_in(t.encode()) for w in b] for t in texts] == want
    long = "W\u00c4nde " * 400_000
    assert sum(len(b) for b in langid.words_in(long.encode())) == 400_000 and {w for b in langid.words_in(long.encode()) for w in b} == {"w\u00e4nde"}


def test_languages_are_learnt_from_all_documents(spark, monkeypatch):
    seen, real = [], langid._learnable
    monkeypatch.setattr(langid, "_learnable", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, "dos").otherwise("uno").alias("text"), F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("lang"))
    assert langid.fit_languages(df, PIECES, with_floors=True).languages == ["a", "b"]
    assert seen[0][0].count() == df.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).count() > 5000


def test_text_bounds_are_of_all_rows(spark):
    """Exact quantiles, with repeats and over several parts; of few values all, a single row's too."""
    rows = sorted([f"v{k:05d}" for k in range(20_000)] + ["v07777"] * 9_000, key=str.encode)
    df = spark.createDataFrame([(v,) for v in rows[::-1]] + [(None,)] * 50, "`a.b` string")
    for n in (8, 32):
        assert hilbert.text_bounds(df, "a.b", n) == sorted({rows[len(rows) * k // n] for k in range(1, n)}, key=str.encode)
    few = spark.range(30_000).select(F.when(F.col("id") == 12_345, "\uffee").when(F.col("id") % 2 == 0, "\U0001f600").otherwise("").alias("v"))
    assert hilbert.text_bounds(few, "v", 32) == ["", "\uffee", "\U0001f600"]


def test_op7_of_clashing_names_ties_and_repeated_rows(spark):
    rows = [(i, t, lang, 1, 2, 3) for i, (t, lang) in enumerate([("uno dos", "b"), ("uno dos", "a")] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred long, score long, n long")
    even = df.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    n = min(even.where("lang = 'a'").count(), even.where("lang = 'b'").count())
    same = even.where("lang = 'a'").limit(n).union(even.where("lang = 'b'").limit(n))
    model = langid.fit_languages(same, PIECES)
    assert {(r.x.lang_pred, round(r.x.score, 6)) for r in df.select("lang_pred", langid.language(model, F.col("text")).alias("x")).collect()} == {("a", 0.5)}


def test_what_no_learned_language_explains(spark, docs):
    model = langid.fit_languages(docs, PIECES, with_floors=True)
    odd = [(0, "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22 " * 40), (1, "zqxj vkzq " * 20), (2, "\u03ba\u03b1\u03bb\u03b7\u03bc\u03ad\u03c1\u03b1")]
    got = [r.x.above for r in spark.createDataFrame(odd, "doc_id long, text string").select(langid.language(model, F.col("text")).alias("x")).collect()]
    assert max(got) < 0
    kept = docs.select(langid.language(model, F.col("text")).alias("x")).collect()
    assert all(r.x.above >= 0 for r in kept if r.x.lang_pred != "und")


def test_language_of_odd_and_no_rows(spark, odd, empty, docs):
    model = langid.fit_languages(docs, PIECES, max_docs=50)
    for df in (odd, empty):
        for r in df.select("text", langid.language(model, F.col("text")).alias("x")).collect():
            assert (r.x.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    none = langid.fit_languages(empty, PIECES)
    assert {r.x.lang_pred for r in odd.select(langid.language(none, F.col("text")).alias("x")).collect()} == {"und"}


# 8


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w, n in Counter(windows).items() if n > 1}
    hit = {j for i, w in enumerate(windows) if w in again for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)]
    for n in (5, 7, 10):
        seen, inside = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                inside |= set(range(i, i + n))
            seen.add(g)
        out.append(sum(len(words[j]) for j in inside))
    return out


def test_op8(spark, odd):
    got = [(r, TEXTS[r.doc_id]) for r in QUERIES["op8_repetition"](spark, SF).collect()]
    texts = {r.doc_id: r.text for r in odd.collect()}
    got += [(r, texts[r.doc_id]) for r in repetition.repetition(odd).collect()]
    for r, text in got:
        want = plain_counts(text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.dup_5gram_chars, r.dup_7gram_chars, r.dup_10gram_chars] == want, text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    clean = [r for r, _ in got if LABELS.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)


def plain_kept(text, c):
    """The verdict from plain counts, which are those of plain_counts and the words' characters in repeated lines."""
    seen, lines = set(), 0
    for x in (text or "").split("\n"):
        own = sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", x)))
        lines += own * (x in seen)
        seen.add(x)
    shares = [(lines, 0.30), (c[5], 0.35), (c[6], 0.30), (c[7], 0.25)]
    return not (c[0] < 50 or 100 * c[4] > 50 * c[0]) and all(n <= most * c[1] for n, most in shares)


def test_op8_verdicts(spark):
    for r in QUERIES["op8_repetition"](spark, SF).collect():
        assert r.kept == plain_kept(TEXTS[r.doc_id], plain_counts(TEXTS[r.doc_id]))


def test_op8_of_confusable_strings_long_texts_and_clashing_names(spark, monkeypatch):
    x, y = "c", "d"
    for _ in range(10):
        x, y = x + y, y + x
    texts = [f"{x}\n{y}\n{x}", f"qqqqqqqq{x} c d qqqqqqqq{y} c d", "one two three four\n" * 60_000, None]
    df = spark.createDataFrame([(i % 3, t, 1, True) for i, t in enumerate(texts)], "doc_id long, text string, n_words long, kept boolean")
    key = lambda r: (r.n_words, r.n_repeat_words)
    got = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in repetition.repetition(df).collect()))
    assert got == sorted(tuple(plain_counts(t)[:5]) for t in texts)
    monkeypatch.setattr(repetition, "_BASE", np.uint64(0))  # now an n-gram's hash is that of its last word, so most collide
    for t in (TEXTS[0], "a b c d a x c d q b c d a b c", texts[1]):
        m = repetition.measure([(t or "").encode()])
        assert [int(m[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_5gram_chars", "dup_7gram_chars", "dup_10gram_chars")] == plain_counts(t)


def test_repetition_of_no_rows(empty):
    assert not repetition.repetition(empty).count()


# 9


def plain_verdict(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[1]) if fit else (host, path, None, default)


def test_op9(spark):
    from scorelake.llm.queries import URL_RULES

    urls = {r["page_id"]: r["url"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = QUERIES["op9_url_rules"](spark, SF).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {k: plain_verdict(u, URL_RULES) for k, u in urls.items()}


def test_op9_equals_its_sql(spark):
    import duckdb

    from scorelake.llm.queries import SQL

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    key = lambda r: tuple(x or "" for x in r[1:])
    want = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({SQL['op9_url_rules']})").fetchall(), key=lambda r: r[0])
    got = sorted(QUERIES["op9_url_rules"](spark, SF).select("page_id", "host", "path", "rule", "verdict").collect(), key=lambda r: r[0])
    assert [(r[0], key(r)) for r in got] == [(r[0], key(r)) for r in want]


def test_url_corner_cases(spark):
    rules = [("b.c", "/", "allow"), ("a.b.c", "/x", "block"), ("b.c", "/", "block"), ("c", "/x/y/z", "allow"), ("É.c", "/", "block")]
    urls = [None, "", "nothing", "http://A.b.C/x/y/z?q", "http://b.c", "http://b.c/", "s://ab.c/x/y/z#f", "x://y://b.c/", "http://a.b.c/x", "http://É.c/1", "http://É.C/x://c/", "http://user@b.c:80/x", "http:///x", "http://b.c/\n/x", *["http://b.c/hot"] * 20]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    ruled = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.judge_urls(pages.union(pages), ruled).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id], rules)
    assert not url_rules.judge_urls(pages.limit(0), ruled).count()
    assert {r.verdict for r in url_rules.judge_urls(pages, ruled.limit(0)).collect()} == {"allow"}


def test_long_hosts_and_paths_and_null_ids(spark):
    import time

    rules = [("b.c", "/", "block"), ("a.b.c", "/x", "allow")]
    urls = ["http://" + "l." * 40_000 + "b.c/y", "http://" + "l." * 40_000 + "a.b.c/x" + "/p" * 40_000, "http://" + "x" * 100_000 + "/", "http://.b.c/", "http://..c/"]
    pages = spark.createDataFrame([(None if i == 3 else i, u) for i, u in enumerate(urls)], "page_id long, url string")
    began = time.time()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {None if i == 3 else i: plain_verdict(u, rules) for i, u in enumerate(urls)} and time.time() - began < 30


# 10


def plain_hits(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    words, hit, named = split(text), set(), set()
    for item, t in items:
        own = split(t)
        k = min(window, len(own))
        wanted = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in wanted:
                hit |= set(range(i, i + k))
                named.add(str(item))
    return len(words), hit, sorted(named)


def test_op10(spark):
    for r in QUERIES["op10_decontamination"](spark, SF).collect():
        n, hit, named = plain_hits(TEXTS[r.doc_id], ITEMS.items())
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(named), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()


@pytest.mark.parametrize("block", [10**6, 60])
def test_automaton_against_all_windows(spark, block):
    rng = np.random.default_rng(5)
    draw = lambda n: " ".join(rng.choice(["a", "b", "C", "é9"], n))
    items = [(i, draw(n)) for i, n in enumerate([0, 1, 2, 3, 5, 6, 9, 10, 12, 30, 40, 40])] + [(90, None), (91, "!?"), (9, "zz")]
    docs = [(i, draw(int(n)), "x") for i, n in enumerate(rng.integers(0, 120, 60))] + [(100, None, "x"), (101, "", "x"), (102, items[9][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame(items[4:] if block == 60 else items[6:], "item_id long, text string")
    for r in decontam.match_items(d, b, window=4, block_words=block).collect():
        n, hit, named = plain_hits(dict((x, y) for x, y, _ in docs)[r.doc_id], b.collect(), 4)
        assert r.n_words == n and {j for s in r.spans for j in range(s.first, s.end)} == hit and r["items"] == named
    assert decontam.match_items(d.limit(0), b).count() == 0
    assert all(not r.spans for r in decontam.match_items(d, b.limit(0)).collect())


def test_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before it, {item.title()}! And much after it " + "word " * 60), (2, item), (3, "clean"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "not here"), (3, "clean and more")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: "Before it, ! And much after it " + "word " * 60, 3: "clean", 4: None}


def test_blocks_are_passes_of_their_own(spark):
    """With several blocks a stage has one Python step at most, and results are those of one block."""
    rng = np.random.default_rng(6)
    draw = lambda n: " ".join(rng.choice(["a", "b", "C", "\u00e99"], n))
    items = spark.createDataFrame([(i, draw(int(n))) for i, n in enumerate(rng.integers(0, 60, 30))], "item_id long, text string")
    rows = [(i % 40 if i % 7 else None, draw(int(n)), i) for i, n in enumerate(rng.integers(0, 90, 80))]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, spans long").coalesce(2)
    one = decontam.match_items(docs, items, window=4)
    many = decontam.match_items(docs, items, window=4, block_words=250)
    key = lambda r: (r.doc_id or -1, r.n_words, str(r.spans), str(r["items"]))
    assert sorted(one.collect(), key=key) == sorted(many.collect(), key=key)
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert "MapInArrow" not in many._jdf.queryExecution().executedPlan().toString()
    for coverage in (0.0, 0.3):
        a, b = (decontam.decontaminate(docs, items, max_coverage=coverage, window=4, block_words=n) for n in (10**6, 250))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.columns == docs.columns


def test_rows_are_judged_by_their_own_text(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "clean text"), (1, f"a {item} b " + "w " * 90), (None, f"x {item}"), (None, "fine"), (1, f"a {item} b " + "w " * 90)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontam.decontaminate(docs, bench).collect()), key=str)
    assert got == sorted([(1, "clean text"), (None, "fine"), *[(1, "a  b " + "w " * 90)] * 2], key=str)
    assert {r.text for r in decontam.decontaminate(docs, bench, max_coverage=0.0).collect()} == {"clean text", "fine"}
    long = " ".join(f"v{i}" for i in range(400_000))
    assert decontam.match_items(spark.createDataFrame([(1, f"{long} {item} {long}")], "doc_id long, text string"), bench).first().spans == [(400_000, 400_011)]


# pipeline


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    got = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in got.select("doc_id", "text").collect()}
        got = stage(spark, got, SF).cache()
        after = {r.doc_id for r in got.collect()}
        assert k == len(corpus_pipeline.STAGES) - 1 or got.columns == columns
        if k == 0:
            assert len([i for i, t in before.items() if i not in after and any(c.isalpha() for c in t)]) <= 0.01 * len(before)
        if k == 1:
            own = [i for i in before if i in LABELS]
            assert sum((i in after) == LABELS[i] for i in own) >= 0.93 * len(own)
        if k == 2:
            assert after == set(plain_groups(before).values())
        if k == 3:
            assert after == {i for i, t in before.items() if not plain_hits(t, ITEMS.items())[1]}
        if k == 4:
            assert after == set(before)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == after


def test_pipeline_of_odd_and_no_rows(spark, odd, empty):
    for docs in (odd.select(*empty.columns), empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= 20
