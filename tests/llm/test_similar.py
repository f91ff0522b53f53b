"""The near-duplicate stage against all pairs of documents."""

import random
from itertools import combinations

import corpus_pipeline
from scorelake.llm import similar
from scorelake.llm.similar import similar_documents


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else {()}


def plain_groups(texts):
    sets, root = {i: plain_shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_stage_drops_edited_copies(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(6)]
    texts = [edited(b, n, rng) for b in base for n in (0, 1, 2, 3, 4, 5, 8, 30)] + [None, "", "two words", "Two  words", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_groups(dict(enumerate(texts)))
    assert 6 * 2 + 2 <= len(set(want.values())) < len(texts) - 6
    assert {r.doc_id for r in corpus_pipeline.duplicate_stage(spark, df, "").collect()} == set(want.values())


def test_large_group_of_edited_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = {i: edited(base, rng.randrange(1, 7), rng) for i in range(150)}
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_groups(texts)


def test_group_without_a_centre(spark, monkeypatch):
    """Copies so edited that few pairs are similar: links that neighbours miss are found block by block, and no pairs are emitted."""
    monkeypatch.setattr(similar, "NEIGHBOURS", 1)
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", 4000)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = {i: edited(base, rng.randrange(3, 11), rng) for i in range(160)}
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_groups(texts)


def test_documents_against_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in similar_documents(df).collect()}
    assert got == plain_groups({r.doc_id: r.text for r in df.collect()})


def test_one_row_of_each_group_stays(spark):
    """An id with two texts, a text with several ids, repeated rows, null ids, null and empty texts: a row of each group of the plain version."""
    rng = random.Random(6)
    base = {c: [f"{c}{rng.randrange(5000)}" for _ in range(200)] for c in "abcdef"}
    near = lambda c: " ".join([*base[c], "tail"])
    text = {c: " ".join(w) for c, w in base.items()}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (9, near("b")), (1, text["a"]), (None, text["c"]), (None, text["c"]), (None, near("c")), (None, text["a"])]
    rows += [(7, text["d"]), (7, near("d")), (7, near("d")), (3, None), (3, ""), (3, None), (4, " "), (8, text["e"]), (8, text["f"]), (8, text["f"])]
    df = spark.createDataFrame([(i, t, f"lang{k}", "key", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, key string, id int").repartition(3)
    got = corpus_pipeline.duplicate_stage(spark, df, "")
    assert got.columns == df.columns
    own = [(r.doc_id, r.text) for r in got.collect()]
    group = plain_groups(dict(enumerate(t for _, t in rows)))
    of_text = {t or "": group[k] for k, (_, t) in enumerate(rows)}
    assert sorted(of_text[t or ""] for _, t in own) == sorted(set(group.values()))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[group[k]] = min(least.get(group[k], (True, 0)), (i is None, i or 0))
    assert all((i is None, i or 0) == least[of_text[t or ""]] for i, t in own)
