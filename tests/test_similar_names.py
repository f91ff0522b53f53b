"""Similar names: both ways to search against all pairs, names exactly at the threshold, names of one shape."""

import random
from difflib import SequenceMatcher

import pytest

from scorelake.operators import similar
from scorelake.operators.similar import common_lengths, search_plan, similar_pairs


@pytest.mark.parametrize("threshold, sizes", [(0.6, (3, 7)), (0.85, (17, 23)), (0.85, (34, 46))])
def test_boundary_lengths_meet(spark, threshold, sizes):
    text = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ"
    short, long = (text[:n] for n in sizes)
    for a, b in ((short, long), (long, short)):
        left, right = spark.createDataFrame([(a,)], "name string"), spark.createDataFrame([(b,)], "other string")
        assert similar_pairs(left, right, threshold).first().ratio == threshold


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_lengths(monkeypatch):
    """Against the usual table, over one, two and three words of bits, and slices of columns."""
    monkeypatch.setattr(similar, "COLUMNS", 7)
    rng = random.Random(1)
    for longest in (5, 63, 64, 65, 128, 150):
        make = lambda: "".join(rng.choice("abcdé日") for _ in range(rng.choice([1, longest, rng.randint(1, longest)])))  # noqa: B023, E731
        left, right = [make() for _ in range(20)], [make() for _ in range(20)]
        for start, got in common_lengths(left, right):
            assert got.tolist() == [[plain_common(a, b) for b in right[start : start + got.shape[1]]] for a in left]


@pytest.fixture
def way(request, monkeypatch):
    monkeypatch.setattr(similar, "KEY_COST", {"deletion": 0.0, "blocks": 1.0}[request.param])
    monkeypatch.setattr(similar, "BLOCK", 8)
    return request.param


@pytest.mark.parametrize("way", ["deletion", "blocks"], indirect=True)
@pytest.mark.parametrize("threshold", [0.6, 0.85])
@pytest.mark.parametrize("swap", [False, True])
def test_every_pair_and_the_best(spark, way, threshold, swap):
    rng = random.Random(2)
    words = ["", None, "a", "aa", "ab", "aab", "tide", "diet", "GPT-4", "gpt-4o", "日本語モデル", "日本モデル", "claude-3-opus", "claude-3.5-opus", "x" * 70, "x" * 69 + "y"]
    words += ["".join(rng.choice("ab-1") for _ in range(rng.randint(1, 9))) for _ in range(40)] + [f"vendor-{rng.randrange(1000):03d}" for _ in range(20)]
    others = [*words[5:], *(w + "s" for w in words[6:30])]
    plan = search_plan({9: 100}, {9: 100}, threshold)
    assert plan[0][5] == (way == "deletion")
    left = spark.createDataFrame([(w,) for w in words + words[:9]], "name string")
    right = spark.createDataFrame([(w, w[::-1]) for w in others + others[:9]], "other string, prefer string")
    ratio = lambda a, b: SequenceMatcher(None, b, a).ratio() if swap else SequenceMatcher(None, a, b).ratio()
    want = {(a, b): ratio(a, b) for a in words if a for b in others if ratio(a, b) >= threshold}
    got = similar_pairs(left, right, threshold, swap).collect()
    assert {(r.name, r.other): r.ratio for r in got} == want
    assert len(got) == len(want) > 100
    best = {}
    for (a, b), r in want.items():
        best[a] = max(best.get(a, (0, "", "")), (r, b[::-1], b))
    got = similar_pairs(left, right, threshold, swap, best=True).collect()
    assert {r.name: (r.ratio, r.prefer, r.other) for r in got} == best
    assert len(got) == len(best)


def test_many_names_of_one_shape_meet_by_deletion():
    """What is to be hashed and compared grows close to linearly in names that differ in a few characters."""

    def cost(n):
        (_, _, c, i, j, by_deletion), *_ = search_plan({18: n}, {18: n}, 0.85)
        return 2 * n * similar.math.comb(18, c) * similar.KEY_COST if by_deletion else i * j * similar.BLOCK**2 * similar.PAIR_COST

    assert cost(160_000) < 12 * cost(16_000)


@pytest.mark.parametrize("swap", [False, True])
def test_best_pairs_at_higher_ratios_first(spark, monkeypatch, swap):
    """Names that have a pair at a ratio go no further, and the best pair stays the best of all, ties and names without one too."""
    monkeypatch.setattr(similar, "LADDER_COST", 0.0)
    monkeypatch.setattr(similar, "BLOCK", 8)
    tried, search = [], similar._search
    monkeypatch.setattr(similar, "_search", lambda a, b, na, *rest: tried.append((rest[1], sum(na.values()))) or search(a, b, na, *rest))
    others = [f"model-{k}" for k in (*range(12), *range(120, 140), *range(5000, 5040), *range(88000, 88050))]
    words = [t.replace("model-", "modle_") for t in others] + ["", None, "zzz", "model-12", "xxmodel-88012xx"]
    got = similar_pairs(spark.createDataFrame([(w,) for w in words], "name string"), spark.createDataFrame([(o, o[::-1]) for o in others], "other string, prefer string"), 0.6, swap, best=True).collect()
    ratio = lambda a, b: SequenceMatcher(None, b, a).ratio() if swap else SequenceMatcher(None, a, b).ratio()
    best = {w: max(((ratio(w, o), o[::-1], o) for o in others if ratio(w, o) >= 0.6), default=None) for w in words if w}
    assert {r.name: (r.ratio, r.prefer, r.other) for r in got} == {w: b for w, b in best.items() if b}
    assert tried[0] == (0.95, len([w for w in words if w])) and tried[-1][0] == 0.6 and tried[-1][1] <= 5 < tried[3][1]


def test_names_that_meet_too_often_go_by_blocks(spark, monkeypatch):
    """Deletion looks cheap by the number of keys, but names with one beginning and a digit in common meet."""
    monkeypatch.setattr(similar, "PAIR_COST", 2e-6)
    a = spark.createDataFrame([(f"modle_{k}", 9) for k in range(100, 700)], "name string, la int")
    b = spark.createDataFrame([(f"model-{k}", f"model-{k}", 9) for k in range(100, 700)], "other string, prefer string, lb int")
    assert search_plan({9: 600}, {9: 600}, 0.5)[0][5]
    found = similar._search(a, b, {9: 600}, {9: 600}, 0.5, True, True)
    assert "MapInPandas keys" not in found._jdf.queryExecution().analyzed().toString()
    assert {(r.name, r.other) for r in found.collect()} == {(f"modle_{k}", f"model-{k}") for k in range(100, 700)}
