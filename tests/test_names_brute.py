"""The similarity queries against plain loops with the standard library's matcher."""

import re
from difflib import SequenceMatcher, get_close_matches

import pytest

from scorelake.operators import names as N
from scorelake.plans import facts as P
from scorelake.plans.queries import QUERIES, name_pool

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pool(spark):
    return sorted({r.model_name for r in name_pool(spark, SF).collect()})


@pytest.fixture(scope="module")
def aliases(spark):
    return {r.alias: r.canonical_name for r in P.aliases(spark, SF).collect()}


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def squash(s):
    return re.sub(r"[\s\-_]+", "", s.lower())


def closest(name, canon):
    """As the library's close matches are ordered: by ratio with the name second, then by text."""
    found = [(ratio(c, name), c) for c in canon]
    return max([x for x in found if x[0] >= 0.6], default=None)


def bare(name):
    for w in ("agentless", "swe[-_]?agent", "auto(code)?rover", "rag", "composio", "tools?", "moatless", r"epam\s*ai"):
        name = re.sub(rf"^{w}\s*\+?\s*", "", name.lower().strip() if w == "agentless" else name)
    return re.sub(r"^.*\s*\+\s*", "", name).strip()


def pattern(name):
    best = None
    for k, (family, p, base) in enumerate(N.family_rules()):
        if m := re.search(p, bare(name)):
            sure = round(min(1.0, base + 0.05 * bool(re.match(p, bare(name)))), 6) if m else 0
            if best is None or (sure, -k) > best[:2]:
                best = sure, -k, family
    return best


def test_closest_agrees_with_the_library():
    canon = ["model1", "model12", "mode", "xyz"]
    assert closest("model2", canon)[1] == get_close_matches("model2", canon, 1, 0.6)[0]


def test_e8(spark):
    facts = sorted({r.model_name for r in P.facts(spark, SF).select("model_name").distinct().collect()})
    got = {r.model_name: (r.canonical, r.confidence) for r in QUERIES["e8_fuzzy"](spark, SF).collect()}
    want = {}
    for f in facts:
        name = f.replace("model-", "Modle_").lower()
        if c := closest(name, facts):
            want[f.replace("model-", "Modle_")] = c[1], ratio(name, c[1])
    assert got == want and got


def normal(name, aliases):
    low = {a.lower(): c for a, c in sorted(aliases.items(), reverse=True)}
    if name.lower() in low:
        return low[name.lower()], 1.0, "exact"
    if (p := pattern(name)) and p[0] >= 0.7:
        return p[2], p[0], "pattern"
    canon = {c.lower(): c for c in aliases.values()}
    c = closest(name.lower(), canon)
    if c and ratio(name.lower(), c[1]) >= 0.7:
        return canon[c[1]], round(ratio(name.lower(), c[1]), 6), "fuzzy"
    return name, 0.1, "manual"


def test_e9_and_e16(spark, pool, aliases):
    want = {n: normal(n, aliases) for n in pool}
    got = {r.original: (r.canonical, r.confidence, r.match_type) for r in QUERIES["e9_normalize_names"](spark, SF).collect()}
    assert got == want and len({x[2] for x in want.values()}) >= 3
    rows = sorted([(-s, n) for n, (_, s, kind) in want.items() if s >= 0.7 and kind != "exact"])[:50]
    assert [r.original for r in QUERIES["e16_suggest"](spark, SF).collect()] == [n for _, n in rows]


def resolved(name, aliases):
    if name in aliases:
        return aliases[name], "exact"
    if name.lower() in aliases:
        return aliases[name.lower()], "lower"
    by = {}
    for a, c in aliases.items():
        by.setdefault(squash(a), []).append(c)
    if squash(name) in by:
        return min(by[squash(name)]), "squashed"
    targets = [(squash(c), c, 0) for c in set(aliases.values())] + [(squash(a), c, 1) for a, c in aliases.items()]
    near = [(ratio(squash(name), t), -late, c) for t, c, late in targets]
    if max(near)[0] >= 0.85:
        return max(near)[2], "fuzzy"
    for p, v in N.KNOWN_PATTERNS:
        if re.match(f"(?i){p}", name):
            return v, "pattern"
    return name, "self"


def test_e10_and_e11(spark, pool, aliases):
    want = {n: resolved(n, aliases) for n in pool}
    got = {r.model_name: (r.resolved, r.stage) for r in QUERIES["e10_resolve_names"](spark, SF).collect()}
    assert got == want
    learnt = {(n, c, f"{s}_match", 0.85 if s == "fuzzy" else 0.9) for n, (c, s) in want.items() if s in ("fuzzy", "pattern") and n not in aliases}
    rows = {(r.alias, r.canonical_name, r.source, r.confidence_score) for r in QUERIES["e11_learn_aliases"](spark, SF).collect()}
    assert {r for r in rows if r[2] != "seed"} == learnt and len(rows) == len(learnt) + len(aliases)
