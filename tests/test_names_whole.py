"""Near-duplicate names and the registry with all that belongs to them."""

from itertools import combinations

from scorelake.operators import names as N


def test_classes_and_pairs_give_all_pairs(spark):
    raw = ["model20", "model200", "MODEL-20", "model-20", "model-21", "alpha", "alpha", "alphas", "", None, "zq"]
    df = spark.createDataFrame([(x,) for x in raw], "model_name string")
    classes = {r.model_name: (r.key, r.n) for r in N.name_classes(df).collect()}
    linked = {frozenset((r.key_a, r.key_b)): (r.n_a, r.n_b) for r in N.near_duplicate_names(df).collect()}
    real = sorted({x for x in raw if x})
    want = {(a, b) for a, b in combinations(real, 2) if len(set(a.lower()) & set(b.lower())) > 0.8 * len(set(a.lower()) | set(b.lower()))}
    got = {(a, b) for a, b in combinations(real, 2) if classes[a][0] == classes[b][0] or frozenset((classes[a][0], classes[b][0])) in linked}
    assert ("model20", "model200") in got and got == want and classes["model20"][1] == 2
    assert N.near_duplicate_count(df).first().n_pairs == len(want)


def test_query_gives_every_pair(spark, tmp_path):
    """Each two linked names are a row with their similarity, within a class and between two, and no other names are."""
    from scorelake.plans import facts as P
    from scorelake.plans.queries import QUERIES

    users = [*range(0, 60), 200, 2000, 1212]
    rows = [(i, u) for i, u in enumerate([*users, *users[:5]])]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    real = sorted({r.model_name for r in P.names(spark, str(tmp_path)).collect()})
    chars = {x: set(x.lower()) for x in real}
    want = {(a, b): round(len(chars[a] & chars[b]) / len(chars[a] | chars[b]), 6) for a, b in combinations(real, 2)}
    want = {k: v for k, v in want.items() if v > 0.8}
    got = QUERIES["e31_near_duplicate_names"](spark, str(tmp_path)).collect()
    assert {(r.name_a, r.name_b): r.similarity for r in got} == want and len(got) == len(want)
    assert {1.0} < set(want.values())
