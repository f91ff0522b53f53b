"""The registry with its aliases."""

from scorelake.operators import names as N


def test_registry_by_alias(spark):
    old = spark.createDataFrame([("gpt-x", 1, 5, 3)], "model_id string, first_seen long, last_seen long, n_scores long")
    aliases = spark.createDataFrame([("nickname", "gpt-x"), ("gpt x", "gpt-x")], "alias string, model_id string")
    batch = spark.createDataFrame([("Nickname", 9), ("GPT X", 7), ("GPT_X", 6), ("New One", 8)], "model_name string, scraped_at long")
    got = {r.model_id: (r.first_seen, r.last_seen, r.n_scores, r.is_new) for r in N.register_models(batch, old, aliases).collect()}
    assert got == {"gpt-x": (1, 9, 6, False), "new-one": (8, 8, 1, True)}
    added = {tuple(r) for r in N.registered_aliases(batch, old, aliases).collect()}
    assert added == {("nickname", "gpt-x"), ("gpt x", "gpt-x"), ("gpt_x", "gpt-x"), ("new one", "new-one")}
