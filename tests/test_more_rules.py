"""Exact rounding, quartiles, ranks, stored state and streams on small inputs."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorelake.functions import scalars as S
from scorelake.operators import boards as B
from scorelake.operators import monitor as M
from scorelake.operators import names as N
from scorelake.operators import normalize as Z
from scorelake.operators import ordered
from scorelake.plans import facts as P
from scorelake.plans import queries as plans
from scorelake.sources import tables as T
from scorelake.sources.shared import shared_path
from scorelake.sources.versioned import VersionedTable
from scorelake.streaming import streams

SF = "/root/testdata/sf0.001"


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(2)
    values = [2.675, 1.005, 0.125, 0.375, -2.675, 1e17, -0.5, 0.5, 1.5, 2.5, 1e-9, 0.0, *(rng.randrange(10**6) / 1000 + 0.0005 for _ in range(500)), *(rng.uniform(-1e4, 1e4) for _ in range(500))]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for n in (0, 1, 2, 3):
        for r in df.select("v", S.round_exact(F.col("v"), n).alias("r")).collect():
            assert r.r == round(r.v, n), (r.v, n)
    assert spark.createDataFrame([(None,)], "v double").select(S.round_exact(F.col("v"), 2)).first()[0] is None


@pytest.mark.parametrize("low", [1, 5, 2000])
def test_quartiles_are_the_values_at_their_places(spark, low):
    """Few and many distinct values, hot ones, null keys and values."""
    rng = random.Random(low)
    rows = [(rng.choice(["a", "a", "b", None]), None if rng.random() < 0.05 else float(rng.randrange(low))) for _ in range(3000)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    for r in Z.quartiles(df, ["k"], "v").collect():
        own = sorted(v for k, v in rows if k == r.k and v is not None)
        assert (r.n, r.q1, r.q3) == (len(own), own[len(own) // 4], own[3 * len(own) // 4])
    flagged = Z.flag_outliers(df, ["k"], "v").collect()
    assert len(flagged) == len(rows) and not any(r.is_outlier for r in flagged if r.v is None)


@pytest.mark.parametrize("low", [1, 2, 40, 10**6])
def test_places_of_large_keys_by_brackets(spark, monkeypatch, low):
    """Keys too large to be put in order at once: hot values, few and many of them, NaN, infinity and null; every place from the first to the
    last, and places outside."""
    monkeypatch.setattr(ordered, "CELLS", 8)
    rng = random.Random(low)
    value = lambda: rng.choice([float(rng.randrange(low)), float(rng.randrange(low)), 7.0, None, float("nan"), float("-inf")])
    rows = [(rng.choice(["a", "a", "b", None]), 1, value()) for _ in range(2000)] + [("one", 1, 7.0), ("one", 2, 8.0), ("none", 1, None), ("none", 1, float("nan"))]
    df = spark.createDataFrame(rows, "`k.1` string, j int, v double").repartition(5)
    places = {"first": lambda n: n * 0, "third": lambda n: n / 3, "last": lambda n: n - 1, "out": lambda n: n + 1}
    got = {(r[0], r[1]): tuple(r)[2:] for r in ordered.order_statistics(df, ["k.1", "j"], "v", places, gathered=20).collect()}
    want = {}
    for k, j in {r[:2] for r in rows}:
        own = sorted(v for a, b, v in rows if (a, b) == (k, j) and v is not None and v == v)
        if own:
            want[k, j] = (len(own), own[0], own[len(own) // 3], own[-1], None)
    assert got == want
    whole = {(r[0], r[1]): tuple(r)[2:] for r in ordered.order_statistics(df, ["k.1", "j"], "v", places).collect()}
    assert whole == want


def test_outliers_leave_nan_alone(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 6, 7, 100)] + [("a", float("nan")), ("a", None)] * 5 + [("b", 1.0), ("b", float("nan"))], "k string, v double")
    assert [r.v for r in Z.flag_outliers(df, ["k"], "v").where("is_outlier").collect()] == [100.0]


def test_ranks_over_keys_and_parts(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.randrange(50), f"m{i:04d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, model_name string").repartition(5)
    got = {r.model_name: r["rank"] for r in B.global_rank(df, "v", keys=["k"]).collect()}
    for key in "ab":
        own = sorted((-v, m) for k, v, m in rows if k == key)
        assert [got[m] for _, m in own] == list(range(1, len(own) + 1))


def test_scales_keep_nulls(spark):
    df = spark.createDataFrame([(None, m) for m in ("elo", "cost", "latency", "accuracy", "x", "token")], "value double, metric string").select("*", F.lit("b").alias("benchmark"), F.lit("l").alias("leaderboard"), F.lit("c").alias("category"))
    assert {r.normalized_value for r in Z.normalize_scores(df).collect()} == {None}


def test_hashes_ignore_order_and_see_changes(spark):
    rows = [("s", "a", 1.0), ("s", "b", None), ("s", "b", None), ("t", "a", 2.0)]
    df = lambda r: spark.createDataFrame(r, "source string, model string, v double")
    of = lambda r: {x.source: x.content_hash for x in M.content_hashes(df(r)).collect()}
    one = of(rows)
    assert one == of(rows[::-1]) and one["s"] != of(rows[:2])["s"] and one["s"] != of([*rows[:2], ("s", "b", 0.0)])["s"]


def test_hash_trees_name_what_has_changed(spark):
    rows = [(s, k, float(k)) for s in "ab" for k in range(300)]
    tree = lambda r: M.content_tree(spark.createDataFrame(r, "source string, k int, v double"), "k").persist()
    one = tree(rows)
    # The root, computed outside Spark.
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    leaves = {}
    for s, k, v in rows:
        if s == "a":
            leaves.setdefault(hashlib.md5(str(k).encode()).hexdigest()[:2], []).append(digest(f'{{"k":{k},"v":{v}}}'))
    leaf = {p: digest("|".join([*(str(sum(int(d[8 * i : 8 * i + 8], 16) for d in ds)) for i in range(8)), str(len(ds))])) for p, ds in leaves.items()}
    above = {a: digest("|".join(leaf[p] for p in sorted(leaf) if p[0] == a)) for a in {p[0] for p in leaf}}
    got = {r.path: r.content_hash for r in one.where("source = 'a'").collect()}
    assert got == {**leaf, **above, "": digest("|".join(above[a] for a in sorted(above)))}
    changed = lambda r: {(x.source, x.path) for x in M.changed_ranges(tree(r), one).collect()}
    at = lambda k: hashlib.md5(str(k).encode()).hexdigest()[:2]
    assert changed(rows[::-1]) == set()
    assert changed([(s, k, -1.0 if (s, k) == ("b", 7) else v) for s, k, v in rows]) == {("b", at(7))}
    assert changed([*rows, ("c", 5, 0.0), ("a", 5, 5.0)]) == {("c", at(5)), ("a", at(5))}
    alone = next(k for k in range(300) if len(leaves[at(k)]) == 1)
    assert changed([r for r in rows if r[:2] != ("a", alone)]) == {("a", at(alone))}


def test_ingesting_a_batch(spark):
    at = F.lit("2024-02-01").cast("timestamp")
    batch = spark.createDataFrame([("GPT-4", "MMLU (5-shot)", 80.0), ("gpt_4", "mmlu", 81.0), ("New", "Code x", None)], "model_name string, benchmark string, value double").withColumns({"leaderboard": F.lit("L"), "scraped_at": at})
    folder, empty = shared_path(spark, "store"), M.Store.empty(spark, batch)
    M.ingest_into(spark, folder, batch, at, "one", empty)
    M.ingest_into(spark, folder, batch.where("model_name = 'GPT-4'"), at, "two", empty)
    store = M.open_store(spark, folder, empty)
    assert {(r.model_id, r.n_scores) for r in store.models.collect()} == {("gpt", 3), ("new", 1)}
    assert {(r.alias, r.model_id) for r in store.aliases.collect()} == {("gpt-4", "gpt"), ("gpt_4", "gpt")}
    assert {(r.benchmark_id, r.display_name, r.category) for r in store.benchmarks.collect()} == {("mmlu", "MMLU (5-shot)", "Reasoning"), ("code-x", "Code x", "Code")}
    assert sorted((r.model_name, r.benchmark, r.value) for r in store.facts.collect()) == [("gpt", "mmlu", 80.0), ("gpt", "mmlu", 80.0), ("gpt", "mmlu", 81.0)]


def test_benchmarks_are_found_by_alias(spark):
    reg = spark.createDataFrame([("mmlu", "MMLU", "Reasoning", False, True, 2.0, "2024-01-01")], "benchmark_id string, display_name string, category string, auto_discovered boolean, is_active boolean, default_weight double, last_updated string").withColumn("last_updated", F.col("last_updated").cast("timestamp"))
    aliases = spark.createDataFrame([("massive test", "mmlu")], "alias string, benchmark_id string")
    batch = spark.createDataFrame([("Massive Test", None), ("Long QA", "needle"), (None, None)], "name string, description string")
    out, more = N.register_benchmarks(batch, reg, aliases, F.lit("2024-02-01").cast("timestamp"))
    assert {(r.benchmark_id, r.category, r.is_new, str(r.last_updated)[:10]) for r in out.collect()} == {("mmlu", "Reasoning", False, "2024-02-01"), ("long-qa", "LongContext", True, "2024-02-01")}
    assert {tuple(r) for r in more.collect()} == {("massive test", "mmlu"), ("long qa", "long-qa")}


def stream_batches(spark, source):
    """Four files of 20 models, of one in the last, whose times come in no order; a stream over them after each is there."""
    schema = "score_id long, model_name string, benchmark string, value double, scraped_at timestamp"
    for k, (day, value) in enumerate([(3, 30.0), (1, 10.0), (5, 50.0), (6, 60.0)]):
        spark.createDataFrame([(k, f"m{i}", "b", value + i) for i in range(20 if k < 3 else 1)], "score_id long, model_name string, benchmark string, value double").withColumn("scraped_at", F.lit(f"2024-01-0{day}").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        yield k, spark.readStream.schema(schema).parquet(source)


def test_stream_upserts_in_any_order(spark):
    source, path, state = (shared_path(spark, n) for n in ("in", "out", "state"))
    for k, stream in stream_batches(spark, source):
        streams.stream_upsert(stream, path, state, 4).trigger(availableNow=True).start().awaitTermination()
        if k == 2:
            before = VersionedTable(spark, path).state()["parts"]
    assert {(r.model_name, r.value) for r in streams.read_upserts(spark, path).collect()} == {("m0", 60.0)} | {(f"m{i}", 50.0 + i) for i in range(1, 20)}
    table = VersionedTable(spark, path)
    after = table.state()["parts"]
    assert len(after) == 4
    assert sum(after[k] != before[k] for k in after) == 1
    assert len(table.versions()) == 2


def test_latest_values_as_keyed_state(spark):
    """A batch gives the keys that it changes and no others; a query that is started again goes on from its checkpoint."""
    source, state = (shared_path(spark, n) for n in ("in", "state"))
    given = []
    for _, stream in stream_batches(spark, source):
        changes = streams.stream_latest(stream)
        changes.writeStream.foreachBatch(lambda b, _: given.append(sorted(r.model_name for r in b.collect()))).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    every = sorted(f"m{i}" for i in range(20))
    assert [g for g in given if g] == [every, every, ["m0"]]
    got = {(r.model_name, r.benchmark, r.value, str(r.updated_at)[:10]) for r in streams.read_latest(spark, state).collect()}
    assert got == {("m0", "b", 60.0, "2024-01-06")} | {(f"m{i}", "b", 50.0 + i, "2024-01-05") for i in range(1, 20)}


def test_newest_file_of_a_pattern(spark):
    assert T.latest_snapshot(spark, f"file://{__file__.rsplit('/', 1)[0]}/test_more_rule*.py").where("value like '%newest_file%'").count() >= 1


def test_health_of_sources(spark):
    stats = spark.createDataFrame([("a", 100.0), ("b", 50.0), ("c", 10.0)], "source string, success_pct double")
    r = M.source_health(stats).first()
    assert (r.passed, round(r.actual, 4), r.message) == (False, round(1 / 3, 4), "Failed sources: b, c")
    assert M.source_health(stats.limit(0)).first().passed


@pytest.mark.parametrize("length", [1, 3, 24])
def test_rolling_volume_of_panes(spark, length):
    """Against plain windows: gaps, models that come again within and after a window, null models; and the state is a row a pane and model."""
    rng = random.Random(length)
    base = 1_700_006_400
    rows = [(rng.choice(["a", "b", "c", None]), base + 1800 * rng.choice([rng.randrange(20), rng.randrange(300), 900])) for _ in range(80)]
    df = spark.createDataFrame(rows, "model_name string, t long").select("model_name", F.timestamp_seconds("t").alias("scraped_at"))
    panes = streams.stream_panes(df)
    assert panes.count() == len({(m, t // 3600) for m, t in rows})
    got = {r.s: (r.e, r.scores, r.models) for r in streams.rolling_volume(panes, length).select(F.unix_seconds("start").alias("s"), F.unix_seconds("end").alias("e"), "scores", "models").collect()}
    want = {}
    for s in range(base - 3600 * length, base + 3600 * 600, 3600):
        own = [m for m, t in rows if s <= t < s + 3600 * length]
        if own:
            want[s] = (s + 3600 * length, len(own), len({m for m in own if m is not None}))
    assert got == want


def test_latest_of_one_time_goes_by_id(spark):
    """A lower id of the same time changes nothing, in a later batch either, and the state is the engine's own aggregate, without a Python call a key."""
    source, state = (shared_path(spark, n) for n in ("in", "state"))
    schema = "score_id long, model_name string, benchmark string, value double, scraped_at timestamp"
    given = []
    for number, value in ((7, None), (3, 3.0), (9, 9.0)):
        spark.createDataFrame([(number, "m", "b", value)], "score_id long, model_name string, benchmark string, value double").withColumn("scraped_at", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        changes = streams.stream_latest(spark.readStream.schema(schema).parquet(source))
        changes.writeStream.foreachBatch(lambda b, _: given.extend(r.value for r in b.collect())).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        if number == 3:
            assert [r.value for r in streams.read_latest(spark, state).collect()] == [None]
    assert given == [None, 9.0]
    assert [r.value for r in streams.read_latest(spark, state).collect()] == [9.0]
    assert "Pandas" not in changes._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize("twice", [False, True])
def test_files_of_a_stream_grow_in_number_not_in_size(spark, monkeypatch, twice):
    """Files of about FILE_ROWS rows, in as many batches as before; with `twice` no batch has an event twice, and two have it."""
    monkeypatch.setattr(plans, "FILE_ROWS", 50)
    given = []
    stream = plans._events_stream(spark, SF, twice=twice)
    own = stream.select("event_id", F.col("_metadata.file_name").alias("file"))
    own.writeStream.foreachBatch(lambda b, _: given.append([tuple(r) for r in b.collect()])).option("checkpointLocation", shared_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    n = P.table(spark, SF, "events").count()
    assert len(given) == 3
    assert max(Counter(f for b in given for _, f in b).values()) <= 2 * plans.FILE_ROWS
    assert set(Counter(e for b in given for e, _ in b).values()) == {1 + twice} and len({e for b in given for e, _ in b}) == n
    assert all(len({e for e, _ in b}) == len(b) for b in given)
