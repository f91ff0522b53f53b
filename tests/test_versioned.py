"""Versioned tables: writes that are killed, repeated or too late, buckets that a write leaves alone, and ingestion broken off anywhere."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scorelake.operators import monitor as M
from scorelake.sources import tables as T
from scorelake.sources.versioned import ConflictError, VersionedTable, retried

SCHEMA = "k string, v int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, tmp_path, keys=("k",), buckets=16):
    return VersionedTable(spark, f"file://{tmp_path}/t", keys, buckets)


def make(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_upserts_and_replacement_against_a_dict(spark, tmp_path):
    rng, t, held = random.Random(1), table(spark, tmp_path), {}
    for step in range(4):
        new = {f"k{rng.randrange(60)}": step * 100 + i for i in range(15)} | ({None: step} if step % 2 else {})
        t.upsert(make(spark, list(new.items())))
        held |= new
        assert rows(t.read()) == sorted(held.items(), key=str)
    gone = [k for k in held if k and k < "k3"]
    t.replace_keys(make(spark, [(gone[0], -1), (gone[0], -2), ("k9 not listed", 5)]), make(spark, [(k, 0) for k in gone]))
    left = [(k, v) for k, v in held.items() if k not in gone]
    assert rows(t.read()) == sorted([*left, (gone[0], -1), (gone[0], -2)], key=str)
    assert VersionedTable(spark, t.path, ["other"], 3).buckets == 16  # as it was made
    t.overwrite(make(spark, []))
    assert rows(t.read()) == []


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.overwrite(make(spark, [("a", 1), ("b", 2)]))

    def broken(now):
        return now.union(make(spark, [("a", 3)])).withColumn("v", F.when(F.col("v") == 3, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="killed"):
        t.change(range(16), broken, SCHEMA)
    t._data(make(spark, [("x", 9)]))  # data of a writer that died before its commit
    assert rows(t.read()) == [("a", 1), ("b", 2)]
    assert t.versions() == [1]
    t.upsert(make(spark, [("a", 4)]))
    t.vacuum(keep=1)
    assert rows(t.read()) == [("a", 4), ("b", 2)]
    assert t.versions() == [2]
    named = {p.split("/")[0] for ps in t.state()["parts"].values() for p in ps}
    assert {p.name for p in Path(f"{tmp_path}/t/data").iterdir() if not p.name.startswith(".")} == named


def test_a_repeated_write_does_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    for _ in range(2):
        t.append(make(spark, [("a", 1)]), "one")
    for _ in range(2):
        t.upsert(make(spark, [("b", 1)]), "two")
        t.overwrite(make(spark, [("c", 1)]), "one")
    assert rows(t.read()) == [("a", 1), ("b", 1)]
    assert len(t.versions()) == 2
    assert rows(t.read_before("two", SCHEMA)) == [("a", 1)]
    assert rows(t.read_before("one", SCHEMA)) == []


def test_a_write_touches_its_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path, buckets=64)
    t.overwrite(spark.range(6400).selectExpr("'k' || id AS k", "cast(id AS int) AS v"))
    before = t.state()["parts"]
    batch = make(spark, [("k1", -1), ("k2", -2)])
    t.upsert(batch)
    after = t.state()["parts"]
    touched = {str(k) for k in t.touched(batch)}
    assert len(touched) <= 2
    assert {k for k in after if after[k] != before[k]} == touched
    assert t.read().agg(F.count("*"), F.sum("v")).first()[:] == (6400, sum(range(6400)) - 1 - 2 - 1 - 2)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    one.overwrite(make(spark, [("a", 1)]))
    tries = []

    def slow():
        def combine(now):
            if not tries:
                one.upsert(make(spark, [("b", 2)]))
            tries.append(1)
            return now.unionByName(make(spark, [("a", 5)]))

        two.change(two.touched(make(spark, [("a", 0)])), combine, SCHEMA)

    with pytest.raises(ConflictError):
        slow()
    assert rows(one.read()) == [("a", 1), ("b", 2)]
    tries.clear()
    tries.append(1)
    retried(slow)
    assert rows(one.read()) == [("a", 1), ("a", 5), ("b", 2)]


def test_replacing_a_partition_by_nothing_empties_it(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "leaderboard string, v int")
    T.replace_partition(df, path)
    T.replace_partition(df.limit(0), path, values=["a", None])
    assert rows(T.read_current(spark, path)) == [("b", 2)]
    T.overwrite(df, f"{tmp_path}/o")
    T.overwrite(T.read_current(spark, f"{tmp_path}/o").where("v > 1"), f"{tmp_path}/o")  # from itself
    assert rows(T.read_current(spark, f"{tmp_path}/o")) == [("b", 2), (None, 3)]


@pytest.mark.parametrize("after", [0, 1, 3, 5])
def test_ingestion_broken_off(spark, tmp_path, monkeypatch, after):
    """Killed after some of the store's tables are written, and run again: as if it had gone through at once."""
    at = F.lit("2024-02-01").cast("timestamp")
    facts = spark.createDataFrame([("GPT-4", "MMLU", 80.0), ("gpt_4", "mmlu", 81.0), ("New", "Code x", None)], "model_name string, benchmark string, value double").withColumns({"leaderboard": F.lit("L"), "scraped_at": at})
    empty = M.Store.empty(spark, facts)
    M.ingest_into(spark, f"{tmp_path}/s", facts.where("benchmark = 'MMLU'"), at, "one", empty)
    done, commit = [], VersionedTable._commit

    def killed(self, *args):
        if len(done) == after:
            raise RuntimeError("killed")
        done.append(1)
        return commit(self, *args)

    monkeypatch.setattr(VersionedTable, "_commit", killed)
    with pytest.raises(RuntimeError, match="killed"):
        M.ingest_into(spark, f"{tmp_path}/s", facts, at, "two", empty)
    monkeypatch.setattr(VersionedTable, "_commit", commit)
    for _ in range(2):
        M.ingest_into(spark, f"{tmp_path}/s", facts, at, "two", empty)
    want = M.ingest(facts, M.ingest(facts.where("benchmark = 'MMLU'"), empty, at), at)
    got = M.open_store(spark, f"{tmp_path}/s", empty)
    for name in M.STORE_KEYS:
        assert rows(getattr(got, name).select(*getattr(want, name).columns)) == rows(getattr(want, name)), name
