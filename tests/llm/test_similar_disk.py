"""What the near-duplicate stage shuffles, and what keeps texts and sets out of its shuffles."""

import random

import corpus_pipeline
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scorelake.llm.common import sieve, split, written
from scorelake.llm.similar import jaccard, most_jaccard, sketch


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    every = sc.statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_texts_without_near_duplicates_stay_out_of_shuffles(spark):
    rng = random.Random(11)
    texts = [" ".join(f"{rng.randrange(16**8):08x}" for _ in range(2000)) for _ in range(400)]
    texts += [f"{t} tail" for t in texts[:8]]
    df = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    at = "spark.sql.autoBroadcastJoinThreshold"
    own, before = spark.conf.get(at), shuffled(spark)
    spark.conf.set(at, "-1")  # as where the tables are large
    try:
        got = corpus_pipeline.duplicate_stage(spark, df, "").collect()
    finally:
        spark.conf.set(at, own)
    assert {r.doc_id: r.text for r in got} == dict(enumerate(texts[:400]))
    assert shuffled(spark) - before < 0.5 * sum(map(len, texts))


def test_sieve_passes_all_of_its_keys_and_few_others(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 97 > 0, F.col("id")).alias("id"), F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.lit("x").alias("bits"))
    keys = written(rows.where(F.crc32("key") % 9 == 0).select("id", "key"))
    some, others = split(rows, sieve(keys, "id", "key"), rows["id"], rows["key"])
    assert some.columns == others.columns == rows.columns
    assert some.count() + others.count() == rows.count()
    assert others.join(keys, "key").count() == 0
    assert some.count() - keys.count() < 0.05 * rows.count()
    some, others = split(rows, sieve(keys.limit(0), "id", "key"), rows["id"], rows["key"])
    assert (some.count(), others.count()) == (0, 100_000)


def test_sketches_bound_the_similarity():
    rng = np.random.default_rng(5)
    pairs = []
    for n in (0, 1, 3, 8, 9, 60, 500, 4100):
        pool = rng.integers(0, 2**63, 2 * n + 3, dtype=np.uint64)
        pairs += [(np.unique(pool[:n]), np.unique(pool[k : k + m])) for k in {0, n // 9, n // 4, n} for m in {n, n + 2, n // 2}]
    one, other = zip(*pairs, strict=True)
    true = jaccard(pd.Series([x.tobytes() for x in one]), pd.Series([x.tobytes() for x in other]))
    most = most_jaccard(pd.Series(map(len, one)), pd.Series(map(sketch, one)), pd.Series(map(len, other)), pd.Series(map(sketch, other)))
    assert (most >= true).all()
    large = np.array([min(len(x), len(y)) > 50 for x, y in pairs])
    assert (most[large] - true[large]).max() < 0.15
