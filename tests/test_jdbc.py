"""A table written to a database and read back in ranges of its key."""

import uuid

from scorelake.sources import tables as T


def test_there_and_back(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    df = spark.range(1000).selectExpr("id", "concat('m', id) AS model", "id / 7.0 AS value")
    T.write_jdbc(df.where("id < 600"), url, "scores", mode="overwrite", parts=3)
    T.write_jdbc(df.where("id >= 600"), url, "scores", parts=2)
    back = T.read_jdbc(spark, url, "scores", "id", 0, 1000, 4)
    assert back.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1], round(float(r[2]), 6)) for r in back.collect()) == sorted((r.id, r.model, round(float(r.value), 6)) for r in df.collect())
