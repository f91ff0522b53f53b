"""Tables in the folder that a cluster shares: what must be computed once, and outlive the executor that did."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that results are, or may still be, read from.
_MADE: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where it isn't set, a session on one machine gets a folder of that machine; on
    a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table, read again: the same rows however often, and whoever, reads it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def delete_table(*tables: DataFrame) -> None:
    """Deletes tables that `stored` has returned, when nothing is read from them any more."""
    for t in tables:
        delete(t.sparkSession, t._table_path)
        if t._table_path in _MADE:
            _MADE.remove(t._table_path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Deletes all that is left, when the results that are read from it have been used."""
    while _MADE:
        delete(spark, _MADE.pop())


#: Bytes of an Arrow batch that Python workers get; a row more at most.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches of texts that Python workers get by bytes, for the session; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = str(spark.conf.get(key))
    if not own.rstrip("bB").isdigit() or not 0 < int(own.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
