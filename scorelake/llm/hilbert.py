"""Sharding along a Hilbert curve through quantised metadata.

Every row's dimensions are quantised in their own order, the curve index of the cell is computed, and the table is range-sorted by it. Each
file holds one run of the curve; the manifest has every file's range of each dimension, so that a filter on any of them leaves most files
unread. Shards are runs of equal row counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import drop, ship, written

#: Bytes of texts that a task sorts and a file holds, about.
PART_BYTES = 64 << 20
ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


def curve_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates below 2**bits (Skilling's transform, then the bits interleaved)."""
    x = [np.asarray(c, np.int64).copy() for c in cells]
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | ((c ^ turn) >> b & 1)
    return out


def text_bounds(df: DataFrame, dim: str, n: int) -> list[str]:
    """Up to n - 1 texts that part the dimension's values, as whole strings in byte order, into cells of about as many rows: all values where
    they are fewer than n, else the exact quantiles of all rows. Values are counted, sorted by ranges and numbered by a count a part; the driver
    gets n values at most."""
    counts = written(df.select(F.col(f"`{dim}`").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")), "values")
    values = sorted((r[0] for r in counts.select("value").limit(n).collect()), key=str.encode)
    if len(values) == n:
        parts = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
        sums = parts.groupBy("part").agg(F.sum("n").alias("n"))  # a row a part
        first = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("total"))
        last = F.sum("n").over(W.partitionBy("part").orderBy("value"))
        ranked = parts.withColumn("last", last).join(F.broadcast(first), "part").withColumn("last", F.col("first") + F.col("last"))
        # The k-th bound is the value of the row total * k div n, from 0: that of the last count above it and none before.
        inner = F.exists(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.floor(F.col("total") * k / n).between(F.col("last") - F.col("n"), F.col("last") - 1))
        values = sorted((r[0] for r in ranked.where(inner).select("value").collect()), key=str.encode)
        drop(parts)
    drop(counts)
    return values


def cells(df: DataFrame, dims: Sequence[str], bits: int, text_col: str) -> tuple[list[Column], int]:
    """The quantised value of each dimension, in its own order, and the bytes of all texts. Of texts the cell is the number of text_bounds up to
    the value, of all else the number of quantiles below it; null is cell 0. The driver gets the bounds of a dimension."""
    n = 1 << bits
    kinds = {d: df.schema[d].dataType for d in dims}

    def number(d: str) -> Column:
        c = F.col(f"`{d}`")
        return F.unix_micros(c.cast("timestamp")).cast("double") if isinstance(kinds[d], T.DateType | T.TimestampType) else c.cast("double")

    rest = [d for d in dims if not isinstance(kinds[d], T.StringType)]
    share = [k / n for k in range(1, n)]
    got = df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)), *(F.percentile_approx(number(d), share, 10_000) for d in rest)).first()
    at = {d: sorted({float(x) for x in (q or [])}) for d, q in zip(rest, got[1:], strict=True)} | {d: text_bounds(df, d, n) for d in dims if d not in rest}

    def cell(d: str) -> Column:
        c, text = F.col(f"`{d}`"), d not in rest
        over = (lambda x: c >= x) if text else lambda x: number(d) > x
        bounds = F.array(*(F.lit(x) for x in at[d])).cast("array<string>" if text else "array<double>")
        below = F.aggregate(bounds, F.lit(0), lambda k, x: k + F.when(over(x), 1).otherwise(0))
        # Few cells are spread over the axis, so that the curve's first turns part them as they part those of other dimensions.
        return F.when(c.isNull(), 0).otherwise(F.floor(below * ((n - 1) / max(len(at[d]), 1))).cast("int"))

    return [cell(d) for d in dims], got[0]


def _curve(cell: pd.Series, bits: pd.Series) -> pd.Series:
    if not len(cell):
        return pd.Series([], dtype="int64")
    return pd.Series(curve_index(np.stack(cell.to_numpy()).T, int(bits.iloc[0])))


def write_shards(df: DataFrame, path: str, dims: Sequence[str], id_col: str, text_col: str, bits: int = 5) -> None:
    """Writes df along the curve: `rows`, a file a run, each row of df whole in the column `row` (so no name clashes) with its curve index,
    part and place in it; and `manifest`, a row a file: its part, name, number of rows, and struct of low and high value of each dimension.

    Rows of one cell are ordered by a hash of their text, then by id, so equal texts of like metadata are neighbours and even a cell with a
    third of all rows is dealt over many tasks. Null ids and texts sort first. Texts of any length stay whole in their row. Empty tables give
    no rows. A run holds about PART_BYTES of texts, or more where shuffle.partitions asks for fewer, so what a task sorts doesn't grow.
    """
    spark = df.sparkSession
    ship(spark)
    cell, size = cells(df, dims, bits, text_col)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    put = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.pandas_udf(_curve, T.LongType())(F.array(*cell), F.lit(bits)).alias("curve"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"))
    order = ["curve", "tie", f"row.`{id_col}`"]
    number = F.monotonically_increasing_id()
    rows = put.repartitionByRange(n, *order).sortWithinPartitions(*order).select("row", "curve", F.shiftright(number, ROW_BITS).cast("int").alias("part"), number.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("place"))
    rows.write.parquet(f"{path}/rows")
    ranges = (F.struct(F.min(f"row.`{d}`").alias("low"), F.max(f"row.`{d}`").alias("high"), F.count_if(F.col(f"row.`{d}`").isNull()).alias("nulls")).alias(d) for d in dims)
    back = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    files = back.groupBy("part", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), *ranges)
    files.select("part", "file", "n", F.struct(*(F.col(f"`{d}`") for d in dims)).alias("ranges")).coalesce(1).write.parquet(f"{path}/manifest")


def files_within(spark: SparkSession, path: str, within: Mapping[str, tuple[object, object]]) -> DataFrame:
    """The manifest's rows of files that may hold rows with each named dimension from a low to a high value, both included."""
    out = spark.read.parquet(f"{path}/manifest")
    for d, (low, high) in within.items():
        out = out.where((F.col(f"ranges.`{d}`.low") <= F.lit(high)) & (F.col(f"ranges.`{d}`.high") >= F.lit(low)))
    return out


def read_within(spark: SparkSession, path: str, within: Mapping[str, tuple[object, object]]) -> DataFrame:
    """row and curve of the rows with each named dimension in its range; only files that may hold some are opened. The driver gets their
    names: one for each task of the writing job at most."""
    schema = spark.read.parquet(f"{path}/rows").schema
    names = [f"{path}/rows/{r.file}" for r in files_within(spark, path, within).select("file").collect()]
    out = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    for d, (low, high) in within.items():
        out = out.where(F.col(f"row.`{d}`").between(F.lit(low), F.lit(high)))
    return out.select("row", "curve")


def read_shards(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """row, curve, shard (0 to shards - 1, counts at most one apart) and slot (gapless from 0 in each shard, along the curve)."""
    # The manifest has a row a part, so a row a task of the writing job.
    manifest = spark.read.parquet(f"{path}/manifest").groupBy("part").agg(F.sum("n").alias("n"))
    first = manifest.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"), F.sum("n").over(W.partitionBy(F.lit(0))).alias("total"))
    ranked = spark.read.parquet(f"{path}/rows").join(first, "part").withColumn("rank", F.col("first") + F.col("place"))
    shard = F.expr(f"rank * {shards} div total")
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select("row", "curve", F.col("shard").cast("int").alias("shard"), (F.col("rank") - start).alias("slot"))
