"""The continuous forms: normalise on arrival, unique facts, rolling volume, upserts and battle counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from scorelake.operators.boards import upsert_latest, win_rates
from scorelake.operators.normalize import normalize_scores
from scorelake.sources.versioned import BUCKETS, VersionedTable


def stream_normalize(facts: DataFrame, boards: DataFrame) -> DataFrame:
    """Facts of known leaderboards (leaderboard, category) normalised as they arrive; others are dropped. A stream-static join."""
    return normalize_scores(facts.join(boards, "leaderboard"))


def stream_dedup(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """One fact a model, leaderboard, benchmark and time, among those within the delay."""
    return stream.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["model_name", "leaderboard", "benchmark", "scraped_at"])


def stream_panes(stream: DataFrame, slide: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Scores of every pane (a slide's length of time) and model: start, model_name, scores. Each row is counted once, and the state is a number a
    pane and model. For update or complete output mode; the watermark lets the state of past panes go."""
    g = stream.withWatermark("scraped_at", delay).groupBy(F.window("scraped_at", slide), "model_name").agg(F.count("*").alias("scores"))
    return g.select("window.start", "model_name", "scores")


def rolling_volume(panes: DataFrame, length: int = 24, slide: str = "1 hour") -> DataFrame:
    """start, end, scores and models (distinct, null is none) of every window of `length` panes that holds a row, from stream_panes's rows.

    A pane adds its scores to the window that begins `length` - 1 panes before it and takes them away after the one that it begins; a model is
    added where the window before doesn't hold it already, so a pane and model gives two changes, however long windows are. Changes are summed
    up by start; what goes through one task is a row a start at which something changes, and windows in between are filled in.
    """
    step = f"INTERVAL {slide}"
    at, before = F.unix_seconds("start"), F.lag("start").over(W.partitionBy("model_name").orderBy("start"))
    seconds = F.lit(pd.Timedelta(slide).total_seconds()).cast("long")
    first = at - seconds * (length - 1)
    own = panes.groupBy("start", "model_name").agg(F.sum("scores").alias("scores"))
    own = own.withColumn("_new", F.coalesce(F.greatest(first, F.unix_seconds(before) + seconds), first))
    change = lambda t, scores, models: F.struct(t.alias("at"), scores.alias("scores"), models.alias("models"))
    none, one = F.lit(0).cast("long"), F.col("model_name").isNotNull().cast("long")
    each = F.array(change(first, F.col("scores"), none), change(at + seconds, -F.col("scores"), none), change(F.col("_new"), none, one), change(at + seconds, none, -one))
    sums = own.select(F.inline(each)).groupBy("at").agg(F.sum("scores").alias("s"), F.sum("models").alias("m"))
    w = W.orderBy("at")  # a row a start
    held = sums.select("at", F.lead("at").over(w).alias("next"), F.sum("s").over(w).alias("scores"), F.sum("m").over(w).alias("models")).where("scores > 0")
    each = held.select(F.explode(F.sequence("at", F.col("next") - seconds, seconds)).alias("at"), "scores", "models")
    return each.select(F.timestamp_seconds("at").alias("start"), "scores", "models").select("start", (F.col("start") + F.expr(step) * length).alias("end"), "scores", "models")


def stream_win_rates(stream: DataFrame, min_battles: int = 50) -> DataFrame:
    """Win rates so far; for complete output mode."""
    return win_rates(stream, min_battles)


UPSERTED = "model_name string, benchmark string, value double, updated_at timestamp"


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Keeps the latest value of every model and benchmark, in whatever order batches come, in a versioned table. A batch copies the buckets that
    its keys fall in, and its number is the write's token, so one that is run again takes effect once. For few, large batches; stream_latest
    is for many small ones."""

    def merge(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path, ["model_name", "benchmark"], buckets)
        batch = batch.persist()
        table.merge(batch, lambda now, new: upsert_latest(now, new, newest=True).drop("is_new"), UPSERTED, f"batch-{number}")
        batch.unpersist()
        table.vacuum()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The latest values that stream_upsert has written."""
    return VersionedTable(spark, path, ["model_name", "benchmark"]).read(schema=UPSERTED)


def stream_latest(stream: DataFrame) -> DataFrame:
    """model_name, benchmark, value and updated_at of the keys whose latest value a batch sets: for update output mode. What is latest is an
    aggregate in the state store, a value a key, so a batch costs its own keys, and a restart goes on from the checkpoint. Of values of one time
    that of the greatest score_id counts. Rows need a time. read_latest reads all of the state."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # The time of the batch stands for all of its rows: a key whose latest value has it is one that the batch has set.
    rows = stream.where("scraped_at is not null").withColumn("_batch", F.current_timestamp())
    latest = rows.groupBy("model_name", "benchmark").agg(F.max(F.struct("scraped_at", "score_id", "value", "_batch")).alias("m"))
    return latest.where(F.col("m._batch") == F.current_timestamp()).select("model_name", "benchmark", "m.value", F.col("m.scraped_at").alias("updated_at"))


def read_latest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The latest value of every key of a stream_latest query, from its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.model_name", "key.benchmark", "value.max.value", F.col("value.max.scraped_at").alias("updated_at"))
