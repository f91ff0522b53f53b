"""Score dumps that are large JSON files, read by as many tasks as they have blocks.

A file is cut at every closing brace, wherever Spark's reader splits it. What such a fragment means depends on all before it: whether it begins
inside a string, and how deep in brackets. Both are sums: quotes modulo two, and brackets, once the quotes are known. So each block is summed up
for either state that it could begin in, the blocks' few sums are added up in order, and every fragment learns its state from its block's.
Fragments between the ends of two records make a record, with what stands before it: the keys of its source and category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.sources.shared import delete_table, stored

#: By shape: brackets around a record.
DEPTH = {"array": 1, "sources": 2, "models": 2, "categories": 3}
_STRING = r'"(?:[^"\\]|\\.)*+"'
#: All before a record: up to an opening bracket of a list, or a comma in it, that an opening brace follows.
_HEAD = rf'(?s)^((?:[^"\[,]|[\[,](?!\s*\{{)|{_STRING})*+)[\[,]\s*\{{'
_FILE, _BLOCK = ["path"], ["path", "block"]


def _brackets(text: Column) -> Column:
    """Opening less closing brackets of a text without escapes that begins outside of strings."""
    bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments with sums of their block up to them: quotes, and depth for a block that begins outside (0) and inside (1) of a string."""
    text = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.pmod(F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit(""))), F.lit(2))
    # The brace that the fragment was cut at counts where it isn't in a string.
    outside = _brackets(plain) - F.when(quotes == 0, 1).otherwise(0)
    inside = _brackets(F.regexp_replace(plain, r'^[^"]*("|$)', "")) - F.when(quotes == 1, 1).otherwise(0)
    order = Window.partitionBy(*_BLOCK).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    one = text.select("*", quotes.alias("odd"), outside.alias("outside"), inside.alias("inside")).withColumn("quotes", F.sum("odd").over(order))
    begins = F.pmod(F.col("quotes") - F.col("odd"), F.lit(2))
    depth = lambda state: F.sum(F.when(begins == state, F.col("outside")).otherwise(F.col("inside"))).over(order)
    return one.select(*_BLOCK, "id", "value", "quotes", depth(0).alias("depth0"), depth(1).alias("depth1"))


def _before(blocks: DataFrame, value: Column) -> Column:
    """The sum of value over the blocks before, of one file; blocks are few."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*_FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _carried(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (path, block, record) with each column's last value up to the row, of its file, in the place of nulls."""
    upto = Window.partitionBy(*_BLOCK).orderBy("record")
    earlier = Window.partitionBy(*_FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = df.groupBy(*_BLOCK).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("record"))).alias(c) for c in columns))
    last = last.select(*_BLOCK, *(F.last(c, ignorenulls=True).over(earlier).alias(f"{c}_before") for c in columns))
    own = df.join(last, _BLOCK)
    return own.select(*(F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"{c}_before")).alias(c) if c in columns else F.col(c) for c in df.columns))


def record_texts(spark: SparkSession, path: str, shape: str = "array") -> DataFrame:
    """path, record (its number in the file, from 0), source_key, category_key and json of every record of the JSON files at path, which are of
    a shape that read_score_dump knows; keys that a shape doesn't have are null. A file may hold several dumps one after the other. Elements of
    the lists that are no objects give no row, and neither do empty lists and files. Brackets, quotes and escapes inside strings are text.

    Only a record's own text is ever held whole. A block's fragments are put in order by one task, so its size, spark.sql.files.maxPartitionBytes,
    bounds the tasks, but for compressed files, which are a block each. A file must be JSON: a broken one moves what follows in that file.
    """
    fragments = stored(_fragments(spark, path), "fragments")
    order = Window.partitionBy(*_BLOCK).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    sums = fragments.groupBy(*_BLOCK).agg(*(F.max_by(c, "id").alias(c) for c in ("quotes", "depth0", "depth1")))
    sums = sums.withColumn("state", F.pmod(_before(sums, F.col("quotes")), F.lit(2)))
    sums = sums.select(*_BLOCK, "state", _before(sums, F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))).alias("base"))
    depth = F.col("base") + F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    ends = (F.pmod(F.col("state") + F.col("quotes"), F.lit(2)) == 0) & (depth == DEPTH[shape])
    known = fragments.join(sums, _BLOCK).select(*_BLOCK, "id", "value", ends.cast("int").alias("ends"))
    counts = known.groupBy(*_BLOCK).agg(F.sum("ends").alias("n"))
    counts = counts.select(*_BLOCK, _before(counts, F.col("n")).alias("earlier"))
    numbered = known.join(counts, _BLOCK).withColumn("record", F.col("earlier") + F.coalesce(F.sum("ends").over(order), F.lit(0)))
    parts = numbered.groupBy("path", "record").agg(F.max("block").alias("block"), F.max("ends").alias("ended"), F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("parts"))
    text = F.concat(F.array_join(F.col("parts")["value"], "}"), F.lit("}"))
    whole = parts.where("ended = 1").select("path", "block", "record", text.alias("text")).where(F.col("text").rlike(_HEAD))
    head = F.regexp_extract("text", _HEAD, 1)
    # The last key with a list, and the last with an object, before the record.
    key = lambda after: F.element_at(F.from_json(F.concat(F.lit("["), F.nullif(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(head, F.lit(rf"({_STRING})\s*:{after}"), 1)), -1), F.lit("")), F.lit("]")), "array<string>"), 1)
    last = key(r"\s*(?:\[|$)") if shape != "array" else F.lit(None).cast("string")
    outer = key(r"\s*\{") if shape == "categories" else last
    json = F.regexp_replace("text", _HEAD, "{")
    records = stored(whole.select("path", "block", "record", outer.alias("source_key"), (last if shape == "categories" else F.lit(None).cast("string")).alias("category_key"), json.alias("json")), "records")
    delete_table(fragments)
    return (records if shape == "array" else _carried(records, ["source_key", "category_key"])).drop("block")
