"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every benchmark item. A document's words are streamed through it; the longest run that ends at
each word tells which windows of an item end there, and their words are hit.

A benchmark of more than one block of words is matched in one pass over the documents a block, each a job of its own, so a task, the driver
and a plan never hold more than one block. What the passes find is kept by the text's digest and joined to the rows at the end.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.automaton import Automaton
from scorelake.llm.common import drop, kept, ship, slices, utf8, written

WINDOW = 10
#: Words of one automaton, about: it takes some 50 bytes a word, and four times as much while it is made. Larger benchmarks are matched in
#: blocks.
BLOCK_WORDS = 1_000_000
#: Words of a piece of an item: what goes to one block whole. Pieces of an item overlap by all but one word of a window.
PIECE_WORDS = 10_000
#: A-Z lower-cased; all but letters, digits and bytes of other characters become a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: The same words, for Spark and for re.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS, ITEMS = "array<struct<first:int,end:int>>", "array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_words: int, shortest: int) -> tuple[DataFrame, int, DataFrame]:
    """(block, item, words) of every item's pieces, the number of blocks, none of which has much more than block_words words, and the table that
    the pieces are read from. The driver gets one number a try."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0).alias("all"))
    split = split.where(F.size("all") >= max(1, min(window, shortest)))
    step = max(1, min(PIECE_WORDS, block_words) - (window - 1))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - window), F.lit(step))
    pieces = written(split.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at") + 1, step + window - 1).alias("words")), "items")
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    while True:
        own = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int"))
        most = own.groupBy("block").agg(F.sum(F.size("words")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if most <= 2 * block_words + PIECE_WORDS or blocks > total:
            return own, blocks, pieces
        blocks *= 2


def _matched(rows: DataFrame, block: Broadcast, window: int, text: str) -> DataFrame:
    """rows with n_words, spans and items, by one block."""
    at, key = rows.columns.index(text), uuid.uuid4().hex
    schema = T.StructType([*rows.schema, T.StructField("n_words", T.LongType()), T.StructField("spans", T.DataType.fromDDL(SPANS)), T.StructField("items", T.DataType.fromDDL(ITEMS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept(("block", key, window), lambda: Automaton(block.value, window, words_of))
        for b in slices(batches, at):
            sizes, (span_at, first, end), (item_at, found) = automaton.match(utf8(b.column(at)))
            pairs = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["first", "end"])
            spans = pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pairs)
            items = pa.ListArray.from_arrays(pa.array(item_at, pa.int32()), pa.array(found, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64()), spans, items], names=[*b.schema.names, "n_words", "spans", "items"])

    return rows.mapInArrow(run, schema)


def _block(spark, pieces: DataFrame, k: int) -> Broadcast:  # noqa: ANN001
    """One block's pieces, for the workers: of bounded size, see item_blocks."""
    own = pieces.where(F.col("block") == k).select("item", F.array_join("words", " ").cast("binary").alias("text"))
    return spark.sparkContext.broadcast(sorted((r["item"], bytes(r["text"])) for r in own.collect()))


def with_matches(rows: DataFrame, items: DataFrame, text: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, shortest: int = 1) -> DataFrame:
    """Every row of rows, with its columns, and n_words, spans (array of first and end: hit ranges of words, joined where they touch) and items
    (ids of items with occurring windows, as strings in order). rows mustn't have columns of these names.

    A window is `window` consecutive words of an item; an item of fewer words, but not of fewer than `shortest`, is one window. Words: A-Z
    lower-cased runs of letters, digits and non-ASCII characters. Null and empty texts have none. Texts of any length are matched whole; equal
    texts have equal matches. Items of one id count once, null ids as the text `null`; items of no words can't occur.
    """
    spark = rows.sparkSession
    ship(spark)
    pieces, blocks, pieces_table = item_blocks(items, item_col, item_text_col, window, block_words, shortest)
    if blocks == 1:
        block = _block(spark, pieces, 0)
        drop(pieces_table)
        return _matched(rows, block, window, text)
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    found = []
    for k in range(blocks):
        block = _block(spark, pieces, k)
        one = _matched(rows.select(digest.alias("digest"), F.col(text).alias("text")), block, window, "text").where(F.size("spans") > 0)
        found.append(written(one.groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits"))
        block.destroy()
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    # A row a block at most for each digest; ranges that touch become one, in order.
    joined = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))), F.array().cast(SPANS),
        lambda out, s: F.when((F.size(out) > 0) & (s["first"] <= F.element_at(out, -1)["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))),
    )
    merged = written(every.groupBy("digest").agg(joined.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "hits")
    drop(pieces_table, *found)
    both = rows.withColumn("digest_of_text", digest).join(merged.withColumnRenamed("digest", "digest_of_text"), "digest_of_text", "left")
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), n_words.alias("n_words"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast(ITEMS)).alias("items"))


def match_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """id_col, n_words, spans and items of every row of docs, as with_matches gives them. Rows of one id are each matched. Other columns
    aren't read, so their names can't clash. An empty table gives an empty result."""
    out = with_matches(docs.select(F.col(f"`{id_col}`").alias("own_id"), F.col(f"`{text_col}`").alias("own_text")), items, "own_text", **how)
    return out.select(F.col("own_id").alias(id_col), "n_words", "spans", "items")


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def remove_spans(text: str, spans: list[tuple[int, int]], least: int = 1) -> str:
    """text without the characters from the first to the last word of each span of `least` words or more."""
    out, done, word = [], 0, -1
    cuts = iter(sorted(s for s in spans if s[1] - s[0] >= least))
    cut = next(cuts, None)
    for m in re.finditer(WORD_PATTERN, text):
        word += 1
        if cut is None:
            break
        if word == cut[0]:
            out.append(text[done : m.start()])
        if word == cut[1] - 1:
            done, cut = m.end(), next(cuts, None)
    return "".join([*out, text[done:]])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", least: int = 1, max_coverage: float = 0.2, **how: object) -> DataFrame:
    """docs without hit spans of `least` words or more; a row goes whole if more than max_coverage of its words are hit. Hits are those of
    with_matches, so items of fewer words than a window count too where they occur whole (`shortest` leaves out short ones).

    Every row is judged by its own text, whatever its id: rows of one id, of null ids and repeated rows too. Null texts, and those without a
    word, stay. All columns stay as they are but for the text; they go through as one column, so no name clashes.
    """
    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    row = docs.select(F.struct(F.lit(True).alias("row"), *(F.col(f"`{c}`").alias(k) for c, k in others.items())).alias("own_row"), F.col(f"`{text_col}`").alias("own_text"))
    back = lambda text: [text.alias(c) if c == text_col else F.col(f"own_row.{others[c]}").alias(c) for c in docs.columns]
    found = with_matches(row, items, "own_text", **how)
    kept = found.where((F.size("spans") == 0) | (n_hit(F.col("spans")) <= F.lit(max_coverage) * F.col("n_words")))
    if max_coverage <= 0:
        return kept.select(*back(F.col("own_text")))

    def cut_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([remove_spans(t, [(x["first"], x["end"]) for x in s], least) if s else t for t, s in pairs], pa.string())

    cut_text.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    return kept.select(*back(F.arrow_udf(cut_text, "string")(F.col("own_text"), F.col("spans"))))
