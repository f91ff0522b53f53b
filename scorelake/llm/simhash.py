"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints differ in `radius` bits or fewer just if the balls of half the radius around them meet. So each distinct fingerprint emits
every variant within half the radius, the variants are shuffled, and those of one variant are neighbours. As fingerprints are distinct, a
variant has at most as many as a ball has points (65 for radius 2), however large the groups of copies are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import drop, ship, slices, utf8, written

BITS, SEED = 64, 42
STEP = 1 << 16  # shingles counted at a time


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of the runs of `words` lower-case words, joined by spaces; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return np.zeros(0, "<u8")
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes. None: 0."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), STEP):
        total += np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp, a signed 64-bit fingerprint, of every row."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words) for t in utf8(b.column(1))], pa.int64())], names=["id", "fp"])

    return own.mapInArrow(run, T.StructType([own.schema["id"], T.StructField("fp", T.LongType())]))


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: of all distinct fingerprints in `fp` that share a variant, each and the next larger. They join all that lie within `radius`."""
    if radius % 2:
        raise ValueError("radius must be even: the balls of half of it must hold just the pairs in reach")
    masks = [sum(1 << i for i in bits) for k in range(radius // 2 + 1) for bits in combinations(range(BITS), k)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    variants = distinct.select("fp", F.explode(F.array(*map(F.lit, signed)).cast("array<long>")).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    pairs = variants.select(F.lag("fp").over(W.partitionBy("variant").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    return pairs.where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: for every end of a link (a, b) the smallest node that it reaches, by alternating large and small stars.

    Each round is written to the shared folder, where the one before it is deleted; the driver gets a count and a sum of hashes. A hub's rows
    are joined, not gathered, so Spark can split them.
    """

    def starred(edges: DataFrame, key: str, other: str) -> tuple[DataFrame, DataFrame]:
        least = written(edges.groupBy(key).agg(F.min(other).alias("m")), "least")
        return edges.join(least, key), least

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, one = starred(both, "u", "v")
        large = written(joined.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "edges")
        small, two = starred(large, "u", "v")
        new = written(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct(), "edges")
        drop(edges, one, large, two)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    out = written(nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    drop(edges)
    return out


def classes_of(groups: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """key, root and component_id, the least `first` of its component, of groups (key, first), as a table."""
    rooted = written(groups.join(roots.withColumnRenamed("node", key), key, "left").select(key, "first", F.coalesce("root", key).alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    out = written(rooted.join(least, "root").select(key, "root", "component_id"), "classes")
    drop(rooted)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp and component_id (the smallest id reachable over links, itself included) of every row.

    Without `similarity`, fingerprints within `radius` bits are linked. With it, texts are whose sets of shingles have a Jaccard similarity of
    that or more: pairs within the radius are candidates, and so are pairs that share a band of MinHash minima, since at a similarity of 0.8
    some 10 of 64 bits differ, which no ball reaches; the texts decide (see similar.py).

    Null and empty texts have the fingerprint 0 and are linked like any other. Texts of any length are hashed whole. Rows of one id are each
    returned. Null ids count as larger than all others. An empty table gives an empty result. Other columns aren't read, so their names can't
    clash. A fingerprint, or text, with a third of all rows is a large partition of the last join, which Spark's adaptive execution splits
    (spark.sql.adaptive.skewJoin); all that comes before works on distinct ones.
    """
    if similarity is not None:
        from scorelake.llm.similar import similar_documents

        return similar_documents(docs, words, radius, similarity, id_col, text_col)
    prints = written(fingerprints(docs, words, id_col, text_col), "prints")
    groups = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "groups")
    roots = components(ball_links(groups.select("fp"), radius))
    classes = classes_of(groups, roots, "fp")
    drop(groups, roots)
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicated(docs: DataFrame, words: int = 5, radius: int = 2, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group that near_duplicates links; see one_of_each."""
    from scorelake.llm.similar import one_of_each

    return one_of_each(docs, words, radius, similarity, id_col, text_col)
