"""Near-duplicates by the Jaccard similarity of word shingles: SimHash balls and MinHash bands find the candidates, the shingles decide.

SimHash of 64 bits can't reach a similarity of 0.8 by itself: there about 10 bits differ, and a ball of 5 bits has 8 million points. Two texts
of that similarity share one of the 24 bands of 4 minima with probability 1 - (1 - 0.8 ** 4) ** 24 > 0.99999; every link is verified exactly.

A bucket is first linked in proportion to its members: each with the least one and with its next neighbours in an order. Only in buckets whose
members are then still of several components are those of different components compared, block by block: a task holds two blocks of
bounded size, marks one text's shingles at a time and counts them in all texts of the other block, and returns the links that join components,
fewer than there are texts. So no pairs are emitted however large a group of similar texts is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import drop, kept, ship, sieve, slices, split, utf8, written
from scorelake.llm.simhash import ball_links, classes_of, components, majority, shingle_hashes

BANDS, WIDTH = 24, 4
STEP = 1 << 14  # shingles hashed at a time
#: Neighbours in a bucket's order that each member is compared with at once; so all pairs of a bucket of one more.
NEIGHBOURS = 5
#: Members of a bucket that are sorted together.
TOGETHER = 10_000
#: Shingles of a block of texts, about.
BLOCK_SHINGLES = 1 << 19
_MIX = np.random.default_rng(7).integers(1, 2**63, (2, BANDS * WIDTH, 1), dtype=np.uint64) | np.uint64(1)
LINKS = "a binary, b binary"


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band of minima."""
    least = np.full(BANDS * WIDTH, ~np.uint64(0))
    for i in range(0, len(hashes), STEP):
        x = (hashes[i : i + STEP] ^ _MIX[0]) * _MIX[1]
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=1))
    by = least.reshape(BANDS, WIDTH)
    out = np.zeros(BANDS, np.uint64)
    for i in range(WIDTH):
        out = (out ^ by[:, i]) * _MIX[1, i, 0]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, key (a digest of the text), fp and sig, the hashes of its bands, of every row."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("shingles", lambda: None)  # other operators' tables go
        for b in slices(batches, 2):
            hashes = [shingle_hashes(t, words) for t in utf8(b.column(2))]
            fp = pa.array([majority(h) for h in hashes], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, pa.array([bands(h) for h in hashes], pa.list_(pa.int64()))], names=["id", "key", "fp", "sig"])

    return own.mapInArrow(run, T.StructType([own.schema["id"], own.schema["key"], T.StructField("fp", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))]))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """key, set (of its shingles' hashes, in order, as 64-bit integers), its size and its sketch (see sketch) of every wanted key, as a table.
    wanted: key, first, the id of the row that the text is taken from. A sieve of these keeps nearly all other rows' texts out of the shuffle,
    and copies that pass it are combined before."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    by = sieve(wanted, "first", "key")
    rows, _ = split(rows, by, rows["id"], rows["key"])
    own = rows.groupBy("key").agg(F.first("text").alias("text")).join(wanted.select("key"), "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            sets = [np.unique(shingle_hashes(t, words)) for t in utf8(b.column(1))]
            columns = [b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(sketch, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "set", "size", "sketch"])

    out = written(own.mapInArrow(run, "key binary, set binary, size long, sketch binary"), "sets")
    drop(by)
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """A bitmap of 8 to 16 bits a hash, a power of two of them and 64 at least, in which hash h sets bit h modulo their number."""
    bits = np.zeros(max(64, 1 << (8 * len(hashes) - 1).bit_length()), bool)
    bits[(hashes % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_jaccard(m: pd.Series, one: pd.Series, n: pd.Series, other: pd.Series) -> pd.Series:
    """A bound that the similarity of sets of m and n hashes with these sketches doesn't pass: each bit that only one sketch has set, the
    larger one folded to the smaller one's bits, is of a hash at least that only that set has."""
    out = []
    for a, x, b, y in zip(m, one, n, other, strict=True):
        p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        least = min(len(p), len(q))
        p, q = (np.bitwise_or.reduce(t.reshape(-1, least), axis=0) for t in (p, q))
        both = max(0, min(a - int(np.bitwise_count(p & ~q).sum()), b - int(np.bitwise_count(q & ~p).sum())))
        out.append(both / (a + b - both) if a + b else 1.0)
    return pd.Series(out, dtype="float64")


def jaccard(one: pd.Series, other: pd.Series) -> pd.Series:
    """The similarity of each pair of sets; two empty ones are equal."""
    out = []
    for a, b in zip(one, other, strict=True):
        x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
    return pd.Series(out, dtype="float64")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs of keys whose sets are similar, as a table. Sketches, of an eighth to a quarter of a set's size, tell nearly all others;
    only the sets of the pairs that are left are joined."""
    of = lambda c, x, n: sets.select(F.col("key").alias(c), F.col("sketch").alias(x), F.col("size").alias(n))
    likely = pairs.join(of("a", "x", "m"), "a").join(of("b", "y", "n"), "b").where(F.pandas_udf(most_jaccard, T.DoubleType())("m", "x", "n", "y") >= threshold - 1e-9)
    pairs = written(likely.select("a", "b"), "likely")
    by = sieve(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key")
    sets, _ = split(sets, by, sets["key"])
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    out = written(both.where(F.pandas_udf(jaccard, T.DoubleType())("x", "y") >= threshold).select("a", "b"), "links")
    drop(pairs, by)
    return out


def new_links(left: list[np.ndarray], right: list[np.ndarray], roots: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Pairs (place in left, place in right) of similar sets, as many as join the components that roots, of left and then right, name."""
    parent = {r: r for r in roots}

    def find(r: bytes) -> bytes:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    sizes = np.array([len(r) for r in right], np.int64)
    flat = np.concatenate(right) if right else np.zeros(0, "<u8")
    ids, number = np.unique(flat, return_inverse=True)
    starts, full = np.cumsum(sizes) - sizes, sizes > 0
    out = []
    for i, x in enumerate(left):
        at = np.searchsorted(ids, x)
        held = at < len(ids)
        at, x_held = at[held], x[held]
        mark = np.zeros(len(ids), bool)
        mark[at[ids[at] == x_held]] = True
        common = np.zeros(len(right), np.int64)
        if full.any():
            common[full] = np.add.reduceat(mark[number], starts[full], dtype=np.int64)
        like = common >= threshold * (len(x) + sizes - common) - 1e-9
        for j in np.flatnonzero(like).tolist():
            a, b = find(roots[i]), find(roots[len(left) + j])
            if a != b:
                parent[a] = b
                out.append((i, j))
    return out


def across(mixed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between members of different components of the same bucket. mixed: bucket, key, root, main (whether root is the bucket's
    component of most members). Of two members one at least isn't of the main component; those are what the others are compared with."""
    mixed = written(mixed, "mixed")
    by = sieve(mixed.select("key").distinct(), "key")
    own = written(mixed.join(split(sets, by, sets["key"])[0].select("key", "set", "size"), "key"), "members")
    size = own.groupBy("bucket").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = own.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.greatest(F.col("blocks"), F.lit(1))).cast("int"))
    every = F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1)
    columns = ["bucket", "key", "root", "set"]
    left = placed.where(~F.col("main")).select(*columns, F.col("block").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("left"))
    right = placed.select(*columns, F.explode(every).alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[rows["left"]], rows[~rows["left"]]
        hold = lambda t: [np.frombuffer(s, "<u8") for s in t["set"]]
        found = new_links(hold(x), hold(y), [bytes(r) for r in [*x["root"], *y["root"]]], threshold)
        a, b = x["key"].tolist(), y["key"].tolist()
        return pd.DataFrame([(a[i], b[j]) for i, j in found], columns=["a", "b"])

    out = written(left.union(right).groupBy("bucket", "i", "j").applyInPandas(compare, LINKS).distinct(), "links")
    drop(mixed, by, own)
    return out


def similar_documents(docs: DataFrame, words: int = 5, radius: int = 2, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp and component_id (the smallest id reachable over links, itself included) of every row; see near_duplicates.

    Texts whose sets of shingles have a Jaccard similarity of `threshold` or more are linked. Equal texts are one; null counts as empty; texts
    without a word are equal to one another.
    """
    prints, classes = similar_classes(docs, words, radius, threshold, id_col, text_col)
    return prints.select("id", "key", "fp").join(classes, "key").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, radius: int = 2, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest id, of rows of one id that of the least digest of the text, and of
    rows of one id and text any one. Null ids are larger than all others. An id may have several texts, and a text several ids."""
    prints, classes = similar_classes(docs, words, radius, threshold, id_col, text_col)
    # A text's rows of its smallest id are counted by id first, so a group of copies is small before it meets.
    each = prints.groupBy("key", "id").agg(F.count("*").alias("n"))
    texts = each.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("least"))
    stays = classes.join(texts, "key").groupBy("root").agg(F.min(F.struct("least.none", "least.id", "key", "least.n")).alias("stays"))
    stays = written(stays, "stays")
    rest = classes.join(stays, "root").select("key", F.col("stays.id").alias("stay_id"), F.col("stays.key").alias("stay_key"))
    other = (F.col("key") != F.col("stay_key")) | ~F.col("id").eqNullSafe(F.col("stay_id"))
    goes = written(prints.select("id", "key").join(rest, "key").where(other).select("id", "key").distinct(), "goes")
    again = written(stays.where("stays.n > 1").select("stays.id", "stays.key"), "again")
    key = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit(""))))
    at = lambda t: docs[id_col].eqNullSafe(t["id"]) & (key == t["key"])
    # Only rows that may go or come again are shuffled with their texts.
    by = sieve(goes.union(again), "id", "key")
    some, others = split(docs, by, docs[id_col], key)
    out = some.join(goes, at(goes), "left_anti")
    if not again.isEmpty():
        repeated = some.join(again, at(again), "left_semi").dropDuplicates([id_col, text_col])
        # A null and an empty text are one text.
        repeated = repeated.where(F.col(text_col) != "").unionByName(repeated.where(F.coalesce(F.col(text_col), F.lit("")) == "").dropDuplicates([id_col]))
        out = out.join(again, at(again), "left_anti").unionByName(repeated)
    drop(prints, classes, stays)
    return out.unionByName(others)


def similar_classes(docs: DataFrame, words: int, radius: int, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, key (a digest of the text) and fp of every row; and key, root (the least key of its component) and component_id (the smallest id of
    its component) of every distinct text. Both are tables."""
    prints = written(signatures(docs, words, id_col, text_col), "prints")
    groups = written(prints.groupBy("key").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("sig").alias("sig")), "groups")
    ordered = lambda df: df.where(F.col("a").isNotNull() & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # The ball's links, between the least text of each fingerprint, and of each fingerprint's texts with the least.
    by_print = written(groups.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "prints")
    ball = ball_links(by_print.select("fp"), radius)
    least = by_print.select("fp", "least")
    near = ball.join(least.withColumnsRenamed({"fp": "a", "least": "ka"}), "a").join(least.withColumnsRenamed({"fp": "b", "least": "kb"}), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    near = near.union(groups.join(by_print.where("n > 1"), "fp").select(F.col("least").alias("a"), F.col("key").alias("b")))

    members = groups.select("key", F.posexplode("sig").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "key").repartition("bucket")  # once, for both
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1")
    shared = written(members.join(sizes, "bucket"), "members")
    side = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / TOGETHER))
    w = W.partitionBy("bucket", side).orderBy("key")
    beside = shared.select("key", "least", *(F.lag("key", k).over(w).alias(f"k{k}") for k in range(1, NEIGHBOURS + 1)))
    beside = beside.select(F.col("key").alias("b"), F.explode(F.array("least", *(f"k{k}" for k in range(1, NEIGHBOURS + 1)))).alias("a"))
    tried = written(ordered(near.union(beside.select("a", "b"))), "pairs")
    wanted = groups.select("key", "first").join(tried.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi")
    wanted = written(wanted, "wanted")
    sets = shingle_sets(docs, wanted, words, id_col, text_col)
    links = verified(tried, sets, threshold)
    roots = components(links)

    at = shared.where(F.col("n") > NEIGHBOURS + 1).join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    counted = written(at.groupBy("bucket", "root").agg(F.count("*").alias("n")), "counts")
    main = counted.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("n")).where("n > 1").select("bucket", "main")
    mixed = at.join(main, "bucket").select("bucket", "key", "root", (F.col("root") == F.col("main")).alias("main"))
    more = across(mixed, sets, threshold)
    if not more.isEmpty():
        drop(roots)
        roots = components(links.union(more))
    classes = classes_of(groups, roots, "key")
    drop(groups, by_print, shared, tried, wanted, sets, links, roots, counted, more)
    return prints, classes
