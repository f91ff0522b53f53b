"""Token ids in files: canonical length-limited Huffman codes from global counts, in independent blocks with bit-offset checkpoints.

On disk: a Parquet table `codebook` (one row: the code length of every id) and a Parquet table `blocks`, a row each: part and block number
(ascending doc ids run through them), ids before the block in its part, doc ids, ids per document, bit offset of every CHECKPOINT-th id, and
the bits. A block holds whole documents, about BLOCK ids and one document at least, and is decoded by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import drop, ship, slices, utf8, written
from scorelake.llm.word_bpe import word_bpe

BLOCK, CHECKPOINT, LIMIT = 1 << 18, 512, 16
#: Ids that a task sorts and writes, about.
PART_IDS = 1 << 24


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    own = counts[order].astype(np.float64)
    level, leaves = own, []
    for k in range(limit):
        if k:
            pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([own, pairs])
            rank = np.argsort(both, kind="stable")
            level = both[rank]
            leaves.append(rank < n)
        else:
            leaves.append(np.ones(n, bool))
    take = 2 * n - 2
    for leaf in reversed(leaves):
        own_n = int(leaf[:take].sum())
        out[order[:own_n]] += 1
        take = 2 * (take - own_n)
    return out


class Book:
    """Codes and decoding table of a canonical code: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        ids = np.flatnonzero(self.lengths)
        order = ids[np.lexsort((ids, self.lengths[ids]))]
        size = self.lengths[order].astype(np.int64)
        self.width = int(size.max(initial=1))
        room = np.left_shift(1, self.width - size)
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (np.cumsum(room) - room) >> (self.width - size)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.step = np.ones(1 << self.width, np.uint8)
        total = int(room.sum())
        self.symbol[:total], self.step[:total] = np.repeat(order, room), np.repeat(size, room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits, and the bit offset of every CHECKPOINT-th id."""
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        at = end - size
        words = np.zeros(int(end[-1] if len(end) else 0) // 64 + 2, np.uint64)
        word, room = at >> 6, 64 - (at & 63) - size
        code = self.codes[ids]
        if len(ids):
            fit = room >= 0
            left = np.where(fit, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.bitwise_or.reduceat(left, first)
            over = np.flatnonzero(~fit)
            words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes(), at[::CHECKPOINT].astype(np.uint64)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """n ids: all runs between checkpoints side by side, a table look-up a step."""
        raw = bits + bytes(8)
        window = np.ndarray(len(raw) - 3, ">u4", raw, 0, (1,))
        at = checkpoints.astype(np.int64)
        out = np.zeros((min(CHECKPOINT, n), len(at)), np.uint32)
        end = len(bits) * 8
        for row in out:
            np.minimum(at, end, out=at)  # a last run that is shorter reads on; its rest is cut off below
            see = (window[at >> 3].astype(np.int64) >> (32 - self.width - (at & 7))) & ((1 << self.width) - 1)
            row[:] = self.symbol[see]
            at += self.step[see]
        return out.T.reshape(-1)[:n]


def encode_ids(docs: DataFrame, model: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens and the ids of every whole text (null: empty), zstd-compressed unsigned 16- or 32-bit integers."""
    ship(docs.sparkSession)
    own = docs.select(id_col, text_col)
    schema = T.StructType([own.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bpe = word_bpe(model)
        kind = id_type(bpe.size)
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        tail = np.array([] if end_id is None else [end_id], kind)
        for b in slices(batches, 1):
            ids = [np.concatenate([x.astype(kind), tail]) for x in bpe.encode(utf8(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack(x.tobytes()) for x in ids], pa.binary())], names=[id_col, "n_tokens", "packed"])

    return own.mapInArrow(run, schema)


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def id_counts(packed: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs. The driver gets a row an id at most: `size`, the vocabulary's, bounds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(size, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                raw = b"".join(map(unpack, b.column(0).slice(s, 256).to_pylist()))
                total += np.bincount(np.frombuffer(raw, id_type(size)), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = packed.select("packed").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_ids(docs: DataFrame, path: str, model: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs, appends end_id to each, and writes the files in ascending id order (null ids first; rows of one id in the order in which
    they are read, and dealt over as many tasks as they need).

    Null and empty texts have the end id alone. A text, however long, is encoded whole and lies in one block. An empty table gives a codebook
    and no block. Repeated rows and ids are each written. Other columns aren't read, so their names can't clash.
    """
    spark = docs.sparkSession
    packed = written(encode_ids(docs, model, end_id, id_col, text_col), "ids")
    size = max(word_bpe(model).size, (end_id or 0) + 1)
    counts = id_counts(packed, size)
    lengths = code_lengths(counts)
    spark.createDataFrame([(size, bytearray(lengths.tobytes()))], "size int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    kind = packed.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        book, part = Book(lengths), TaskContext.get().partitionId()
        block = before = 0
        names: list = []
        held: list[np.ndarray] = []
        total = 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            bits, marks = book.encode(ids)
            arrow_id = batch.schema.field(0).type
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([names], pa.list_(arrow_id)), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([marks.tobytes()], pa.binary()), pa.array([bits], pa.binary())],
                names=["part", "block", "before", "doc_ids", "sizes", "checkpoints", "bits"],
            )

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                names.append(name)
                held.append(np.frombuffer(unpack(x), id_type(size)))
                total += len(held[-1])
                if total >= BLOCK:
                    yield out()
                    block, before, total, names, held = block + 1, before + total, 0, [], []
        if held:
            yield out()

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("checkpoints", T.BinaryType()), T.StructField("bits", T.BinaryType())])
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // PART_IDS)
    placed = packed.withColumn("place_read", F.monotonically_increasing_id())  # of a written table, so the same whenever it is read
    placed.repartitionByRange(n, id_col, "place_read").sortWithinPartitions(id_col, "place_read").mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    drop(packed)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at path: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    ship(spark)
    size, lengths = spark.read.parquet(f"{path}/codebook").first()
    lengths = np.frombuffer(lengths, np.uint8)[:size]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, names, sizes, marks, bits = (batch.column(k)[i] for k in range(6))
                n = np.array(sizes.as_py(), np.int64)
                ids = book.decode(bits.as_py(), np.frombuffer(marks.as_py(), "<u8"), int(n.sum()))
                cuts = np.concatenate([[0], np.cumsum(n)])
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(np.full(len(n), part.as_py()), pa.int32()), pa.array(before.as_py() + cuts[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "part", "start", "n_tokens", "ids"],
                )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    docs = blocks.select("part", "before", "doc_ids", "sizes", "checkpoints", "bits").mapInArrow(run, schema)
    return docs.join(_first_ids(blocks), "part").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids")


def _first_ids(blocks: DataFrame) -> DataFrame:
    """part, first: ids before each part. A row a part, so a row a task of the writing job: few, whatever the input."""
    parts = blocks.groupBy("part").agg(F.sum(_ids_of_block()).alias("n"))
    return F.broadcast(parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first")))


def _ids_of_block():  # noqa: ANN202
    return F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)


def read_range(spark: SparkSession, path: str, first: int, n: int) -> DataFrame:
    """start, ids (little-endian unsigned 32-bit): the ids at the places first to first + n of all documents one after the other, a row a block.
    Blocks outside aren't decoded, and of those at the ends only the runs between checkpoints that are needed."""
    ship(spark)
    size, lengths = spark.read.parquet(f"{path}/codebook").first()
    lengths = np.frombuffer(lengths, np.uint8)[:size]
    blocks = spark.read.parquet(f"{path}/blocks")
    at = F.col("first") + F.col("before")
    held = blocks.select("part", "before", _ids_of_block().alias("n"), "checkpoints", "bits").join(_first_ids(blocks), "part").select(at.alias("start"), "n", "checkpoints", "bits")
    wanted = held.where((F.col("start") < first + n) & (F.col("start") + F.col("n") > first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(lengths)
        for batch in batches:
            for start, own, marks, bits in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                a, b = max(first - start, 0), min(first + n - start, own)
                low, high = a // CHECKPOINT, -(-b // CHECKPOINT)
                ids = book.decode(bits, np.frombuffer(marks, "<u8")[low:high], min(high * CHECKPOINT, own) - low * CHECKPOINT)
                ids = ids[a - low * CHECKPOINT : b - low * CHECKPOINT]
                yield pa.RecordBatch.from_arrays([pa.array([start + a], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["start", "ids"])

    return wanted.mapInArrow(run, "start long, ids binary")
