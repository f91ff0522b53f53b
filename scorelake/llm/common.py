"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python worker takes at a time; outputs are yielded at this grain too.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch; a row more at most.
BATCH_BYTES = 4 << 20
#: Words of which Python holds a list at a time.
STEP_WORDS = 1 << 16
#: Bits of a page of a sieve, as many as bitmap_construct_agg sets; bits for each of its keys; and pages at most, 8 MB of them.
PAGE_BITS, KEY_BITS, MOST_PAGES = 1 << 15, 32, 1 << 11


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, if it isn't on their path (PYTHONPATH or the working folder), and bounds the batches of texts
    that they get, so that what they hold doesn't grow with the texts. The bound is a setting of the session, so it holds for the session's
    later queries too; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = str(spark.conf.get(key))
    if not own.rstrip("bB").isdigit() or not 0 < int(own.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    package = Path(__file__).resolve().parent.parent
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if str(package.parent) in map(os.path.realpath, places) or getattr(sc, "_package_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(path)
    sc._package_shipped = True


def model_file(name: str) -> str:
    """A tokeniser's file: a path as it is; a bare name is that of a public tokeniser, whose place is looked up where the file is read, so on
    the executor in its workers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_KEPT: dict = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """make()'s result, which a Python worker keeps from task to task until it is asked for another one: of all operators' models, tables and
    automata a worker holds the last."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        _KEPT[key] = make()
    return _KEPT[key]


#: Tables in the shared folder that results are, or may still be, read from.
_MADE: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, as spark.checkpoint.dir names it. Where it isn't set, a session on one machine gets a
    folder of that machine; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        sc = spark.sparkContext
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif sc.master.startswith("local") and "cluster" not in sc.master:
            root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
            sc.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later jobs neither compute it again nor depend on an executor's copy. Its size
    is known, so Spark can choose how to join it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop(*tables: DataFrame | str) -> None:
    """Deletes tables that `written` has returned, or paths of shared_path, when nothing is read from them any more."""
    for t in tables:
        path = t if isinstance(t, str) else t._table_path
        spark = SparkSession.active()
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in _MADE:
            _MADE.remove(path)


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """A bitmap of the hashes of a table's keys, in pages, as a table of page and bits: with it rows that have none of the keys are told before
    they are shuffled, all but one in 32. It is of 8 MB at most; beyond 2 million keys more rows pass it, so a join must follow."""
    pages = min(MOST_PAGES, 1 + keys.count() * KEY_BITS // PAGE_BITS)
    page, bit = _place(F.xxhash64(*columns), F.lit(pages))
    own = keys.select(page.alias("page"), bit.alias("bit")).repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = written(own, "sieve")
    out._pages = pages
    return out


def _place(hashed: Column, pages: Column) -> tuple[Column, Column]:
    return F.pmod(F.shiftright(hashed, 15), pages), hashed.bitwiseAND(F.lit(PAGE_BITS - 1).cast("long"))


def split(rows: DataFrame, by: DataFrame, *columns: Column) -> tuple[DataFrame, DataFrame]:
    """The rows whose columns may be a key of a sieve, among them all that are, and those whose columns are none."""
    page, bit = _place(F.xxhash64(*columns), F.lit(by._pages))
    byte = F.conv(F.hex(F.substring(by["bits"], F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1, F.lit(False))
    own = rows.join(F.broadcast(by), page == by["page"], "left")
    return own.where(held).drop(by["page"], by["bits"]), own.where(~held).drop(by["page"], by["bits"])


def clean() -> None:
    """Deletes every table that is left in the shared folder: for when the results that are read from them have been used."""
    drop(*list(_MADE))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries whose results have been written and that nothing refers to any more: it does so when the
    driver's JVM has collected them, which by itself may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of about `size` bytes of the text column at that position, one row at least."""
    for b in batches:
        col = b.column(text)
        ends = 0
        lengths = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if ends and ends + n > size:
                yield b.slice(start, i - start)
                start, ends = i, 0
            ends += n
        if start < b.num_rows:
            yield b.slice(start)
        del b, col
        pa.default_memory_pool().release_unused()


def utf8(col: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges starts[i] .. starts[i] + lengths[i], one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def words_of(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes b with inside[b]."""
    edge = np.diff(np.concatenate([[False], inside[buf], [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of each word buf[starts[i]:ends[i]], the same for the same bytes only. Words are the runs without white space (bytes 9 to 13
    and 32) of buf, all of them. A list of a few words and every distinct one are held at a time."""
    of = defaultdict(count().__next__)
    out = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), STEP_WORDS):
        j = min(i + STEP_WORDS, len(starts))
        out[i:j] = np.fromiter(map(of.__getitem__, buf[starts[i] : ends[j - 1]].tobytes().split()), np.int64, j - i)
    return out


def line_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of each string buf[starts[i]:ends[i]], the same for the same bytes only."""
    of = defaultdict(count().__next__)
    raw = memoryview(buf)
    return np.fromiter((of[bytes(raw[a:b])] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))


class WordTable:
    """Values of words that come again and again: what a worker has computed, by word.

    `compute` maps a list of distinct words to their values, one after the other in an array of `dtype`, and the number of each. At `cap`
    words, or `cap_bytes` bytes of them and their values, the table starts anew, so beyond the words of one call its memory is bounded.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: object, cap: int = 400_000, cap_bytes: int = 32 << 20):
        self.compute, self.dtype, self.cap, self.cap_bytes = compute, np.dtype(dtype), cap, cap_bytes
        self._clear()

    def _clear(self) -> None:
        self.known: dict = {}
        self.bytes = self.used = 0
        self.flat, self.at, self.size = np.zeros(1 << 16, self.dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _room(self, name: str, n: int) -> None:
        own = getattr(self, name)
        if n > len(own):
            setattr(self, name, np.concatenate([own, np.zeros(max(n, 2 * len(own)) - len(own), own.dtype)]))

    def _add(self, words: list) -> None:
        values, sizes = self.compute(words)
        n = len(self.known)
        self._room("flat", self.used + len(values))
        self._room("at", n + len(words))
        self._room("size", n + len(words))
        self.flat[self.used : self.used + len(values)] = values
        self.at[n : n + len(words)], self.size[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.used += len(values)
        self.bytes += sum(map(len, words)) + self.dtype.itemsize * len(values)

    def numbers(self, words: list) -> np.ndarray:
        """The place in .at and .size of each word's value, good until the next call."""
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if (gaps := np.flatnonzero(out < 0)).size:
            if len(self.known) >= self.cap or self.bytes >= self.cap_bytes:
                self._clear()
                gaps = np.arange(len(words))
            own = [words[i] for i in gaps.tolist()]
            self._add(list(dict.fromkeys(own)))
            out[gaps] = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        return out

    def concatenated(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The values of all words one after the other, and where each ends."""
        n = self.numbers(words)
        return self.flat[ragged(self.at[n], self.size[n])], np.cumsum(self.size[n])


def joined(texts: list[bytes], between: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with `between` after each, and each text's start, with the end of all as one more."""
    at = np.cumsum([0, *(len(t) + len(between) for t in texts)])
    return np.frombuffer(between.join([*texts, b""]), np.uint8), at
