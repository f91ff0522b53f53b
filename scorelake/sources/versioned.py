"""Tables that are changed as a whole or not at all: buckets by a hash of the key, copied when they are written, and a commit file written last.

A table is a folder. `data` holds a folder a write, with one a bucket in it; a file in `commits` names, for one version, the folders of each
bucket, the tokens of the writes that it holds and the schema. Readers follow the newest commit, so a write that was killed leaves nothing that
they see. A version's file is made by a rename that fails if there is one, so of two writers one is refused and can try again on what the
other left. A write with a token that the table holds already does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Tokens that a table remembers.
TOKENS = 1000
BUCKET = "_bucket"


class ConflictError(RuntimeError):
    """Another writer has made this version."""


class VersionedTable:
    """A table in the folder `path`; keys and the number of buckets are fixed by its first write."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._paths = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._paths(self.path).getFileSystem(self._conf)
        first = self.state()
        self.keys, self.buckets = (first["keys"], first["buckets"]) if first else (list(keys), buckets if keys else 1)

    # Commits

    def versions(self) -> list[int]:
        found = self._fs.globStatus(self._paths(f"{self.path}/commits/*.json")) or []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)

    def state(self, version: int | None = None) -> dict | None:
        """A version's commit, by default the newest; None where there is none."""
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return None
        stream = self._fs.open(self._paths(f"{self.path}/commits/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read_before(self, token: str, schema: T.StructType | str) -> DataFrame:
        """The rows of the newest version without the write of this token: what a write that is repeated has to start from."""
        state = next((s for v in reversed(self.versions()) if token not in (s := self.state(v))["tokens"]), None)
        return self.read(state) if state else self.spark.createDataFrame([], schema)

    def holds(self, token: str | None) -> bool:
        return token is not None and token in ((self.state() or {}).get("tokens") or [])

    def _commit(self, now: dict | None, schema: T.StructType, parts: dict[str, list[str]], token: str | None) -> int:
        version = (now["version"] if now else 0) + 1
        tokens = [*(now["tokens"] if now else []), *([token] if token is not None else [])][-TOKENS:]
        new = {"version": version, "keys": self.keys, "buckets": self.buckets, "schema": json.loads(schema.json()), "parts": {k: v for k, v in parts.items() if v}, "tokens": tokens}
        jvm = self.spark.sparkContext._jvm
        temporary, final = (self._paths(f"{self.path}/{p}") for p in (f"data/{uuid.uuid4().hex}.json", f"commits/{version:020d}.json"))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temporary, False)
        try:
            out.write(json.dumps(new).encode())
        finally:
            out.close()
        rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri() if temporary.toUri().getScheme() else self._fs.getUri(), self._conf).rename
        try:
            rename(temporary, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if "exists" in str(e.java_exception).lower():
                raise ConflictError(f"{self.path}: version {version} is there already") from None
            raise
        return version

    # Reading

    def bucket_of(self, *columns: Column) -> Column:
        """The bucket of these columns' values, as keys."""
        return F.pmod(F.xxhash64(*(columns or [F.col(f"`{k}`") for k in self.keys])), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def read(self, state: dict | None = None, only: Sequence[int] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
        """The rows of a version, by default the newest, or of some of its buckets. A table without a version is empty, of the schema given."""
        state = state or self.state()
        if state is None:
            if schema is None:
                raise ValueError(f"{self.path} holds no table")
            return self.spark.createDataFrame([], schema)
        own = T.StructType.fromJson(state["schema"])
        parts = [f"{self.path}/data/{p}" for k, ps in state["parts"].items() if only is None or int(k) in only for p in ps]
        return self.spark.read.schema(own).parquet(*parts) if parts else self.spark.createDataFrame([], own)

    # Writing

    def _data(self, df: DataFrame) -> dict[str, list[str]]:
        """Writes rows by bucket. Rows are dealt by bucket, large ones to several tasks."""
        name = uuid.uuid4().hex
        rows = df.withColumn(BUCKET, self.bucket_of())
        (rows.hint("rebalance", F.col(BUCKET)) if self.keys else rows).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        found = self._fs.globStatus(self._paths(f"{self.path}/data/{name}/{BUCKET}=*")) or []
        return {f.getPath().getName().split("=")[1]: [f"{name}/{f.getPath().getName()}"] for f in found}

    def overwrite(self, df: DataFrame, token: str | None = None) -> None:
        """df in place of all rows."""
        if not self.holds(token):
            self._commit(self.state(), df.schema, self._data(df), token)

    def append(self, df: DataFrame, token: str | None = None) -> None:
        """df beside the rows that are there; nothing is copied."""
        if self.holds(token):
            return
        now, new = self.state(), self._data(df)
        held = now["parts"] if now else {}
        self._commit(now, df.schema, {k: held.get(k, []) + new.get(k, []) for k in held.keys() | new.keys()}, token)

    def change(self, touched: Sequence[int], new: Callable[[DataFrame], DataFrame], schema: T.StructType | str, token: str | None = None) -> None:
        """new(rows of the touched buckets) in place of these; other buckets stay as they are, files and all."""
        if self.holds(token):
            return
        now = self.state()
        rows = new(self.read(now, touched, schema) if now else self.spark.createDataFrame([], schema))
        written = self._data(rows)
        if not written.keys() <= {str(k) for k in touched}:
            raise ValueError("a change gives rows of other buckets than it has read")
        held = now["parts"] if now else {}
        self._commit(now, rows.schema, {k: v for k, v in held.items() if int(k) not in touched} | written, token)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of keys: at most as many as there are."""
        return sorted(r[0] for r in keys.select(self.bucket_of().alias(BUCKET)).distinct().collect())

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType | str, token: str | None = None) -> None:
        """combine(current rows, batch) for the buckets of the batch's keys."""
        if not self.holds(token):
            self.change(self.touched(batch), lambda rows: combine(rows, batch), schema, token)

    def upsert(self, rows: DataFrame, token: str | None = None) -> None:
        """rows, one a key, in place of those of their keys, and beside all others."""
        same = lambda now, new: [now[k].eqNullSafe(new[k]) for k in self.keys]
        self.merge(rows, lambda now, new: now.join(new.select(*(F.col(f"`{k}`") for k in self.keys)), same(now, new), "left_anti").unionByName(new), rows.schema, token)

    def replace_keys(self, df: DataFrame, keys: DataFrame, token: str | None = None) -> None:
        """df, of these keys only, in place of all rows of these keys; keys that df has no row of are emptied."""
        keys = keys.select(*(F.col(f"`{k}`") for k in self.keys)).distinct()
        same = lambda a: [a[k].eqNullSafe(keys[k]) for k in self.keys]
        own = df.join(keys, same(df), "left_semi")
        self.change(self.touched(keys), lambda now: now.join(keys, same(now), "left_anti").unionByName(own), df.schema, token)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last commits, and the data that those don't name: of older versions and of writes that were killed. No other write
        may be under way."""
        versions = self.versions()
        named = {p.split("/")[0] for v in versions[-keep:] for ps in self.state(v)["parts"].values() for p in ps}
        for v in versions[:-keep]:
            self._fs.delete(self._paths(f"{self.path}/commits/{v:020d}.json"), False)
        for f in self._fs.globStatus(self._paths(f"{self.path}/data/*")) or []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)


def retried(write: Callable[[], None], times: int = 5) -> None:
    """Calls write again where another writer came first."""
    for k in range(times):
        try:
            return write()
        except ConflictError:
            if k + 1 == times:
                raise
    return None
