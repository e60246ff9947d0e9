"""A table in hash buckets with numbered versions, of which a change rewrites only the buckets of changed keys.

Below the store's path lie ``data/<folder>/_bucket=<b>/`` with rows and ``versions/<number>.json``, a
manifest that names the folder of every bucket. A change writes the buckets it touches to a new folder
and then one manifest; all other buckets stay the files they were. The manifest is created under its number or
not at all, so of two writers one fails and nothing is mixed, and readers see a version whole.
A manifest also holds the last batch of each stream that was applied, so a batch that comes again changes nothing.

What passes through the driver is the manifest: one name for each bucket, whose number is fixed when the
store is made. A bucket of very many rows is split over tasks while it is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has published the version first."""


@dataclass
class Version:
    """A manifest: what a version of the table consists of."""

    number: int
    key: list[str]
    n_buckets: int
    schema: str
    folders: dict[int, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    """A bucketed table at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *(p for p in parts if p)]))

    # --- manifests ---------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        """Numbers of the versions that are there, in order."""
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version, by default the last one."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                raise LookupError(f"{self.path} holds no version")
            number = numbers[-1]
        row = self.spark.read.text(f"{self.path}/versions/{number:012d}.json", wholetext=True).first()
        held = json.loads(row.value)
        return Version(**held | {"folders": {int(b): f for b, f in held["folders"].items()}})

    def _publish(self, v: Version) -> Version:
        target, draft = self._path("versions", f"{v.number:012d}.json"), self._path("drafts", uuid.uuid4().hex)
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(v.__dict__).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        # a finished file moves under its number, if nobody has it
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {v.number} of {self.path} is there already")
        return v

    # --- rows --------------------------------------------------------------------------------

    def bucket(self, v: Version) -> Column:
        """The bucket of a row by its key; rows without a key have one too."""
        return F.pmod(F.xxhash64(*v.key), F.lit(v.n_buckets)).cast("int")

    def _write(self, v: Version, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.withColumn(BUCKET, self.bucket(v)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        return folder

    def _written(self, folder: str) -> set[int]:
        """Buckets that a folder has rows of."""
        top = self._path("data", folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return {int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")}

    def create(self, rows: DataFrame, key: Sequence[str], n_buckets: int) -> Version:
        """The first version."""
        v = Version(1, list(key), n_buckets, rows.schema.json())
        if self.numbers():
            raise Conflict(f"{self.path} is a store already")
        folder = self._write(v, rows)
        v.folders = {b: folder for b in self._written(folder)}
        return self._publish(v)

    def _of(self, v: Version, buckets: Sequence[int]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(v.schema))
        there = [f"{self.path}/data/{v.folders[b]}/{BUCKET}={b}" for b in buckets if b in v.folders]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*there)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the last one."""
        v = self.version(number)
        return self._of(v, sorted(v.folders))

    def lookup(self, keys: Sequence[tuple]) -> DataFrame:
        """The rows of a few keys, from their buckets' files only."""
        v = self.version()
        schema = T.StructType.fromJson(json.loads(v.schema))
        asked = self.spark.createDataFrame([tuple(k) for k in keys], T.StructType([schema[c] for c in v.key]))
        buckets = [r[0] for r in asked.select(self.bucket(v)).distinct().collect()]
        return _semi(self._of(v, buckets), asked, v.key, "left_semi")

    # --- changes -----------------------------------------------------------------------------

    def _change(self, v: Version, touched: DataFrame, make: Callable[[DataFrame], DataFrame], applied: dict[str, int]) -> Version:
        """A new version in which the buckets of the keys in ``touched`` hold ``make(their rows)``."""
        buckets = sorted(r[0] for r in touched.select(self.bucket(v)).distinct().collect())  # at most n_buckets numbers
        after = Version(v.number + 1, v.key, v.n_buckets, v.schema, dict(v.folders), v.applied | applied)
        if buckets:
            columns = [f.name for f in T.StructType.fromJson(json.loads(v.schema))]
            folder = self._write(v, make(self._of(v, buckets)).select(*columns))
            kept = {b: f for b, f in v.folders.items() if b not in buckets}
            after.folders = kept | {b: folder for b in self._written(folder)}
        return self._publish(after)

    def merge(self, rows: DataFrame, order: Sequence[str], stream: str | None = None, batch: int | None = None) -> Version:
        """Rows put into the store: of each key the one with the greatest ``order`` stays, be it old or new.

        ``order`` should tell all rows of a key apart; after it the other columns decide by their names, so the
        result doesn't depend on how rows are split into batches or on which comes first. A batch of a
        stream whose number isn't above the last one applied is left out.
        """
        v = self.version()
        if stream is not None and batch is not None and v.applied.get(stream, -1) >= batch:
            return v
        one = newest(rows, v.key, order)
        return self._change(v, one, lambda old: newest(old.unionByName(one), v.key, order), {} if stream is None else {stream: batch})

    def refresh(self, keys: DataFrame, build: Callable[[DataFrame], DataFrame]) -> Version:
        """All rows of some keys made anew by ``build(keys)``; a key for which it has no row goes."""
        v = self.version()
        dirty = keys.select(*v.key).distinct()
        return self._change(v, dirty, lambda old: _semi(old, dirty, v.key, "left_anti").unionByName(_semi(build(dirty), dirty, v.key, "left_semi")), {})

    def vacuum(self, keep: int = 1) -> int:
        """Delete the versions but the last ``keep`` and the folders that no remaining version names; the number of folders that go."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._path("versions", f"{n:012d}.json"), False)
        named = {f for n in numbers[-keep:] for f in self.version(n).folders.values()}
        top = self._path("data")
        gone = [s.getPath() for s in self._fs.listStatus(top) if s.getPath().getName() not in named] if self._fs.exists(top) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def newest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order``, then the greatest other columns; a null key is a key."""
    rest = [c for c in df.columns if c not in key]
    by = [*order, *sorted(c for c in rest if c not in order)]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")).select(*(F.col(k) if k in key else F.col(f"_row.{k}").alias(k) for k in df.columns))


def _semi(df: DataFrame, keys: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    side = keys.select(*(F.col(k).alias(f"_k_{k}") for k in key))
    return df.join(side, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], how)
