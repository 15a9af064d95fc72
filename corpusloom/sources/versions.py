"""Tables in versions: rows go to new folders first, then one small pointer file names the version that readers see.

A bucketed table lies in one folder for each bucket; a version says which version wrote each bucket, so a change of a few
rows writes a few buckets and shares all others. Nothing is ever written over: a reader keeps the version that it opened,
and a failure before the pointer moves leaves the old version as it was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "CURRENT"
#: Buckets of a store: one for so many files, within these bounds.
FILES_EACH, FEWEST, MOST = 500, 16, 4096


def buckets_for(files: int) -> int:
    return min(MOST, max(FEWEST, -(-files // FILES_EACH)))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class Version:
    """Which version wrote each bucket of each table (bucket -1: the table as a whole), schemas, and numbers to keep."""

    name: str
    buckets: int
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, Any] = field(default_factory=dict)
    facts: dict[str, Any] = field(default_factory=dict)
    #: [table, bucket, version] that the version before has and this one hasn't.
    replaced: list[list[str]] = field(default_factory=list)


class Store:
    """A folder of versioned tables. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str) -> tuple[Any, Any]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _text(self, path: str) -> str | None:
        files, target = self._at(path)
        if not files.exists(target):
            return None
        stream = files.open(target)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        files, target = self._at(path)
        stream = files.create(target, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def current(self) -> Version | None:
        """The published version; None before the first."""
        name = self._text(f"{self.path}/{POINTER}")
        return Version(**json.loads(self._text(f"{self.path}/versions/{name}.json"))) if name else None

    def read(self, version: Version, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a version, or some of its buckets."""
        kind = T.StructType.fromJson(version.schemas[table])
        parts = version.parts[table]
        wanted = parts if buckets is None else [b for b in map(str, buckets) if b in parts]
        paths = [self.folder(table, b, parts[b]) for b in wanted]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def folder(self, table: str, bucket: str, version: str) -> str:
        return f"{self.path}/{table}/{version}" + ("" if bucket == "-1" else f"/bucket={bucket}")

    def draft(self, buckets: int) -> Draft:
        return Draft(self, buckets)


class Draft:
    """A version that is being written."""

    def __init__(self, store: Store, buckets: int) -> None:
        self.store = store
        self.version = Version(uuid.uuid4().hex, buckets)

    def write(self, table: str, rows: DataFrame, order: list[str], dealt: bool = False, **options: Any) -> None:
        """Rows (bucket, ...) of the buckets that change, each sorted by ``order``. Adaptive execution cuts large buckets
        into several files and writes small ones together. Rows that are ``dealt`` by bucket already stay where they are."""
        path = f"{self.store.path}/{table}/{self.version.name}"
        kind = T.StructType([f for f in rows.schema.fields if f.name != "bucket"])
        placed = rows if dealt else rows.hint("rebalance", "bucket")
        placed.sortWithinPartitions("bucket", *order).write.options(**options).partitionBy("bucket").parquet(path)
        files, target = self.store._at(path)
        names = [s.getPath().getName() for s in files.listStatus(target)]
        self.version.parts[table] = {n.removeprefix("bucket="): self.version.name for n in names if n.startswith("bucket=")}
        self.version.schemas[table] = json.loads(kind.json())

    def written(self, table: str) -> DataFrame:
        """Rows (bucket, ...) of a table that this version wrote."""
        kind = T.StructType([*T.StructType.fromJson(self.version.schemas[table]).fields, T.StructField("bucket", T.IntegerType())])
        spark = self.store.spark
        return spark.read.schema(kind).parquet(f"{self.store.path}/{table}/{self.version.name}") if self.version.parts[table] else spark.createDataFrame([], kind)

    def whole(self, table: str, rows: DataFrame) -> None:
        """A narrow table, which every version writes as a whole."""
        rows.write.parquet(f"{self.store.path}/{table}/{self.version.name}")
        self.version.parts[table] = {"-1": self.version.name}
        self.version.schemas[table] = json.loads(rows.schema.json())

    def publish(self, before: Version | None, dirty: list[int], facts: dict[str, Any]) -> Version:
        """Take all other buckets from ``before``, move the pointer, and remove what the version before that alone had."""
        new, gone = self.version, {str(b) for b in dirty}
        new.facts = facts
        for table, parts in (before.parts if before else {}).items():
            kept = new.parts.get(table)
            if kept is None:  # not written: no row of it changed but for those that went
                new.schemas[table], kept = before.schemas[table], {}
            same = {b: v for b, v in parts.items() if b not in gone and b != "-1"} if before.buckets == new.buckets and "-1" not in kept else {}
            new.parts[table] = {**same, **kept}
            new.replaced += [[table, b, v] for b, v in parts.items() if new.parts[table].get(b) != v]
        self.store._put(f"{self.store.path}/versions/{new.name}.json", json.dumps(asdict(new)))
        self._point()
        for table, bucket, version in before.replaced if before else []:
            files, target = self.store._at(self.store.folder(table, bucket, version))
            files.delete(target, True)
        return new

    def _point(self) -> None:
        """Put the pointer in one step: written beside it and renamed over it."""
        jvm, gateway = self.store.spark.sparkContext._jvm, self.store.spark.sparkContext._gateway
        path = f"{self.store.path}/{POINTER}"
        self.store._put(f"{path}.{self.version.name}", self.version.name)
        files, target = self.store._at(path)
        _, made = self.store._at(f"{path}.{self.version.name}")
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), self.store.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(files.makeQualified(made), files.makeQualified(target), over)
