"""Sharding: small immutable shards, size-tiered compaction, versioned manifests.

A store is a folder of shards (Parquet files that never change) and manifests/v<version>.json, each of which has the
table's schema and lists the shards that make it up. A version is committed by renaming its manifest to a name that must
not exist, which file systems with such a rename do for one writer only (a store without needs a lock around commit()).
Readers use the manifest of the highest version. Shards that no manifest lists are invisible: a writer's that has not
committed yet, or garbage of runs that were lost, which vacuum() takes when they are old enough.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from chunklens.llm.shared import file_system


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _list(self, folder: str) -> list[tuple[str, int, float]]:
        """(name, bytes, when it was written) of what a folder holds."""
        fs, where = file_system(self.spark, f"{self.path}/{folder}")
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime() / 1000) for s in fs.listStatus(where)) if fs.exists(where) else []

    def version(self) -> int:
        """The highest committed version, 0 for an empty store."""
        return max((int(n[1:-5]) for n, _, _ in self._list("manifests") if n.endswith(".json") and n[0] == "v"), default=0)

    def _load(self, version: int) -> dict:
        if not version:
            return {"shards": [], "schema": None}
        fs, where = file_system(self.spark, f"{self.path}/manifests/v{version:08d}.json")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> list[dict]:
        """The shards (file, bytes, tier, born: the version that added it) of a version; the latest if none is given."""
        return self._load(self.version() if version is None else version)["shards"]

    def schema(self, version: int | None = None) -> StructType | None:
        """The columns of all shards of a version, in the order in which they came; all can be null. None if there are none."""
        found = self._load(self.version() if version is None else version)["schema"]
        return found and StructType.fromJson(found)

    def commit(self, shards: list[dict], base: int, schema: StructType | None = None) -> int:
        """Write version base + 1, whole or not at all: a temporary file, renamed to a name that must not exist. The
        schema is that of the base unless one is given."""
        version, jvm = base + 1, self.spark.sparkContext._jvm
        schema = schema if schema is not None else self.schema(base)
        fs, temporary = file_system(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        _, final = file_system(self.spark, f"{self.path}/manifests/v{version:08d}.json")
        stream = fs.create(temporary, False)
        stream.write(json.dumps({"version": version, "shards": shards, "schema": schema.jsonValue() if schema is not None else None}).encode())
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(temporary), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            fs.delete(temporary, False)
            if fs.exists(final):
                raise Conflict(f"version {version} exists") from error
            raise
        return version

    def _write(self, df: DataFrame, tier: int, born: int, max_records: int = 0) -> list[dict]:
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", max_records).parquet(f"{self.path}/{folder}")
        return [{"file": f"{folder}/{n}", "bytes": size, "tier": tier, "born": born} for n, size, _ in self._list(folder) if n.endswith(".parquet")]

    def append(self, df: DataFrame, max_records: int = 0, tries: int = 20) -> int:
        """Add a batch of arrivals as shards of tier 0, one a task (or one for so many records, if max_records is given),
        and commit; if another writer was first, the same shards are committed after its version. No shuffle.

        Columns that the table lacks are added to it, null in all older rows; those that the batch lacks are null in
        its rows. Names are equal but for case if Spark's are. A column with another type than the table's is refused
        (ValueError) before anything is written."""
        _merged(self.schema(), df.schema, self._folds())
        new = self._write(df, 0, 0, max_records)
        for _ in range(tries):
            base = self.version()
            found = self._load(base)
            schema = _merged(found["schema"] and StructType.fromJson(found["schema"]), df.schema, self._folds())
            try:
                return self.commit(found["shards"] + [s | {"born": base + 1} for s in new], base, schema)
            except Conflict:
                continue
        raise Conflict(f"other writers were first {tries} times")

    def _folds(self) -> bool:
        return self.spark.conf.get("spark.sql.caseSensitive", "false") == "false"

    def _read(self, shards: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s['file']}" for s in shards))

    def compact(self, target_bytes: int = 128 << 20, fanout: int = 4) -> int:
        """Merge runs of similarly sized shards until none is left to merge; the version that holds.

        A shard's size class is the power of `fanout` that holds it. A class with `fanout` shards or more (below the
        target size) is merged, as many at a time as make up the target, in one job without a shuffle: its files are
        dealt in order to as many tasks as there will be files. A shard of the target size stays as it is, so a row is
        rewritten once a class at most. Each round is committed, after what other writers appended meanwhile; if one
        took away a shard that was merged, the round is lost and begins anew. The replaced shards remain for readers
        of older versions.
        """
        while True:
            base = self.version()
            shards = self.manifest(base)
            classes: dict[int, list[dict]] = {}
            for s in shards:
                if 2 * s["bytes"] < target_bytes:
                    classes.setdefault(int(math.log(max(s["bytes"], 1), fanout)), []).append(s)
            due = [sorted(x, key=lambda s: (s["born"], s["file"])) for _, x in sorted(classes.items()) if len(x) >= fanout]
            if not due:
                return base
            gone, new, schema = set(), [], self.schema(base)
            for run in due:
                files = min(max(1, math.ceil(sum(s["bytes"] for s in run) / target_bytes)), len(run) // 2)
                new += self._write(self._read(run, schema).coalesce(files), max(s["tier"] for s in run) + 1, base + 1)
                gone |= {s["file"] for s in run}
            while gone <= {s["file"] for s in shards}:
                try:
                    self.commit([s for s in shards if s["file"] not in gone] + new, base)
                    break
                except Conflict:
                    base = self.version()
                    shards = self.manifest(base)

    def vacuum(self, keep_versions: int = 1, grace_seconds: float = 86_400) -> None:
        """Delete the manifests before the last `keep_versions`, and the shards that none of the rest lists, if they
        were written more than grace_seconds ago: younger shards can be of a writer that has not committed yet, which
        must do so within that time. Older versions can't be read any more."""
        latest, before = self.version(), time.time() - grace_seconds
        first = max(1, latest - keep_versions + 1)
        used = {s["file"] for v in range(first, latest + 1) for s in self.manifest(v)}
        for folder, _, _ in self._list("shards"):
            for name, _, written in self._list(f"shards/{folder}"):
                if f"shards/{folder}/{name}" not in used and written <= before:
                    fs, where = file_system(self.spark, f"{self.path}/shards/{folder}/{name}")
                    fs.delete(where, False)
        for name, _, written in self._list("manifests"):
            if name.endswith(".json") and name[0] == "v" and int(name[1:-5]) < first and written <= before:
                fs, where = file_system(self.spark, f"{self.path}/manifests/{name}")
                fs.delete(where, False)

    def read(self, version: int | None = None, shard_column: str | None = None) -> DataFrame:
        """The rows of a version (the latest if none is given), with the columns of all its shards; shard_column: a
        column for the row's file."""
        version = self.version() if version is None else version
        shards = self.manifest(version)
        if not shards:
            raise ValueError("the store is empty")
        rows = self._read(shards, self.schema(version))
        return rows.withColumn(shard_column, F.regexp_extract(F.col("_metadata.file_path"), "shards/(.*)$", 1)) if shard_column else rows


def _merged(old: StructType | None, new: StructType, folds: bool) -> StructType:
    """The columns of old, then what new has besides; all can be null."""
    key = (lambda x: x.lower()) if folds else (lambda x: x)
    fields = {key(f.name): f for f in old or ()}
    for f in new:
        if key(f.name) not in fields:
            fields[key(f.name)] = f
        elif fields[key(f.name)].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {fields[key(f.name)].dataType.simpleString()} in the table, {f.dataType.simpleString()} in the batch")
    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()])


def sharded(docs: DataFrame, path: str, target_bytes: int = 128 << 20, fanout: int = 4, batches: int = 1) -> ShardStore:
    """A compacted store at path of all rows of docs, whole, with all columns.

    docs arrives in `batches` parts, by the hash of doc_id (null ids in the first). The store is this call's alone: what
    was merged is deleted at the end. Nulls, empty texts, repeated rows
    and extra columns pass unchanged; an empty table gives a store with empty shards.
    """
    store = ShardStore(docs.sparkSession, path)
    for i in range(batches):
        store.append(docs if batches == 1 else docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)) == i))
    store.compact(target_bytes, fanout)
    store.vacuum(grace_seconds=0)
    return store
