"""Tables with upserts: copy-on-write Parquet in hash buckets, all tables moved at once by one manifest, retries without effect."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table; a table keeps its number.
BUCKETS = 32
BUCKET = "bucket_"
_VERSION = re.compile(r"manifest-(\d+)\.json$")


class Store:
    """A folder of tables. Each version is a manifest: of every table its key, schema and the folder of each bucket's rows.

    A change writes new folders for the buckets that it touches, then the next manifest; what fails before that leaves the
    old state. A change has a writer and a number: one that is not greater than the writer's last does nothing, so retries
    are safe. One writer at a time changes a store; of two that commit the same version, one fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._files = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        return sorted(int(m[1]) for x in self._files.listStatus(folder) if (m := _VERSION.search(x.getPath().toString())))

    def manifest(self, version: int | None = None) -> dict:
        """The current manifest, or that of an earlier version."""
        held = self.versions()
        if version is None and not held:
            return {"version": 0, "writers": {}, "tables": {}}
        wanted = held[-1] if version is None else version
        stream = self._files.open(self._at(f"{self.path}/manifests/manifest-{wanted:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        target = self._at(f"{self.path}/manifests/manifest-{manifest['version']:012d}.json")
        hidden = self._at(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._files.create(hidden, False)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        if self._files.exists(target) or not self._files.rename(hidden, target):
            raise OSError(f"another writer has written version {manifest['version']}")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table; one that was never written has none and fails."""
        held = self.manifest(version)["tables"].get(table)
        if held is None:
            raise ValueError(f"no table {table}")
        return self._rows(held, held["buckets"])

    def _rows(self, held: dict, folders: dict[str, str]) -> DataFrame:
        reader = self.spark.read.schema(held["schema"])
        paths = [f"{self.path}/{folder}" for folder in sorted(folders.values())]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], held["schema"])

    def change(self, writer: str, number: int, upserts: dict[str, tuple[DataFrame, list[str]]], drop: dict[str, Column] | None = None) -> bool:
        """Put rows in place of those of the same key, in all tables at once; False if the writer has done this number before.

        upserts: {table: (rows, key)}; keys are not repeated in rows, nulls are keys of their own. drop: {table: condition};
        rows of the table for which it is true go first, whatever their key, so that with rows it replaces a scope. Only
        touched buckets are read and written; with a condition, those that have such rows.
        """
        old = self.manifest()
        if old["writers"].get(writer, -1) >= number:
            return False
        new = {"version": old["version"] + 1, "writers": old["writers"] | {writer: number}, "tables": dict(old["tables"])}
        for table, (rows, key) in upserts.items():
            new["tables"][table] = self._changed(table, rows, key, old["tables"].get(table), (drop or {}).get(table))
        if new["tables"] != old["tables"]:  # else there is nothing that a retry could do again
            self._commit(new)
        return True

    def _changed(self, table: str, rows: DataFrame, key: list[str], held: dict | None, drop: Column | None) -> dict:
        if held is None:
            held = {"key": key, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "n": BUCKETS, "buckets": {}}
        if held["key"] != key:
            raise ValueError(f"the key of {table} is {held['key']}")
        dealt = lambda df: df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(held["n"])).cast("int"))
        columns = self.spark.createDataFrame([], held["schema"]).columns
        folder = f"data/{table}/{uuid.uuid4().hex}"
        given = f"{self.path}/{folder}-given"  # read twice, and may be costly or change
        dealt(rows.select(*columns)).write.partitionBy(BUCKET).parquet(given)
        fresh = self.spark.read.schema(f"{held['schema']}, {BUCKET} int").parquet(given)
        if not fresh.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"a key of {table} is repeated")
        touched = {str(r[0]) for r in fresh.select(BUCKET).distinct().collect()}  # as many as buckets, at most
        if drop is not None and held["buckets"]:
            touched |= {str(r[0]) for r in dealt(self._rows(held, held["buckets"])).where(drop).select(BUCKET).distinct().collect()}
        if not touched:
            self._files.delete(self._at(given), True)
            return held
        before = {b: f for b, f in held["buckets"].items() if b in touched}
        kept = dealt(self._rows(held, before))
        if drop is not None:
            kept = kept.where(~F.coalesce(drop, F.lit(False)))
        asked = fresh.select(*[F.col(k).alias(f"{k}_new_") for k in key])
        same = F.lit(True)
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_new_"))
        merged = kept.join(asked, same, "left_anti").unionByName(fresh)
        merged.repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        self._files.delete(self._at(given), True)
        written = [x.getPath().getName() for x in self._files.listStatus(self._at(f"{self.path}/{folder}"))]
        placed = {x.removeprefix(f"{BUCKET}="): f"{folder}/{x}" for x in written if x.startswith(f"{BUCKET}=")}
        return held | {"buckets": {b: f for b, f in held["buckets"].items() if b not in touched} | placed}

    def vacuum(self, keep: int = 1) -> int:
        """Remove what none of the last `keep` versions has, and the manifests before them; returns the number of folders removed."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for f in t["buckets"].values()}
        gone = 0
        for table in self._files.listStatus(self._at(f"{self.path}/data")) if self._files.exists(self._at(f"{self.path}/data")) else []:
            for write in self._files.listStatus(table.getPath()):
                for bucket in self._files.listStatus(write.getPath()):
                    name = "/".join(("data", table.getPath().getName(), write.getPath().getName(), bucket.getPath().getName()))
                    if bucket.isDirectory() and name not in used:
                        gone += bool(self._files.delete(bucket.getPath(), True))
        for v in versions[:-keep]:
            self._files.delete(self._at(f"{self.path}/manifests/manifest-{v:012d}.json"), False)
        return gone
