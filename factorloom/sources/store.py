"""Keyed tables that are kept: rows go to Parquet files by key range, and a manifest that is written last makes them a version.

A version's manifest names the folder of each key bucket. A change rewrites only the
buckets that hold its keys and names the others' folders again, so readers of an older
version keep what they read, a writer that dies leaves the table as it was, and of two
writers that start from one version the second is refused. Files are written and read by
Spark; the driver handles manifests alone, through Spark's own file systems.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.operators.statements import unrepeated
from factorloom.sources.evolution import changes, evolved, read_as

_BUCKET = "_bucket"
#: buckets up to which each task of a writer writes its part of all of them; of more, that would be too many small files
FEW_BUCKETS = 16


class Conflict(Exception):
    """Another writer has made this version."""


def work_folder(spark: SparkSession) -> str:
    """A new folder for files that executors share: in spark.checkpoint.dir, which a cluster must name."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='factorloom-')}/tables-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows as files in a work folder, so that what reads them more than once does not work them out again."""
    path = f"{work_folder(rows.sparkSession)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Files:
    """What a driver does with small files and folders, wherever Spark keeps them."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Whether the file is new; a file that is there is left as it is."""
        try:
            stream = self._fs.create(self._path(path), False)
        except Exception as failed:
            if "FileAlreadyExists" in str(failed) or "already exists" in str(failed):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class KeyedTable:
    """A stored table under ``path`` whose ``keys`` tell its rows apart.

    ``buckets``, which holds from the first version on, is the number of key ranges: a
    bucket should be some 100 MB to 1 GB. Key columns must not be NULL.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 8):
        self.spark, self.path, self.keys, self._buckets = spark, path, keys, buckets
        self._files = Files(spark, path)

    # reading

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._files.names(f"{self.path}/versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self._buckets, "schemas": [], "folders": {}}
        return json.loads(self._files.read(f"{self.path}/versions/{version or known[-1]:012d}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the newest without one."""
        manifest = self.manifest(version)
        if not manifest["schemas"]:
            raise ValueError(f"{self.path} has no version yet")
        return self._rows(manifest, manifest["folders"].keys())

    def _rows(self, manifest: dict, buckets) -> DataFrame:
        """Rows of some buckets in the newest schema; folders are read by the schema that they were written in."""
        newest = StructType.fromJson(manifest["schemas"][-1])
        by_schema: dict[int, list[str]] = {}
        for b in buckets:
            folder = manifest["folders"].get(str(b))
            if folder:
                by_schema.setdefault(folder["schema"], []).append(f"{self.path}/{folder['at']}")
        rows = self.spark.createDataFrame([], newest)
        for k, folders in sorted(by_schema.items()):
            old = self.spark.read.schema(StructType.fromJson(manifest["schemas"][k])).parquet(*folders)
            rows = rows.unionByName(read_as(old, newest)) if len(by_schema) > 1 else read_as(old, newest)
        return rows

    # writing

    def replace(self, rows: DataFrame) -> int:
        """A version that holds ``rows`` alone, in their own schema; they may be read from this table. A key that ``rows`` repeats fails."""
        base = self.manifest()
        return self._commit(base, unrepeated(rows, self.keys), "replace", set(base["folders"]), list(range(base["buckets"])), evolved(rows.schema, rows.schema))

    def upsert(self, rows: DataFrame) -> int:
        """Rows in place of those with equal keys. A key that ``rows`` repeats fails; columns may be new or wider (see ``evolution``)."""
        base = self.manifest()
        if not base["schemas"]:
            return self.replace(rows)
        staged = self.stage(rows)
        return self._merge(base, staged, unrepeated(staged, self.keys), "upsert")

    def change(self, staged: DataFrame, gone: Column, told: list[str]) -> int:
        """One version without the keys of rows that are ``gone``, and with the others in place of those with equal keys.

        staged: rows that ``stage`` has written, in which the caller has seen to it that no
        key repeats. The columns ``told``, which ``gone`` may read, are not stored.
        """
        return self._merge(self.manifest(), staged, staged.where(~gone).drop(*told), "change")

    def _merge(self, base: dict, staged: DataFrame, rows: DataFrame, action: str) -> int:
        """``rows`` in place of those that have a key of ``staged``."""
        schema = evolved(StructType.fromJson(base["schemas"][-1]), rows.schema)
        touched = [r[0] for r in staged.select(self._bucket(base["buckets"])).distinct().collect()]  # no more rows than buckets
        replaced = read_as(staged, schema).select(*self.keys)
        kept = read_as(self._rows(base, touched), schema).join(replaced, self.keys, "left_anti")
        return self._commit(base, kept.unionByName(read_as(rows, schema)), action, {str(b) for b in touched}, touched, schema)

    def delete(self, keys: DataFrame) -> int:
        """Without the rows that agree with a row of ``keys`` in its columns, all or some of the key's."""
        base = self.manifest()
        columns = keys.columns
        if not set(columns) <= set(self.keys):
            raise ValueError(f"{columns} are not among the keys {self.keys}")
        schema = StructType.fromJson(base["schemas"][-1])
        touched = [r[0] for r in keys.select(self._bucket(base["buckets"])).distinct().collect()] if len(columns) == len(self.keys) else list(range(base["buckets"]))
        kept = self._rows(base, touched).join(keys, columns, "left_anti")
        return self._commit(base, kept, "delete", {str(b) for b in touched}, touched, schema)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drops all but the ``keep`` newest versions, and folders that none of these names; not while writers are at work."""
        known = self.versions()
        for v in known[:-keep]:
            self._files.delete(f"{self.path}/versions/{v:012d}.json")
        named = {f["at"].split("/")[1] for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = sorted(set(self._files.names(f"{self.path}/data")) - named)
        for folder in gone:
            self._files.delete(f"{self.path}/data/{folder}")
        return gone

    def _bucket(self, n: int) -> Column:
        # of the keys as text, which is the same for a number that has become wider
        return self._keyed(F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(n)).cast("int"), "int").alias(_BUCKET)

    def _keyed(self, value: Column, kind: str) -> Column:
        """The value; a row that lacks its key fails."""
        missing = F.array_compact(F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in self.keys)))
        told = F.concat(F.lit("a row lacks its key: "), F.array_join(missing, ", "))
        there = F.lit(True)
        for k in self.keys:
            there &= F.col(k).isNotNull()
        return F.when(there, value).otherwise(F.raise_error(told).cast(kind))

    def stage(self, rows: DataFrame) -> DataFrame:
        """The rows as files that are in no version, so that they are worked out once, whatever they are read from. One that lacks its key fails."""
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        first = self.keys[0]
        rows.withColumn(first, self._keyed(F.col(first), rows.schema[first].dataType.simpleString())).write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _commit(self, base: dict, rows: DataFrame, action: str, dropped: set[str], touched: list[int], schema: StructType) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            dealt = rows.select("*", self._bucket(base["buckets"]))
            if base["buckets"] > FEW_BUCKETS:
                # a large bucket is written by several tasks, so that none sorts all of it
                dealt = dealt.hint("rebalance", _BUCKET)
            dealt.write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        schemas = list(base["schemas"])
        if not schemas or StructType.fromJson(schemas[-1]) != schema:
            schemas.append(schema.jsonValue())
        written = [n for n in self._files.names(f"{self.path}/{folder}") if n.startswith(f"{_BUCKET}=")]
        folders = {b: f for b, f in base["folders"].items() if b not in dropped}
        folders |= {n.split("=")[1]: {"at": f"{folder}/{n}", "schema": len(schemas) - 1} for n in written}
        manifest = {"version": base["version"] + 1, "action": action, "keys": self.keys, "buckets": base["buckets"], "schemas": schemas, "folders": folders}
        return self._publish(manifest)

    def _publish(self, manifest: dict) -> int:
        version = manifest["version"]
        if not self._files.create(f"{self.path}/versions/{version:012d}.json", json.dumps(manifest)):
            raise Conflict(f"version {version} of {self.path} is there already")
        return version

    def schema_changes(self, version: int, later: int) -> list[tuple[str, str, str]]:
        """(column, kind of change, what) between two versions."""
        return changes(*(StructType.fromJson(self.manifest(v)["schemas"][-1]) for v in (version, later)))
