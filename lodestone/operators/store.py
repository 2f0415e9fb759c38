"""Versioned tables: delete-and-replace by file, several tables in one step.

A version is a manifest, numbered in sequence. What is new is written beside the old, and the manifest is created last and only
if its number is free: a failed write leaves the old version in place, all tables change together, and of two writers that
began at one version the second begins again at the first one's.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from functools import cache, reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each table, and the one that names its file.
SCHEMAS = {
    "files": "path string, hash string, last_indexed bigint, chunk_count int, language string, mtime bigint",
    "symbols": "id string, name string, qualified_name string, kind string, file_path string, start_line int, end_line int, signature string, parent_symbol string, visibility string, language string, parameters array<struct<name:string,type:string,defaultValue:string>>, return_type string",
    "dependency_edges": "from_file string, to_file string, kind string, symbols array<string>, from_line int",
    "call_edges": "caller_file string, caller_symbol string, caller_line int, callee_name string, callee_file string",
    "chunks": "id string, vector array<float>, filePath string, chunkName string, chunkType string, startLine int, endLine int, content string, language string",
    "tags": "name string, kind string, file string, line int, seq bigint",
    "contents": "path string, content string",
}
#: Bytes of a table's bucket beyond which the number of buckets is doubled.
BUCKET_BYTES = 256 << 20
KEYS = {"contents": "path", "files": "path", "symbols": "file_path", "dependency_edges": "from_file", "call_edges": "caller_file", "chunks": "filePath", "tags": "file"}


def replace_by_key(existing: DataFrame, new: DataFrame, key: str, replaced: DataFrame | None = None) -> DataFrame:
    """existing without the rows of the replaced keys (by default those of new), and new. Keys are a column named as key."""
    gone = (replaced if replaced is not None else new).select(key).distinct()
    return existing.join(gone, key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def delete_by_key(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti").select(*existing.columns)


class Conflict(RuntimeError):
    """Other writers were faster time and again."""


class Store:
    """The tables of one index, in a folder that Spark can write to.

    Rows lie in buckets by the hash of their file, each bucket in a folder of its own, and a version is a list of folders.
    So a small batch rewrites the few buckets that its files fall into, and the rest is shared with the version before. When
    buckets outgrow `bucket_bytes`, the next write doubles their number, so a batch rewrites a bounded amount for each file.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.buckets, self.bucket_bytes = spark, root.rstrip("/"), buckets, bucket_bytes

    # Small files ------------------------------------------------------------------------------------------------------

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._fs(name)
        return fs.exists(path)

    def _get(self, name: str) -> str:
        path, fs = self._fs(name)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet; False if somebody else's is."""
        path, fs = self._fs(name)
        try:
            stream = fs.create(path, False)
        except Py4JJavaError:
            if fs.exists(path):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def _list(self, name: str) -> list[str]:
        path, fs = self._fs(name)
        return sorted(st.getPath().getName() for st in fs.listStatus(path)) if fs.exists(path) else []

    def _drop(self, name: str) -> None:
        path, fs = self._fs(name)
        fs.delete(path, True)

    # Versions ---------------------------------------------------------------------------------------------------------

    def versions(self) -> list[str]:
        return [n.removesuffix(".json") for n in self._list("manifests") if n.endswith(".json")]

    def version(self) -> str | None:
        """The number of the last complete version."""
        for v in reversed(self.versions()):
            if self._manifest(v) is not None:
                return v
        return None

    def _settled(self) -> tuple[int, str | None]:
        """(the last number that anybody took, the last complete version). A manifest is written within moments of taking its
        number; one that stays incomplete was left behind by a writer that failed."""
        for _ in range(50):
            every = self.versions()
            if not every or self._manifest(every[-1]) is not None:
                return (int(every[-1]), every[-1]) if every else (0, None)
            time.sleep(0.1)
        return int(every[-1]), self.version()

    def _manifest(self, version: str | None) -> dict | None:
        """{buckets, tables: table -> bucket -> [folder, bytes]}; None for one whose writer didn't come to its end."""
        if version is None:
            return {"buckets": self.buckets, "tables": {name: {} for name in SCHEMAS}}
        try:
            m = json.loads(self._get(f"manifests/{version}.json"))
        except ValueError:
            return None
        for name in SCHEMAS:
            m["tables"].setdefault(name, {})
        return m

    def state_of(self, *names: str) -> str:
        """A short name for the state of some tables, the same as long as none of them changes."""
        m = self._manifest(self.version())["tables"]
        return hashlib.sha256(json.dumps([sorted(f for f, _ in m[n].values()) for n in names]).encode()).hexdigest()[:24]

    # Tables -----------------------------------------------------------------------------------------------------------

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{f}" for f in folders])

    def table(self, name: str, version: str | None = None) -> DataFrame:
        """The table as of a version, by default the current one; empty before the first write."""
        return self._read(name, sorted(f for f, _ in self._manifest(version or self.version())["tables"][name].values()))

    @staticmethod
    def _bucket(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def _commit(self, make: Callable[[str, DataFrame], DataFrame], touched: Callable[[str, int], set[int]], tries: int = 5) -> str:
        """Rewrite the touched buckets of each table by make(name, their rows), and make that the next version."""
        for _ in range(tries):
            taken, at = self._settled()
            old = self._manifest(at)
            n = old["buckets"]
            largest = max((sum(b for _, b in t.values()) for t in old["tables"].values()), default=0)
            while largest > n * self.bucket_bytes:
                n *= 2
            v = f"v-{uuid.uuid4().hex}"
            new = {"buckets": n, "tables": {name: dict(old["tables"][name]) for name in SCHEMAS}}
            for name in SCHEMAS:
                some = touched(name, n) if n == old["buckets"] else None  # None: all, as buckets are made anew
                folders = [f for b, (f, _) in old["tables"][name].items() if some is None or int(b) in some]
                rows = make(name, self._read(name, sorted(folders))).withColumn("bucket", self._bucket(KEYS[name], n))
                rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/data/{v}/{name}")
                new["tables"][name] = {b: x for b, x in new["tables"][name].items() if some is not None and int(b) not in some}
                for f in self._list(f"data/{v}/{name}"):
                    if f.startswith("bucket="):
                        path, fs = self._fs(f"data/{v}/{name}/{f}")
                        new["tables"][name][f.split("=")[1]] = [f"data/{v}/{name}/{f}", fs.getContentSummary(path).getLength()]
            number = f"{taken + 1:020d}"
            if self._create(f"manifests/{number}.json", json.dumps(new)):
                return number
            self._drop(f"data/{v}")
        raise Conflict(f"{tries} attempts to write to {self.root} met other writers")

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the last `keep` versions refers to; how many folders that were. Not while somebody writes."""
        every = self.versions()
        kept = [v for v in every if self._manifest(v) is not None][-keep:]
        used = {f.split("/")[1] for v in kept for t in self._manifest(v)["tables"].values() for f, _ in t.values()}
        gone = [f for f in self._list("data") if f not in used]
        for f in gone:
            self._drop(f"data/{f}")
        for v in every:
            if v not in kept and kept and v < kept[0]:
                self._drop(f"manifests/{v}.json")
        return len(gone)

    def _touched(self, keys: DataFrame, key: str, n: int) -> set[int]:
        """The buckets that keys fall into, at most n numbers."""
        return {r["b"] for r in keys.select(self._bucket(key, n).alias("b")).distinct().collect()}

    def upsert(self, batch: dict[str, DataFrame], paths: DataFrame) -> str:
        """Replace everything that is stored of paths (path) by the batch's rows, in all tables at once. The batch's rows
        belong to paths."""

        def make(name: str, base: DataFrame) -> DataFrame:
            key = KEYS[name]
            gone = paths.select(F.col("path").alias(key))
            new = batch.get(name)
            return replace_by_key(base, new, key, gone) if new is not None else delete_by_key(base, gone, key)

        buckets = cache(lambda n: frozenset(self._touched(paths, "path", n)))
        return self._commit(make, lambda _, n: buckets(n))

    def remove(self, paths: DataFrame) -> str:
        """Delete files from all tables, and the import edges that lead to them."""
        buckets = cache(lambda n: frozenset(self._touched(paths, "path", n)))
        inbound = self.table("dependency_edges").join(paths.select(F.col("path").alias("to_file")).distinct(), "to_file", "left_semi")
        edges = cache(lambda n: buckets(n) | self._touched(inbound, "from_file", n))

        def make(name: str, base: DataFrame) -> DataFrame:
            key = KEYS[name]
            df = delete_by_key(base, paths.select(F.col("path").alias(key)), key)
            return delete_by_key(df, paths.select(F.col("path").alias("to_file")), "to_file") if name == "dependency_edges" else df

        return self._commit(make, lambda name, n: edges(n) if name == "dependency_edges" else buckets(n))

    def orphans(self) -> DataFrame:
        """(table, path) of rows whose file isn't in `files`; a consistent store has none."""
        known = self.table("files").select("path")
        parts = [self.table(n).select(F.lit(n).alias("table"), F.col(k).alias("path")).join(known, "path", "left_anti") for n, k in KEYS.items() if n != "files"]
        return reduce(DataFrame.unionByName, parts).distinct()


def index_stats(files: DataFrame) -> DataFrame:
    """(files, chunks, oldest, newest): one row; 0 chunks and null times if there are no files."""
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.col("chunk_count").cast("bigint")), F.lit(0)).alias("chunks"), F.min("last_indexed").alias("oldest"), F.max("last_indexed").alias("newest")
    )


def staleness(files: DataFrame, now_ms: int, limit_ms: int = 3_600_000) -> DataFrame:
    """(newest, age_ms, stale): stale if the newest file was indexed more than limit_ms ago; never indexed isn't stale."""
    newest = F.max("last_indexed")
    return files.agg(newest.alias("newest"), (F.lit(now_ms) - newest).alias("age_ms"), F.coalesce(F.lit(now_ms) - newest > limit_ms, F.lit(False)).alias("stale"))
