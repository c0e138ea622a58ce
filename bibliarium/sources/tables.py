"""The store: folders of Parquet for each table, named by one manifest, so that all tables change together.

A manifest lists each table's folders; a new one is written beside the last and takes its number by a rename, which
fails if another writer took it first. Readers see the tables of one manifest. Folders that a manifest leaves out go
with the manifest after it, so that who reads the one before still finds them. Rows are sorted within files by the
columns that look-ups go by (LAYOUT), so that statistics of row groups prune them.

Tables with a key (KEYS) are dealt to buckets by its hash, a folder of Spark's partitioned write each: upsert() reads and
rewrites the buckets of the rows it is given, near() reads those of some keys, and the others' folders stay as they are.
"""

from __future__ import annotations

import collections
import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEYS, LAYOUT, TABLES

#: Of a store that is made without a number; more for larger ones, as a bucket is what a change rewrites.
BUCKETS = 16
#: A bucket of an appended table with more folders than this is written anew as one.
MOST_FOLDERS = 8


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """buckets holds for a store that is made here; one that is there keeps its own."""
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._staged: dict[str, list[list[str]]] | None = None
        self._made: list[str] = []

    def _last(self) -> int:
        """The number of the last manifest; 0 if there is none."""
        where = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_")), default=0)

    def _manifest(self, number: int | None = None) -> dict[str, list[list[str]]]:
        """Of each table, its folders as (key, path); the last manifest's, or a given one's."""
        last = self._last() if number is None else number
        if last < 1:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{last:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: int, manifest: dict[str, list[list[str]]]) -> None:
        temp, final = (self._path(f"{self.root}/_manifests/{name}.json") for name in (f"_{uuid.uuid4().hex}", f"{before + 1:012d}"))
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise RuntimeError(f"another writer changed {self.root}")

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """What is appended and replaced in the block is seen when it ends, all of it or nothing. Reads see what was there before."""
        if self._staged is not None:  # within another one
            yield
            return
        before, old = self._last(), self._manifest()
        self._staged, self._made = {t: list(folders) for t, folders in old.items()}, []
        try:
            yield
            self._commit(before, self._staged)
        except BaseException:
            for folder in self._made:
                self._fs.delete(self._path(folder), True)
            raise
        else:
            folders = [{folder for x in m.values() for _, folder in x} for m in (self._manifest(before - 1), old, self._staged)]
            for folder in folders[0] - folders[1] - folders[2]:
                self._fs.delete(self._path(folder), True)
        finally:
            self._staged = None

    def _write(self, table: str, df: DataFrame) -> str:
        folder = f"{self.root}/{table}/{uuid.uuid4().hex}"
        self._made.append(folder)
        rows = df.select(*(df[f.name].cast(f.dataType) for f in TABLES[table]))
        (rows.sortWithinPartitions(*LAYOUT[table]) if table in LAYOUT else rows).write.parquet(folder)
        return folder

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self._count())).cast("int")

    def _count(self) -> int:
        """The store's number of buckets."""
        held = (self._staged or self._manifest()).get("_buckets")
        return int(held[0][0]) if held else self._buckets

    def _write_buckets(self, table: str, df: DataFrame) -> list[list[str]]:
        """Rows to a folder for each bucket that has any, as entries of a manifest."""
        folder = f"{self.root}/{table}/{uuid.uuid4().hex}"
        self._made.append(folder)
        rows = df.select(*(df[f.name].cast(f.dataType) for f in TABLES[table])).withColumn("_bucket", self._bucket(F.col(KEYS[table])))
        rows.repartition("_bucket").sortWithinPartitions("_bucket", *LAYOUT.get(table, [])).write.partitionBy("_bucket").parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        return [[n.removeprefix("_bucket="), f"{folder}/{n}"] for n in names if n.startswith("_bucket=")]

    def _folders(self, table: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[table])

    def near(self, table: str, keys: DataFrame) -> DataFrame:
        """Rows of the buckets in which the keys (the table's key column) are: all of these keys' rows, and few others."""
        touched = {str(r[0]) for r in keys.select(self._bucket(F.col(KEYS[table]))).distinct().collect()}  # as many as buckets at most
        return self._folders(table, [folder for key, folder in self._manifest().get(table, []) if key in touched or not key.isdigit()])

    def upsert(self, table: str, df: DataFrame) -> None:
        """Rows take the place of those of the same key, or are added. Only buckets that they fall in are read and written."""
        with self.transaction():
            fresh = self._write_buckets(table, df)
            touched, key = {k for k, _ in fresh}, KEYS[table]
            held = self._staged.get(table, [])
            before = [folder for k, folder in held if k in touched or not k]
            if before:
                new = self._folders(table, [folder for _, folder in fresh])
                both = self._folders(table, before).join(new.select(key), key, "left_anti").unionByName(new)
                replaced = self._write_buckets(table, both)
            else:
                replaced = fresh
            self._staged[table] = [x for x in held if x[0] and x[0] not in touched] + replaced

    def add(self, table: str, df: DataFrame) -> None:
        """Rows beside those that are there, to the buckets of their keys; a bucket of many folders becomes one."""
        with self.transaction():
            held = self._staged.get(table, []) + self._write_buckets(table, df)
            counts = collections.Counter(k for k, _ in held if k)
            full = {k for k, n in counts.items() if n > MOST_FOLDERS}
            if full:
                held = [x for x in held if x[0] not in full] + self._write_buckets(table, self._folders(table, [folder for k, folder in held if k in full]))
            self._staged[table] = held

    def create(self) -> None:
        """Every table that is not there yet, empty."""
        known = self._manifest()
        if set(TABLES) - set(known):
            with self.transaction():
                for table in TABLES:
                    self._staged.setdefault(table, [])
                self._staged.setdefault("_buckets", [[str(self._buckets), ""]])

    def drop(self) -> None:
        for table in (*TABLES, "_manifests"):
            self._fs.delete(self._path(f"{self.root}/{table}"), True)

    def read(self, table: str) -> DataFrame:
        return self._folders(table, [folder for _, folder in self._manifest().get(table, [])])

    def append(self, table: str, df: DataFrame, key: str = "") -> None:
        """Rows beside those that are there. With a key, they take the place of those that were appended under it before."""
        with self.transaction():
            self._staged[table] = [x for x in self._staged.get(table, []) if not key or x[0] != key] + [[key, self._write(table, df)]]

    def replace(self, table: str, df: DataFrame) -> None:
        with self.transaction():
            self._staged[table] = [["", self._write(table, df)]]

    def columns(self, table: str) -> list[str]:
        return self.read(table).columns if table in TABLES else []
