"""Keyed tables that outlive their job: versioned snapshots behind one pointer.

A store is a folder of snapshots, ``v<number>`` with one table a sub-folder, and
pointers ``current.<number>``. A commit writes all tables of its snapshot first;
then it creates the pointer of the next number, which only one of several
concurrent commits can. Readers take the highest pointer, so they see all of a
commit or nothing of it; what a job that died left behind is no version. The
file system must rename in one step, as HDFS and local ones do.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another job committed since the tables were read."""


class Store:
    """Tables by name, read and committed together."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        found = [re.fullmatch(r"current\.(\d+)", f.getPath().getName()) for f in self._fs.listStatus(self._path(self.folder))]
        return max((int(m[1]) for m in found if m), default=0)

    def _snapshot(self, version: int) -> str:
        at = self._path(f"{self.folder}/current.{version}")
        stream = self._fs.open(at)
        try:
            return bytes(stream.readNBytes(1 << 10)).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the last one if none is given; empty before the first commit."""
        version = self.version() if version is None else version
        if not version:
            return {name: self.spark.createDataFrame([], schema) for name, schema in self.schemas.items()}
        at = f"{self.folder}/{self._snapshot(version)}"
        return {name: self.spark.read.schema(schema).parquet(f"{at}/{name}") for name, schema in self.schemas.items()}

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """Put ``tables``, made from version ``base``, in its place; returns the new version.

        Tables that are left out stay as they were. If another commit came
        first nothing changes, and :class:`Conflict` is raised.
        """
        if set(tables) - set(self.schemas):
            raise KeyError(f"unknown tables {set(tables) - set(self.schemas)}")
        old, name = self.read(base), f"v{base + 1}-{uuid.uuid4().hex[:12]}"
        for key, schema in self.schemas.items():
            given = tables.get(key, old[key])
            given.select(*self.spark.createDataFrame([], schema).columns).write.parquet(f"{self.folder}/{name}/{key}")
        part = self._path(f"{self.folder}/{name}/pointer")
        out = self._fs.create(part, False)
        out.write(bytearray(name.encode()))
        out.close()
        if self.version() != base or not self._claim(part, self._path(f"{self.folder}/current.{base + 1}")):
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
            raise Conflict(self.folder)
        return base + 1

    def _claim(self, part, pointer) -> bool:
        """Give the finished pointer its name in one step, which fails if the name is taken."""
        if self._fs.getScheme() != "file":
            return self._fs.rename(part, pointer)  # never replaces a file
        try:
            os.link(part.toUri().getPath(), pointer.toUri().getPath())  # a local rename would
        except FileExistsError:
            return False
        return True

    def update(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 5) -> int:
        """Commit ``change(tables)``, from the start again if another commit came first."""
        for k in range(tries):
            base = self.version()
            try:
                return self.commit(change(self.read(base)), base)
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 2) -> int:
        """Delete snapshots but those of the last ``keep`` versions, and what dead jobs left; run while nobody commits. Returns how many went."""
        last = self.version()
        kept = {self._snapshot(v) for v in range(max(1, last - keep + 1), last + 1)}
        gone = 0
        for f in self._fs.listStatus(self._path(self.folder)):
            name = f.getPath().getName()
            pointer = re.fullmatch(r"current\.(\d+)", name)
            if (re.match(r"v\d+-", name) and name not in kept) or (pointer and int(pointer[1]) <= last - keep):
                self._fs.delete(f.getPath(), True)
                gone += name.startswith("v")
        return gone
