"""Stages with manifests: a run that can be resumed.

A stage's tables are written to a folder of the run that works on it, and
published by one rename, manifest and data together, under a name made of the
stage and the fingerprint of its inputs. A stage whose folder is published is
read, not computed; one that fails publishes nothing and stops those after it.
Two runs may work on one stage: the first to publish is read by both. Folders
of runs that died are removed by ``clean``.

Everything is kept in the shared folder through Hadoop's file system, so that
any store that Spark writes to does; renaming a folder must be atomic there.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
WORKING = "_running"


class Store:
    """The few file operations that publishing needs."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def folders(self, path: str) -> list[tuple[str, float]]:
        """(name, seconds since the epoch of the last change) of the folders in path."""
        if not self.exists(path):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]


def file_fingerprint(spark: SparkSession, folder: str, pattern: str = "*") -> str:
    """A digest of the names, sizes and times of a folder's files (content is not read);
    the listing is Spark's, and its digest a sum, so no list of files is collected."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    h = [F.sum(F.xxhash64(F.lit(k), "path", "length", "modificationTime").cast("decimal(38,0)")) for k in (1, 2)]
    n, *sums = rows.agg(F.count(F.lit(1)), *h).first()
    return hashlib.sha256(json.dumps([n, *map(str, sums)]).encode()).hexdigest()


class Run:
    """One run over ``root``; ``stage`` computes or reuses."""

    def __init__(self, spark: SparkSession, root: str, run_id: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.run_id = run_id or uuid.uuid4().hex
        self.store = Store(spark, root)
        #: What each stage of this run did: "computed" or "reused".
        self.log: dict[str, str] = {}

    def stage(self, name: str, inputs: str, tables: Callable[[], dict[str, DataFrame]]) -> tuple[dict[str, DataFrame], str]:
        """The tables of a stage, and the fingerprint that the next stage takes as its input."""
        mark = hashlib.sha256(f"{name}\n{inputs}".encode()).hexdigest()
        done = f"{self.root}/{name}-{mark[:32]}"
        if not self.store.exists(f"{done}/{MANIFEST}"):
            work = f"{self.root}/{WORKING}/{self.run_id}/{name}-{mark[:32]}"
            self.store.delete(work)
            made = tables()
            for table, df in made.items():
                df.write.parquet(f"{work}/{table}")
            self.store.write(f"{work}/{MANIFEST}", json.dumps({"stage": name, "run": self.run_id, "inputs": inputs, "tables": sorted(made)}))
            # a rename onto a folder that exists would move into it: another run may have published meanwhile
            if self.store.exists(f"{done}/{MANIFEST}") or not self.store.rename(work, done):
                self.store.delete(work)
            self.log[name] = "computed"
        else:
            self.log[name] = "reused"
        text = self.spark.read.option("wholetext", True).text(f"{done}/{MANIFEST}").first()[0]
        return {t: self.spark.read.parquet(f"{done}/{t}") for t in json.loads(text)["tables"]}, mark

    def finish(self) -> None:
        """Removes this run's folder of unpublished work."""
        self.store.delete(f"{self.root}/{WORKING}/{self.run_id}")

    def clean(self, older_than: float = 86400.0) -> list[str]:
        """Removes the working folders of other runs that did not change for so many seconds; returns their names."""
        gone = [name for name, at in self.store.folders(f"{self.root}/{WORKING}") if name != self.run_id and time.time() - at >= older_than]
        for name in gone:
            self.store.delete(f"{self.root}/{WORKING}/{name}")
        return gone
