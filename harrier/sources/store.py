"""Several tables as one version: what a change writes is seen together or not at all.

Tables are written to folders of their own; a manifest with the next number names them all. A manifest is moved into its
place and never onto another, so of two writers that have read the same version one is refused and reads again. It takes
the place of row locks.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """The version that a change was made from is not the latest any more."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _disk(self):
        return self._at("").getFileSystem(self._conf)

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        disk, at = self._disk(), self._at("manifests")
        names = [f.getPath().getName() for f in disk.listStatus(at)] if disk.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Names and folders of a version's tables (the latest unless given)."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{version:010d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.tables(version)[name])

    def commit(self, changed: dict[str, DataFrame], seen: int) -> int:
        """Write the changed tables as the version after the one seen; others stay as they are there. Conflict if there is
        a later version already; nothing of the change is then seen."""
        if self.version() != seen:
            raise Conflict(f"version {self.version()} is later than {seen}")
        tables = self.tables(seen)
        for name, df in changed.items():
            at = f"{self.path}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(at)
            tables[name] = at
        disk, mine, place = self._disk(), self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{seen + 1:010d}.json")
        out = disk.create(mine, False)
        out.write(json.dumps(tables, sort_keys=True).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(disk.getUri(), self._conf).rename(mine, place, options)
        except Py4JJavaError as e:
            disk.delete(mine, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {seen + 1} was written meanwhile") from None
            raise
        return seen + 1
