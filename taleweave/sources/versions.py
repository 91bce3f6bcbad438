"""Tables that change as one: staged writes, and a manifest that names what counts.

Every table of a version lies in a folder of its own. ``publish`` writes the changed tables first and the manifest last;
until that is committed, readers see the version before, whatever of the new one is there. A manifest has a number, and
a number is written once, so of two writers that began from one version the second fails instead of undoing the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """The tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str) -> list:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []

    def number(self) -> int:
        """The newest version whose manifest is committed; 0 if there is none."""
        names = [p.getName() for p in self._files(f"{self.path}/manifests")]
        found = sorted((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), reverse=True)
        return next((n for n in found if any(p.getName() == "_SUCCESS" for p in self._files(f"{self.path}/manifests/v{n:09d}"))), 0)

    def folders(self) -> dict[str, str]:
        """The folder of each table of the newest version."""
        n = self.number()
        if not n:
            return {}
        rows = self.spark.read.schema("name string, folder string").json(f"{self.path}/manifests/v{n:09d}")
        return {r.name: r.folder for r in rows.collect()}

    def read(self, name: str) -> DataFrame | None:
        folder = self.folders().get(name)
        return self.spark.read.parquet(f"{self.path}/{folder}") if folder else None

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Make ``tables`` part of a new version, beside the others of the newest one; its number."""
        number, folders = self.number(), self.folders()
        for name, table in tables.items():
            folders[name] = f"{name}-{uuid.uuid4().hex}"
            table.write.parquet(f"{self.path}/{folders[name]}")
        manifest = self.spark.createDataFrame(sorted(folders.items()), "name string, folder string")
        manifest.coalesce(1).write.json(f"{self.path}/manifests/v{number + 1:09d}")
        return number + 1


def replaced(existing: DataFrame | None, partial: DataFrame, by: str, keys: DataFrame) -> DataFrame:
    """``existing`` with ``partial`` in place of all rows whose ``by`` is in ``keys``: groups without a new row go as well."""
    if existing is None:
        return partial
    return existing.join(keys.select(by).distinct(), by, "left_anti").unionByName(partial)
