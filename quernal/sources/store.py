"""A database's folder, on any file system that Spark reaches: versions of its catalog, and its tables' files."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


class Store:
    """catalog-<n>.dat holds version n of the catalog; meta-<n>.json, written last and by a rename, makes it valid."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        top = self._path()
        self._fs = top.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}" if name else self.location)

    def uri(self, name: str) -> str:
        return f"{self.location}/{name}"

    def names(self, folder: str = "") -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for x in self.names() if (m := re.fullmatch(r"meta-(\d+)\.json", x)))

    def _write(self, name: str, text: str) -> None:
        draft = self._path(f".{name}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(draft, self._path(name)):
            raise OSError(f"{self.uri(name)} cannot be written")

    def _read(self, name: str) -> str:
        return self.spark.read.text(self.uri(name), wholetext=True).first()[0]

    def save(self, catalog: str, meta: dict) -> None:
        """A new version; the last but one and older ones go."""
        seen = self.versions()
        version = seen[-1] + 1 if seen else 1
        self._write(f"catalog-{version}.dat", catalog)
        self._write(f"meta-{version}.json", json.dumps(meta))
        for old in seen[:-1]:
            self.delete(f"meta-{old}.json")
            self.delete(f"catalog-{old}.dat")

    def latest(self) -> tuple[str, dict] | None:
        """(where the newest version's catalog lies, its meta)."""
        seen = self.versions()
        return (self.uri(f"catalog-{seen[-1]}.dat"), json.loads(self._read(f"meta-{seen[-1]}.json"))) if seen else None
