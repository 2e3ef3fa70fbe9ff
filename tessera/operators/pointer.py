"""A small JSON value that is replaced at once: numbered files beside each other, of which the highest counts.

A version is written under a name that no reader looks at and then renamed to its number; the number before stays until
then, so that a crash at any moment leaves the old or the new version and never none. Of two writers that start from the same
version only one succeeds.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

KEPT = 3


class Pointer:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        """The numbers of the versions that are kept, the current one last."""
        if not self.fs.exists(self.path):
            return []
        found = (re.fullmatch(rf"{self.name}-(\d+)\.json", s.getPath().getName()) for s in self.fs.listStatus(self.path))
        return sorted(int(m[1]) for m in found if m)

    def at(self, version: int) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{self.name}-{version:09d}.json").collect()))

    def latest(self) -> tuple[int, dict | None]:
        """The current version's number (0 if there is none) and value."""
        versions = self.versions()
        return (versions[-1], self.at(versions[-1])) if versions else (0, None)

    def read(self) -> dict | None:
        return self.latest()[1]

    def write(self, value: dict, *, after: int | None = None) -> int:
        """Make ``value`` the current version; with ``after``, only if that is the current number still. Gives the new number."""
        versions = self.versions()
        last = (versions or [0])[-1]
        if after is not None and after != last:
            raise OSError(f"{self.root}/{self.name} was changed by another: version {last}, not {after}")
        fresh, final = self._file(f".{self.name}-{uuid.uuid4().hex}"), self._file(f"{self.name}-{last + 1:09d}.json")
        out = self.fs.create(fresh, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(fresh, final):
            self.fs.delete(fresh, False)
            raise OSError(f"{final.toString()} was written by another")
        for old in versions[: -KEPT + 1]:
            self.fs.delete(self._file(f"{self.name}-{old:09d}.json"), False)
        return last + 1
