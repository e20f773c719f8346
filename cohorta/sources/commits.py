"""Commits of versioned folders.

A version is data below ``version=N`` folders and, written last, one empty
file whose name says everything about it.  Such a file exists or does not, so
a reader sees all of a version or nothing of it, and what a run that stopped
has left behind is never read.  One writer a folder is assumed, as elsewhere.
"""

from __future__ import annotations

import datetime as _dt
from typing import NamedTuple

from pyspark.sql import SparkSession

SUFFIX = ".commit"


class Commit(NamedTuple):
    """Versions ``base`` to ``version`` together are the state after ``day``."""

    version: int
    base: int
    day: _dt.date


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._dir = self._path(path)
        self._fs = self._dir.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def all(self) -> list[Commit]:
        """Commits, oldest first."""
        if not self._fs.exists(self._dir):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._dir)]
        parts = [n[:-len(SUFFIX)].split("_") for n in names if n.endswith(SUFFIX)]
        return sorted(Commit(int(v), int(b), _dt.date.fromisoformat(d)) for v, b, d in parts)

    def last(self) -> Commit | None:
        done = self.all()
        return done[-1] if done else None

    def as_of(self, day: _dt.date) -> Commit | None:
        """The last commit of ``day`` or before."""
        done = [c for c in self.all() if c.day <= day]
        return done[-1] if done else None

    def add(self, commit: Commit) -> None:
        name = f"{commit.version:010d}_{commit.base:010d}_{commit.day.isoformat()}{SUFFIX}"
        if not self._fs.createNewFile(self._path(self._dir, name)):
            raise FileExistsError(f"version {commit.version} is already committed")
