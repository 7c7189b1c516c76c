"""Versioned tables (S8): a table is a folder of complete versions and a log of numbered pointer files.

* A writer fills a version folder of its own, checks what it wrote, and commits by creating the pointer file
  with the next number, which only one writer can (exclusive create: compare-and-set). Nothing is renamed.
* A reader resolves the newest complete pointer once and reads that version's folder; publishing doesn't touch it.
* ``expire`` removes versions that were replaced, or never committed, longer ago than a grace period.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

POINTERS, VERSIONS = "_pointers", "_versions"
GRACE_SECONDS = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed first."""


class _Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, part: str) -> list[tuple[str, float]]:
        """(name, seconds of its last change) of a folder's entries."""
        at = self._path(f"{self.root}/{part}")
        if not self._fs.exists(at):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(at))

    def pointer(self, name: str) -> str | None:
        """The version a pointer names; None while it is being written."""
        stream = self._fs.open(self._path(f"{self.root}/{POINTERS}/{name}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else None

    def claim(self, name: str, version: str) -> bool:
        """Create the pointer, unless it exists."""
        self._fs.mkdirs(self._path(f"{self.root}/{POINTERS}"))
        try:
            out = self._fs.create(self._path(f"{self.root}/{POINTERS}/{name}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(f"{version}\n".encode())
        out.close()
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{path}"), True)


def _committed(f: _Folder) -> list[tuple[int, str, float]]:
    """(number, version, time) of complete pointers, in order."""
    out = []
    for name, t in f.names(POINTERS):
        if name.isdigit() and (version := f.pointer(name)):
            out.append((int(name), version, t))
    return out


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(number, path) of the committed version; None for a table without one."""
    f = _Folder(spark, root)
    for name, _ in reversed(f.names(POINTERS)):
        if name.isdigit() and (version := f.pointer(name)):
            return int(name), f"{f.root}/{VERSIONS}/{version}"
    return None


def publish_version(spark: SparkSession, df: DataFrame, root: str, check: Callable[[DataFrame], object] | None = None,
                    partition_by: list[str] | None = None, expected: int | None = None) -> tuple[int, str]:
    """Write, check and commit a version; (number, path). With ``expected`` (the number of the version that the new one
    was made from, 0 for none) the commit fails with ``Conflict`` if another one has come between; without, the
    last writer to commit wins. After a failure the committed version is what it was."""
    f = _Folder(spark, root)
    version = f"v-{uuid.uuid4().hex}"
    path = f"{f.root}/{VERSIONS}/{version}"
    try:
        w = (df.hint("rebalance", *partition_by) if partition_by else df).write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        if check is not None:
            check(spark.read.parquet(path))
        while True:
            # a pointer that is being written counts: its number is taken
            taken = max([int(n) for n, _ in f.names(POINTERS) if n.isdigit()], default=0)
            number = (taken if expected is None else expected) + 1
            if f.claim(f"{number:012d}", version):
                return number, path
            if expected is not None:
                raise Conflict(f"{root}: version {number} was committed by another writer")
    except Exception:
        f.delete(f"{VERSIONS}/{version}")
        raise


def expire(spark: SparkSession, root: str, grace_seconds: float = GRACE_SECONDS, now: float | None = None) -> list[str]:
    """Remove versions replaced, or written without a commit, more than ``grace_seconds`` ago; their names."""
    f = _Folder(spark, root)
    now = time.time() if now is None else now
    done = _committed(f)
    replaced = {v: done[i + 1][2] for i, (_, v, _) in enumerate(done[:-1])}
    gone = []
    for name, written in f.names(VERSIONS):
        if done and name == done[-1][1]:
            continue
        if now - replaced.get(name, written) > grace_seconds:
            f.delete(f"{VERSIONS}/{name}")
            gone.append(name)
    for number, version, _ in done[:-1]:
        if version in gone:
            f.delete(f"{POINTERS}/{number:012d}")
    return gone
