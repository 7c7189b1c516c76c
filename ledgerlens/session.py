"""SparkSession construction and shared-folder helpers.

On a cluster the session is built by the launcher; we only read its settings.
``get_spark`` is for tests, the bench and local runs: it fills in settings that
are unset and never overrides ones the cluster already chose.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings applied only where the session leaves them unset.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "ledgerlens", cpus: int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (SparkSession.builder.master(f"local[{n}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
               .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEM", "8g")))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir``
    when set; only when it is unset (local tests) a scratch folder is
    registered through ``SparkContext.setCheckpointDir`` (the conf itself is
    not modifiable at runtime)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def warehouse_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder (lineage cuts,
    intermediate tables). Never a machine-local folder on a cluster."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


#: Folders under the shared one that hold scratch tables.
SCRATCH_FOLDERS = ("tables/scratch", "llm")


class ScratchScope:
    """The scratch tables written since the scope was opened."""

    def __init__(self, spark: SparkSession, outer: ScratchScope | None):
        self.spark, self.outer, self.paths = spark, outer, []

    def keep(self, path: str) -> None:
        """Leave a table to the scope around this one (to nobody, if there is none)."""
        self.paths.remove(path)
        if self.outer is not None:
            self.outer.paths.append(path)

    def close(self) -> None:
        while self.paths:
            delete_path(self.spark, self.paths.pop())


_SCOPE: ContextVar[ScratchScope | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[ScratchScope]:
    """Scratch tables written inside go when the block ends, also by an error. What the block computes must have been
    written or collected by then: a DataFrame that still reads a scratch table can't be used behind it."""
    scope = ScratchScope(spark, _SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        scope.close()


def own_scratch(path: str) -> str:
    """Name ``path`` to the open scope, if there is one, before it is written: a write that fails halfway goes too."""
    scope = _SCOPE.get()
    if scope is not None:
        scope.paths.append(path)
    return path


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path for a scratch table in the shared folder, owned by the open scope."""
    return own_scratch(warehouse_path(spark, f"scratch/{tag}-{uuid.uuid4().hex}"))


def delete_path(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep_scratch(spark: SparkSession, older_than_hours: float = 168.0) -> int:
    """Delete scratch tables that were last changed longer ago than this and return their number: a maintenance job for
    what drivers that died, and queries without a scope, left behind. No run may take longer than the limit."""
    base, gone = ensure_checkpoint_dir(spark).rstrip("/"), 0
    limit = (time.time() - 3600 * older_than_hours) * 1000
    for folder in SCRATCH_FOLDERS:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        for x in fs.listStatus(p) if fs.exists(p) else ():
            if x.isDirectory() and x.getModificationTime() <= limit:
                gone += bool(fs.delete(x.getPath(), True))
    return gone


def side_by_side(spark: SparkSession, work: list[Callable]) -> list:
    """The results of ``work``, in its order, its Spark jobs submitted from a thread each: a fit of many short jobs leaves
    cores to the others. The open scratch scope is that of the threads too. An error is raised once all have ended."""
    with ThreadPoolExecutor(max(len(work), 1)) as pool:
        runs = [pool.submit(copy_context().run, inheritable_thread_target(spark)(w)) for w in work]
    return [r.result() for r in runs]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package (once per application), through the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(root)))
    name = f"{ensure_checkpoint_dir(spark).rstrip("/")}/llm/package-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)
