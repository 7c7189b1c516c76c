"""Written intermediate tables in the shared folder (lineage cuts).

The feature job writes the snapshot table once; training, scoring and
evaluation read it (as the reference's programs read the snapshot file). The
stored split column is written next to it, so evaluation can never drift from
training. Tables live under ``spark.checkpoint.dir`` (the cluster's shared
folder; a scratch folder only when unset, as in tests) and are keyed by the
length and modification time of every input file, on whatever file system it lies, plus
a code version: a changed input is recomputed (the watch-mode rule of the
reference), and every process that shares the folder reads the same version.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import warehouse_path

CODE_VERSION = "6"
_LOCK = threading.RLock()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _input_key(spark: SparkSession, sf_dir: str, inputs: list[str]) -> str:
    # LEDGERLENS_RUN_TAG forces a fresh build (benchmarks, reruns after a code change)
    parts = [CODE_VERSION, os.environ.get("LEDGERLENS_RUN_TAG", ""), sf_dir]
    for name in inputs:
        p, fs = _fs(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        files = []
        if fs.exists(p):
            found = fs.listFiles(p, True)
            while found.hasNext():
                f = found.next()
                files.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
        parts += [name, *sorted(files)]
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def materialized(spark: SparkSession, name: str, sf_dir: str, inputs: list[str], build,
                 partition_by: list[str] | None = None) -> DataFrame:
    """Read table ``name`` for these inputs, writing it first if absent.

    Writers never overwrite: each build goes to its own ``v=<uuid>`` folder and
    readers take the first complete version (``_SUCCESS`` present), so
    concurrent jobs and retried builds cannot pull files from under a reader.
    """
    key = _input_key(spark, sf_dir, inputs)
    base = warehouse_path(spark, f"{name}/{key}")
    with _LOCK:
        path = _complete_version(spark, base)
        if path is None:
            path = f"{base}/v={uuid.uuid4().hex}"
            df = build()
            if partition_by:
                # tasks of about the advisory size per partition value: neither tasks x values small files nor one hot task
                df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
            else:
                df.write.parquet(path)          # the commit protocol writes _SUCCESS last
    return spark.read.parquet(path)


def _complete_version(spark: SparkSession, base: str) -> str | None:
    """First complete version folder of a table, or None."""
    p, fs = _fs(spark, base)
    if not fs.exists(p):
        return None
    names = sorted(x.getPath().getName() for x in fs.listStatus(p))
    for d in names:
        if d.startswith("v=") and fs.exists(_fs(spark, f"{base}/{d}/_SUCCESS")[0]):
            return f"{base}/{d}"
    return None


def drop_other_versions(spark: SparkSession, name: str, sf_dir: str, inputs: list[str]) -> int:
    """Delete the versions of table ``name`` that belong to other inputs than these (older ones, in
    regular use); the number deleted. For a maintenance job: readers of those versions would fail."""
    keep = _input_key(spark, sf_dir, inputs)
    p, fs = _fs(spark, warehouse_path(spark, name))
    gone = 0
    if fs.exists(p):
        for x in fs.listStatus(p):
            if x.getPath().getName() != keep:
                gone += bool(fs.delete(x.getPath(), True))
    return gone
