"""Session helpers: shipping the package to executors and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Folders of the checkpoints made so far, one list for each `materialised` that is under way.
_MADE: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application; to be called before a Python function is handed to Spark.

    The driver's file server hands the archive to executors, so no shared path is needed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quire-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, os.path.join(root.name, path.relative_to(root)))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder of `spark.checkpoint.dir`, so that a lost executor costs no data.

    A session on one machine (tests, notebooks) may name no folder, and gets one; a cluster must.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quire-ckpt-"))
    out = df.checkpoint()
    if _MADE and (path := _folder(out)):
        _MADE[-1].append(path)
    return out


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below that of checkpoints, or on a single machine a temporary one."""
    sc = spark.sparkContext
    shared = sc._jsc.sc().getCheckpointDir()
    base = shared.get() if shared.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='quire-')}/files-{uuid.uuid4().hex}"


def _folder(checkpointed: DataFrame) -> str | None:
    """Where a checkpointed frame's rows lie."""
    file = checkpointed._jdf.logicalPlan().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def materialised(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """`make()`, checkpointed; the checkpoints that it made on the way are deleted, and so are shuffle files that nothing refers to any more."""
    _MADE.append([])
    try:
        out = checkpoint(make())
    finally:
        made = _MADE.pop()
    keep = _folder(out)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {p for p in made if p != keep}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    if _MADE and keep:
        _MADE[-1].append(keep)
    spark._jvm.System.gc()  # the driver's cleaner drops the files of what was collected
    return out
