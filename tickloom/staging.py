"""Tables and files in the folder that all machines of a cluster share: to cut a plan's lineage, and for shards."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a fresh local one, if one machine does all the work
    (tests, local mode); on a cluster that is an error, as executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def workspace(spark: SparkSession, label: str) -> str:
    """A new, empty path in the shared folder, removed when the driver ends, if not before."""
    path = f"{shared_root(spark)}/tickloom/{label}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_clean)
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = workspace(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make() gives, staged; all that was staged on the way to it is removed."""
    before = len(_STAGED)
    df = make()
    on_the_way = [path for _, path in _STAGED[before:]]
    out = stage(df, label)
    remove(out.sparkSession, *on_the_way)
    return out


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that nothing will read again."""
    for df in frames:
        if path := df.__dict__.pop("_staged_at", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete workspaces."""
    gone = set(paths)
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _STAGED[:] = [x for x in _STAGED if x[1] not in gone]


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a shared folder's URI; usable on the driver and in executors."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def _clean() -> None:
    for spark, path in list(_STAGED):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; a cluster's own expiry of the folder takes over
            return
