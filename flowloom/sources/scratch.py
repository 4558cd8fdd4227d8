"""Tables that are written to the shared folder and read again, and this package on the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors, once for each Spark application. Operators whose tasks run Python of it call this."""
    sc = spark.sparkContext
    if getattr(sc, "_flowloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="flowloom-"), "flowloom_ship.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._flowloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir tells. Where Spark runs on this machine alone, one of this machine will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(sc, "_flowloom_shared", None):
        sc._flowloom_shared = tempfile.mkdtemp(prefix="flowloom-shared-")
        sc.setCheckpointDir(sc._flowloom_shared)
    return sc._flowloom_shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is removed when the application ends."""
    path = f"{shared_dir(spark)}/flowloom/{uuid.uuid4().hex}/{name}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables as written() returned them, which nothing will read again: a loop keeps the disk of one round."""
    for df in tables:
        if df is not None:
            _MADE[df.sparkSession.sparkContext.applicationId].remove(df.scratch_path)
            _remove(df.sparkSession, df.scratch_path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession()
        for path in _MADE.get(spark.sparkContext.applicationId, []):
            _remove(spark, path)
