"""Sessions, tables and shared storage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def _forget(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only where that is unset and the master is local (tests), a temporary
    folder of this process is used; a cluster without the setting is refused,
    since its executors would not see a folder of one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="textloom-"))
        atexit.register(_forget, _LOCAL[0])
    return f"file://{_LOCAL[0]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not the
    whole computation, and so that several readers share one computation.
    Parquet is smaller than a checkpoint of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the folder is shared and outlives the session: what was written goes when the session's process ends
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Have the driver collect what finished jobs left, after many of them: its heap shrinks and their broadcasts go.

    A fit is some fifty jobs; else the heap stands at its limit soon, however
    little of it is alive.
    """
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
