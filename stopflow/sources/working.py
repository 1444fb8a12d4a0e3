"""Working tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session may lack the setting, as in tests: its executors are the driver, and it gets a folder.
    Anywhere else its absence is an error, as executors do not see the driver's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stopflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialised(df: DataFrame, name: str = "work") -> DataFrame:
    """Writes a frame that is used many times to the shared folder and reads it back.

    Cuts the lineage with files that outlive any executor, keeps plans small, and gives every reader the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._working_path = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """A frame that is to be joined by shuffling both sides, whatever the planner takes its size for.

    The planner goes by the size of files, and a working table of few distinct values takes a fifteenth of its rows'
    size there: one below the limit for broadcasts may fill the driver's memory.
    """
    return df.hint("merge")


#: Frames that queries persisted and that no later query needs.
_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """Persists a frame that a query reads several times, until unkept()."""
    _kept.append(df.persist())
    return df


def unkept() -> None:
    """Releases what earlier queries persisted; called before each registered query."""
    while _kept:
        _kept.pop().unpersist()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Deletes working tables that no frame in use reads any more."""
    for one in tables:
        _delete(one.sparkSession, one._working_path)


def release(spark: SparkSession, name: str = "") -> int:
    """Deletes all working tables below the shared folder, or those of one name, once results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(path) if re.fullmatch(r"\w+-[0-9a-f]{32}", s.getPath().getName())]
    found = [p for p in found if not name or p.getName().startswith(f"{name}-")]
    for one in found:
        _delete(spark, one.toString())
    return len(found)
