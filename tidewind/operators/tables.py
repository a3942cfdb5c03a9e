"""Written tables that cut a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session may leave it unset and gets a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _FOLDERS.get(sc.applicationId) or _FOLDERS.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="tidewind-"))
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The application takes this folder with it when it ends."""
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)


def write(df: DataFrame) -> str:
    """The path of a new Parquet table of these rows; it goes with the application unless ``drop`` comes first."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewind-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    df.write.parquet(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)
