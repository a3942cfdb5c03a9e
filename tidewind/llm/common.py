"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 4096


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may leave it unset; it gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _FOLDERS.get(sc.applicationId) or _FOLDERS.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="tidewind-"))
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The application takes this folder with it when it ends."""
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)


def parts(rows: int, each: int = 50_000) -> int:
    """Files for a table of so many rows."""
    return max(1, -(-rows // each))


def materialize(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; the shuffle files behind it go at once.

    A later job reads only the columns it needs, and lost executors lose nothing.
    ``discard`` removes the table; one that a result still reads goes with the
    application.  ``files``, in proportion to the rows, keeps a small table from
    having a file of each shuffle partition.
    """
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = f"{shared_folder(spark)}/tidewind-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tw_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        fs, where = _place(table.sparkSession, table._tw_path)
        fs.delete(where, True)


def tasks(df: DataFrame) -> int:
    """Partitions for a shuffle of this session that feeds Python workers."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Return to the system what the allocators hold of freed objects."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over batches, returning to the system what the allocators still hold at its end.

    Python workers outlive their task; idle ones would add up beside the next stage.
    """

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def bounded(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """``docs``, for Python workers: its session sends them at most so many rows at once from now on.

    Rows hold whole texts; Spark's 10,000 a batch would need room for as many, on
    both sides, in each task.  A session with smaller batches keeps them.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return docs


def chunks(pdf: pd.DataFrame, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Rows in turn, in parts of about ``most`` characters of text."""
    ends = np.cumsum(pdf["text"].str.len().fillna(0).to_numpy(dtype=np.int64))
    cuts = np.flatnonzero(np.diff(ends // most, prepend=0))
    for low, high in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
        if high > low:
            yield pdf.iloc[low:high]


def attach(rows: DataFrame, classes: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Left-join ``classes`` (one row per ``key``, ``count`` rows of ``rows`` each) to ``rows``.

    Keys with at least ``1 / HOT_SHARE`` of all rows number at most HOT_SHARE, so
    their classes are broadcast whatever the size of the input; no key that goes
    through the shuffle has a larger share than that.  ``rows`` should be
    materialized, it is read twice.
    """
    hot = classes.where(F.col(count) * HOT_SHARE >= F.lit(total))
    rest = classes.where(F.col(count) * HOT_SHARE < F.lit(total))
    found = rows.join(F.broadcast(hot), key, "inner")
    other = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return found.unionByName(other)


def stream_groups(df: DataFrame, keys: list[str], order: list[str], each: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``each(rows, group)`` over whole groups of equal integer ``keys``, many groups a call.

    Rows come sorted, as a stream of batches; only a group that is still open is
    held, so groups should be of bounded size.  ``group`` numbers the rows' groups.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            key = pdf[keys].to_numpy()
            new = np.ones(len(pdf), dtype=np.int64)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            return each(pdf.reset_index(drop=True), np.cumsum(new) - 1)

        for pdf in batches:
            if pdf.empty:
                continue
            key = pdf[keys].to_numpy()
            last = key[-1]
            cut = len(pdf) - int((key == last).all(axis=1).sum())
            if cut == 0 and held and (held[-1][keys].to_numpy()[-1] == last).all():
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf.iloc[:cut]]) if held else pdf.iloc[:cut]
            if len(whole):
                yield done(whole)
            held = [pdf.iloc[cut:]]
        if held:
            yield done(pd.concat(held))

    return df.repartition(tasks(df), *keys).sortWithinPartitions(*keys, *order).mapInPandas(tidy(run), schema)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of rows a[i] and b[i]; a label is the smallest row of its class."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(labels, up := labels[labels]):
            labels[:] = up
