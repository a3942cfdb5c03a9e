"""Files by their content and by their name, on file systems that the cluster shares."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at once, and bytes of small files that share a task.
CHUNK, TASK_BYTES = 8 << 20, 128 << 20


def _opened(path: str) -> tuple:
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class _DigestReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], task_bytes: int) -> None:
        self.path, self.names, self.task_bytes = path, names, task_bytes

    def partitions(self) -> list[_Files]:
        """Files dealt to tasks of about ``task_bytes``; a larger file is a task of its own, since a digest is read in order."""
        from pyarrow import fs

        system, root = _opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [], self.task_bytes
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and any(fnmatchcase(f.base_name, n) for n in self.names):
                if size + f.size > self.task_bytes or not out:
                    out, size = [*out, _Files([])], 0
                out[-1].files.append((f.path, f.size))
                size += f.size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        for path, _ in partition.files:
            digest, length = hashlib.sha256(), 0
            with system.open_input_stream(path) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
                    length += len(chunk)
            yield path, length, digest.hexdigest()


class FileDigests(DataSource):
    """``spark.read.format("tidewind_digests")``: ``(path, length, sha256)`` of the files below ``path``.

    ``names`` holds patterns of file names between commas.  A task holds one chunk
    of one file at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewind_digests"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema: object) -> DataSourceReader:
        return _DigestReader(self.options["path"], self.options.get("names", "*").split(","), int(self.options.get("taskBytes", TASK_BYTES)))


def file_hashes(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """``(path, length, sha256)`` of each file under ``path`` whose name fits one of the patterns, of any length."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("tidewind_digests").option("names", names).load(path)


def find_artifact(spark: SparkSession, root: str, name: str) -> str:
    """The path ``root/name`` if there is such a file, else the only file of that name below ``root``.

    No such file is an error, and so are several.
    """
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    first = jvm.org.apache.hadoop.fs.Path(root, name)
    fs = first.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(first):
        return first.toString()
    last, found = name.rsplit("/", 1)[-1], []
    if fs.exists(jvm.org.apache.hadoop.fs.Path(root)):
        files = fs.listFiles(jvm.org.apache.hadoop.fs.Path(root), True)
        while files.hasNext():
            at = files.next().getPath()
            if at.getName() == last:
                found.append(at.toString())
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files {last} below {root}")
    return found[0]
