"""A folder of tables and small texts on any file system that Spark reads and all of the cluster shares.

Replacing several tables is one step to the outside: the new tables are written
beside the old ones, then a note of all moves is put in place by one rename, then
the moves are made.  Whoever comes next finishes the moves of a note that is still
there, so a driver lost half way leaves either the old tables or the new ones.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


class Store:
    """One writer at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("commits"))
        self.finish()

    def _at(self, name: str) -> JavaObject:
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str | None:
        """The text, or None if there is no such file."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Puts a text in place by one rename that replaces the old one."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(fresh), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(self._at(fresh)), self._fs.makeQualified(self._at(name)), how)

    def write_fresh(self, df: DataFrame, name: str) -> str:
        """Writes a table beside the one of this name; ``commit`` puts it in place."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        df.write.parquet(self.path(fresh))
        return fresh

    def commit(self, note: str, moves: dict[str, str], texts: dict[str, str]) -> None:
        """All fresh tables and texts come into place, or none does."""
        self.write(f"commits/{note}.json", json.dumps({"moves": moves, "texts": texts}))
        self._make(note)

    def finish(self) -> None:
        """Finishes the commits that were noted but not made in full."""
        for status in self._fs.listStatus(self._at("commits")):
            name = status.getPath().getName()
            if name.endswith(".json"):
                self._make(name.removesuffix(".json"))

    def _make(self, note: str) -> None:
        found = json.loads(self.read(f"commits/{note}.json"))
        for name, fresh in found["moves"].items():
            if self.exists(fresh):
                self._fs.delete(self._at(name), True)
                if not self._fs.rename(self._at(fresh), self._at(name)):
                    raise OSError(f"{fresh} could not be moved to {name}")
        for name, text in found["texts"].items():
            self.write(name, text)
        self._fs.delete(self._at(f"commits/{note}.json"), False)
