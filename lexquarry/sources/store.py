"""Tables kept for the length of an application in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    A local session without such a folder, as in tests, gets a temporary one; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there and survives lost executors.

    The table goes when it is released, or else when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    atexit.register(release, out)
    return out


def release(*frames: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more."""
    with contextlib.suppress(Exception):  # a table that stays only takes room; at the end the JVM may be gone
        for frame in frames:
            context = frame.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


class Marks:
    """Small named texts in a folder of a store that all executors share, each made once."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._gateway = path.rstrip("/"), spark.sparkContext._gateway
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._store = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self._store.exists(self._at(name))

    def read(self) -> dict[str, str]:
        """All marks by name."""
        if not self._store.exists(self._at("")):
            return {}
        out = {}
        for status in self._store.listStatus(self._at("")):
            if status.isFile() and not status.getPath().getName().startswith((".", "_")):
                stream = self._store.open(status.getPath())
                out[status.getPath().getName()] = bytes(stream.readAllBytes()).decode()
                stream.close()
        return out

    def make(self, name: str, text: str) -> bool:
        """Makes a mark; False if there is one of that name.

        The text is written aside, whole, and then moved to its name by a call that fails where that exists: a hard link on a
        local store, whose renames replace their targets, and a rename that doesn't elsewhere.
        """
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError("a name of letters and digits is needed")
        aside = self._at(f"_aside/{uuid.uuid4().hex}")
        stream = self._store.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._store.getScheme() == "file":
                none = self._gateway.new_array(self._jvm.String, 0)
                path = lambda p: self._jvm.java.nio.file.Paths.get(self._store.makeQualified(p).toUri().getPath(), none)
                self._jvm.java.nio.file.Files.createLink(path(self._at(name)), path(aside))
            else:
                keep = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._store.getUri(), self._conf).rename(aside, self._at(name), keep)
            return True
        except Exception:
            if not self.has(name):
                raise
            return False
        finally:
            with contextlib.suppress(Exception):
                self._store.delete(aside, False)

    def delete(self, path: str) -> bool:
        """Deletes a folder beside the marks; False if there is none."""
        return self._store.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
