"""Driver-side file operations on whatever store Spark reaches, through Hadoop's file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that the driver and every executor see, under spark.checkpoint.dir.

    Where that setting is absent, local mode gets a temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Sorted names inside a folder; none if it isn't there."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def publish(self, made: str, path: str) -> None:
        """Give a finished file or folder its name, in one step; an existing name is never replaced."""
        if self.exists(path):
            raise FileExistsError(path)
        if not self.fs.rename(self._path(made), self._path(path)):
            raise OSError(f"{made} could not become {path}")

    def appender(self, path: str) -> Appender:
        return Appender(self, path)


class Appender:
    """A new file that grows by `write`; what was written is readable once `write` returns, `sync` forces it to disk."""

    def __init__(self, files: Files, path: str):
        # The local file system's checksum layer would hold back what is not a whole chunk.
        fs = files.fs.getRaw() if files.fs.getScheme() == "file" else files.fs
        fs.mkdirs(files._path(path).getParent())
        self._out, self.size = fs.create(files._path(path), False), 0

    def write(self, data: bytes) -> None:
        self._out.write(bytearray(data))
        self._out.hflush()
        self.size += len(data)

    def sync(self) -> None:
        self._out.hsync()

    def close(self) -> None:
        self._out.close()
