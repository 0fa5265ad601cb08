"""Small files on whatever file system Spark reads: local, HDFS or an object store with a Hadoop connector."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Files below a root, through Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = str(self._fs.makeQualified(path).toString()).rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _path(self, *parts: str):  # type: ignore[no-untyped-def]
        return self._jvm.org.apache.hadoop.fs.Path(self.at(*parts))

    def mkdirs(self, *parts: str) -> None:
        self._fs.mkdirs(self._path(*parts))

    def exists(self, *parts: str) -> bool:
        return bool(self._fs.exists(self._path(*parts)))

    def names(self, *parts: str) -> list[str]:
        return sorted(str(s.getPath().getName()) for s in self._fs.listStatus(self._path(*parts)))

    def read(self, *parts: str) -> str | None:
        """Text of a file, or None if there is none."""
        if not self.exists(*parts):
            return None
        stream = self._fs.open(self._path(*parts))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, text: str, overwrite: bool, *parts: str) -> None:
        stream = self._fs.create(self._path(*parts), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, text: str, *parts: str) -> None:
        """Write a file in one step: readers see the old text or the new one."""
        part = f"{parts[-1]}.{uuid.uuid4().hex}"
        self._write(text, True, *parts[:-1], part)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        target = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        target[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        context.rename(self._path(*parts[:-1], part), self._path(*parts), target)

    def create(self, text: str, *parts: str) -> bool:
        """Write a new file; False if there is one already."""
        try:
            self._write(text, False, *parts)
        except Exception as e:  # py4j hands every Java exception over as one type
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def rename(self, old: str, new: str) -> None:
        path = self._jvm.org.apache.hadoop.fs.Path
        if not self._fs.rename(path(old), path(new)):
            raise OSError(f"can't rename {old} to {new}")

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(*parts), True)
