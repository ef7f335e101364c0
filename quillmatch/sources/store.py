"""Small files of a catalogue in any file system that Hadoop opens."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Store:
    """A folder of small files, replaced whole and atomically."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = folder.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def make(self) -> None:
        if self._fs.exists(self._path("")) and not self._fs.getFileStatus(self._path("")).isDirectory():
            raise NotADirectoryError(f"{self.folder} is a file")
        self._fs.mkdirs(self._path(""))

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._path(name)))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Write a file that must not exist yet; False if it does."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as error:
            if "FileAlreadyExists" in str(error) or self.exists(name):
                return False
            raise
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return True

    def claim(self, name: str, data: bytes) -> bool:
        """As ``create``, but exactly one of several claimants succeeds."""
        if self._fs.getScheme() != "file":
            return self.create(name, data)
        # Hadoop's local file system looks first and creates later.
        try:
            handle = os.open(self._path(name).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        return True

    def replace(self, name: str, data: bytes) -> None:
        """Write beside the file, then rename over it; the temporary never stays."""
        temporary = f"{name}.tmp.{self._jvm.java.util.UUID.randomUUID().toString()}"
        try:
            self.create(temporary, data)
            rename = self._jvm.org.apache.hadoop.fs.Options.Rename
            options = self._gateway.new_array(rename, 1)
            options[0] = rename.OVERWRITE
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
            context.rename(self._path(temporary).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()), self._path(name).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()), options)
        finally:
            self.delete(temporary)

    def delete(self, name: str) -> None:
        """Delete a file, or a folder with all it holds."""
        self._fs.delete(self._path(name), True)

    def move(self, name: str, to: str) -> bool:
        """Rename a file to a name that is free; False if it is gone."""
        try:
            return bool(self._fs.rename(self._path(name), self._path(to)))
        except Exception:
            if self.exists(name):
                raise
            return False
