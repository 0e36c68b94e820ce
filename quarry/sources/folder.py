"""Small files in a folder on any file system that Spark can reach."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder, by Hadoop's file systems. Names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return bool(self._fs.exists(self._at(name)))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self.exists() else []

    def bytes(self, name: str) -> int:
        """Of a file, or of all files below a folder; 0 if there is none."""
        return int(self._fs.getContentSummary(self._at(name)).getLength()) if self.exists(name) else 0

    def written(self, name: str) -> float | None:
        """Seconds since 1970 at which it was written; None if it isn't there."""
        try:
            return self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000
        except Py4JJavaError as e:
            if "FileNotFoundException" not in str(e.java_exception):
                raise
            return None

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str = "") -> bool:
        """Writes a new file; False if there is one of the name."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "already exists" not in str(e.java_exception).lower() and "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def put(self, name: str, text: str) -> None:
        """Writes a new file that is seen only whole."""
        part = f".{uuid.uuid4().hex}"
        self.create(part, text)
        if not self._fs.rename(self._at(part), self._at(name)):
            raise RuntimeError(f"{self.path}/{name} could not be written")

    def move(self, name: str, to: str) -> bool:
        """False if another was faster."""
        try:
            return bool(self._fs.rename(self._at(name), self._at(to)))
        except Py4JJavaError:
            return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
