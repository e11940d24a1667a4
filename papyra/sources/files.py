"""Files of a database through Hadoop's file systems, so that any store Spark reads works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def list(self, path: str) -> list[dict]:
        """name, path, folder and modified (epoch ms) of what is in a folder, by name; nothing if there is no folder."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found = [{"name": s.getPath().getName(), "path": s.getPath().toString(), "folder": s.isDirectory(), "modified": s.getModificationTime()} for s in fs.listStatus(p)]
        return sorted(found, key=lambda x: x["name"])

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False, and nothing written, if there is one of that name already."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True
