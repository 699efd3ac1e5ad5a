"""Small files and folders in the store that holds the data, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Files below one folder. A name is published by a rename that fails if it is taken."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, sorted; none if it is not there."""
        if not self.exists(folder):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move(self, source: str, target: str) -> bool:
        """Give ``source``, a file or folder, the name ``target``; False if that is taken."""
        parent = self._path(target).getParent()
        self._fs.mkdirs(parent)
        if self.exists(target):
            return False
        fs = self._jvm.org.apache.hadoop.fs
        options = self._gateway.new_array(fs.Options.Rename, 0)
        where = fs.FileContext.getFileContext(self._path(source).toUri(), self._conf)
        try:
            where.rename(self._path(source), self._path(target), options)
        except Exception:
            if self.exists(target):
                return False
            raise
        return True

    def put(self, name: str, text: str, temporary: str) -> bool:
        """Write a file under a ``temporary`` name and publish it; False if the name is taken."""
        stream = self._fs.create(self._path(temporary), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.move(temporary, name):
            return True
        self.delete(temporary)
        return False
