"""Small files and exclusive steps in any store that Hadoop's file systems reach: metadata only, never rows."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.io.IOUtils
        self.folder = folder.rstrip("/")
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._bytes = jvm.java.io.ByteArrayOutputStream

    def at(self, name: str):
        return self._path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        """The entries of a folder, sorted; none if it is not there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        source, out = self._fs.open(self.at(name)), self._bytes()
        self._io.copyBytes(source, out, 65536, True)
        return bytes(out.toByteArray()).decode("utf-8")

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not exist; false if it does. The store decides between two writers."""
        draft = f"{name}.draft"
        if self.exists(name):
            return False
        try:
            out = self._fs.create(self.at(draft), False)
        except Exception as e:  # noqa: BLE001 (py4j wraps what the store raises)
            if "exist" in str(e).lower():
                return False
            raise
        try:
            out.write(text.encode("utf-8"))
            out.close()
            return not self.exists(name) and self._fs.rename(self.at(draft), self.at(name))
        finally:
            self.delete(draft)

    def rename(self, name: str, to: str) -> bool:
        """Gives an entry of the folder another name, which must be free."""
        return not self.exists(to) and self._fs.rename(self.at(name), self.at(to))

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)
