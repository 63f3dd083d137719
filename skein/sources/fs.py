"""Single files on whatever file system a path names, through Hadoop's client."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path if ":" in path.split("/")[0] else f"file://{path}" if path.startswith("/") else path)
        fs = p.getFileSystem(self.conf)
        fs.setWriteChecksum(False)
        return fs, p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def make_dir(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def join(self, folder: str, path: str) -> None:
        """Make one file of the parts Spark wrote to ``folder``, in their order, to take the
        place of ``path``; bytes go through the driver's JVM as a stream."""
        fs, p = self._at(path)
        partial = p.suffix(".partial")
        stream = fs.create(partial, True)
        try:
            parts = sorted((str(x.getPath()) for x in fs.globStatus(self.jvm.org.apache.hadoop.fs.Path(folder, "part-*"))))
            for part in parts:
                source = fs.open(self.jvm.org.apache.hadoop.fs.Path(part))
                self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 16, False)
                source.close()
            if not stream.getPos():
                stream.write(bytearray(b"\n"))
        finally:
            stream.close()
        self._swap(fs, partial, p)

    def _swap(self, fs, partial, p) -> None:
        fs.delete(p, False)
        if not fs.rename(partial, p):
            raise OSError(f"Cannot replace {p.toString()}")

    def replace(self, path: str, parts: Iterable[str], at_once: int = 2_000) -> None:
        """Write ``parts`` to a new file that then takes the place of ``path``."""
        fs, p = self._at(path)
        partial = p.suffix(".partial")
        stream, parts = fs.create(partial, True), iter(parts)
        try:
            while chunk := "".join(islice(parts, at_once)):
                stream.write(bytearray(chunk, "utf-8"))
        finally:
            stream.close()
        self._swap(fs, partial, p)
