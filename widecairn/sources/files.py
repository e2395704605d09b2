"""Small files through Hadoop's file systems, so that a root may lie in any store that Spark reaches."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Write a file that doesn't exist yet, whole or not at all; False if it exists.

        Of several writers of one name exactly one succeeds: the text goes to a file of its own,
        which then gets the name by a step that fails if there is such a file.  That step is a
        hard link on local file systems, elsewhere a rename without overwriting, which has to be
        atomic: it is on HDFS, it isn't on object stores that rename by copying.
        """
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        hadoop = self.jvm.org.apache.hadoop.fs
        temp = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(temp, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                local = [self.jvm.java.io.File(x.toUri().getPath()).toPath() for x in (p, temp)]
                self.jvm.java.nio.file.Files.createLink(*local)
            else:
                none = self.jvm.java.lang.reflect.Array.newInstance(getattr(hadoop, "Options$Rename")._java_lang_class, 0)
                hadoop.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(temp), fs.makeQualified(p), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(temp, False)
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
