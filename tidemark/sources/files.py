"""Small files on any file system that Spark can reach, over the JVM's own client."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tidemark.plans.config import ConfigError


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share, ``spark.checkpoint.dir``; where it is unset, a local one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root}/stores-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet, whole as soon as it is seen; False if it does.

        Local files are looked for before they are created, not in one step, and are seen while they are written: there a finished draft
        is linked to its name, which one of several writers can do. HDFS renames the draft in one step and never over a file. Other
        file systems create the file as they can; object stores show it when it is closed.
        """
        fs, p = self._at(path)
        scheme = fs.getUri().getScheme()
        if scheme not in ("file", "hdfs"):
            return self._write(fs, p, text)
        if fs.exists(p):
            return False
        fs.mkdirs(p.getParent())
        draft = self._jvm.org.apache.hadoop.fs.Path(p.getParent().getParent(), f"_draft-{uuid.uuid4().hex}")
        self._write(fs, draft, text)
        try:
            return self._link(draft, p) if scheme == "file" else fs.rename(draft, p)
        finally:
            fs.delete(draft, False)

    def _link(self, draft, p) -> bool:
        at = self._jvm.java.io.File
        try:
            self._jvm.java.nio.file.Files.createLink(at(p.toUri().getPath()).toPath(), at(draft.toUri().getPath()).toPath())
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _write(self, fs, p, text: str) -> bool:
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if fs.exists(p) or "AlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
