"""Small files and scratch folders on any Hadoop file system, through the session's own configuration."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


class Files:
    """Small text files under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        where, fs = self._at(name)
        return fs.exists(where)

    def names(self, folder: str) -> list[str]:
        where, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, name: str) -> str:
        where, fs = self._at(name)
        stream = fs.open(where)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write or replace."""
        where, fs = self._at(name)
        stream = fs.create(where, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that is not there yet; False if it is. A reader never sees half of it.

        Of several writers one succeeds where a file system's rename takes no name that is taken (as HDFS does), and on local disks, by a link.
        """
        where, fs = self._at(name)
        if fs.exists(where):
            return False
        part, _ = self._at(f"{name}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.getUri().getScheme() == "file":  # its rename replaces what is there
            try:
                os.link(part.toUri().getPath(), where.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
            fs.delete(part, False)
            return done
        done = not fs.exists(where) and fs.rename(part, where)
        if not done:
            fs.delete(part, False)
        return bool(done)

    def delete(self, name: str = "") -> None:
        where, fs = self._at(name)
        fs.delete(where, True)

    def modified(self, name: str) -> float:
        """When a file or folder was last written, in seconds."""
        where, fs = self._at(name)
        return fs.getFileStatus(where).getModificationTime() / 1000

    def size(self, name: str = "") -> int:
        """Bytes of a file, or of all files under a folder."""
        where, fs = self._at(name)
        return fs.getContentSummary(where).getLength()

    def stamp(self) -> str:
        """Names, lengths and times of the files of this path: changes when they do."""
        where, fs = self._at("")
        found = fs.globStatus(where)
        files = [s for f in found for s in (fs.listStatus(f.getPath()) if f.isDirectory() else [f])]
        return ";".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in files))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and all runs in one JVM (tests) a fresh local folder is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lodestack-")
    return _own_dirs[app]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, if the session is still there."""
    try:
        Files(spark, path).delete()
    except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    atexit.register(delete_path, spark, path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new path in the shared folder and read from there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._kept_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables as `kept` returned them, once nothing reads them any more."""
    for t in tables:
        delete_path(t.sparkSession, t._kept_at)
