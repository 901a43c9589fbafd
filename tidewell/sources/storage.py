"""Small files on whatever file system Spark is configured for."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileInfo:
    path: str
    size: int
    modified_ms: int


class Storage:
    """Listing, reading and exclusive creation of files through Hadoop's file system API."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(self._conf)
        self.root = self.fs.makeQualified(path).toString()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def files(self, folder: str, recursive: bool = False) -> list[FileInfo]:
        """Files below a folder; none if it is not there."""
        if not self.exists(folder):
            return []
        # Drafts of other writers come and go meanwhile; plain statuses don't look at them again.
        found, folders = [], [self._path(folder)]
        while folders:
            for s in self.fs.listStatus(folders.pop()):
                if not s.isDirectory():
                    found.append(FileInfo(s.getPath().toString(), s.getLen(), s.getModificationTime()))
                elif recursive:
                    folders.append(s.getPath())
        return found

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Create a whole file under its final name unless the name is taken; False if it is.

        Readers see all of it or nothing.  On a local disk a hard link decides the
        race; elsewhere a rename, which must fail on an existing target, as it does
        on HDFS.
        """
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.write(draft, text)
        try:
            if self.fs.getScheme() == "file":
                try:
                    os.link(self._path(draft).toUri().getPath(), self._path(path).toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self.exists(path) and self.fs.rename(self._path(draft), self._path(path))
        finally:
            self.fs.delete(self._path(draft), False)

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self._path(folder))
