"""Files next to the data, through Spark's own file systems."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Schemes of a storage root, and the one that Spark's file systems know it by.
SCHEMES = {"": "", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3a", "s3a": "s3a", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "az": "abfss", "azure": "abfss"}


def root_uri(text: str) -> str:
    """A root as Spark takes it; schemes that aren't known are refused."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", text)
    scheme = m[1].lower() if m else ""
    if scheme not in SCHEMES:
        raise ValueError(f"no storage scheme {scheme!r}")
    return text if not m else f"{SCHEMES[scheme]}://{text[m.end():]}"


#: Names that the sinks here use for their own files.
RESERVED = ("_published.json", "_temporary", "_staging", "_commits")
#: What lies where below a data root.
EPISODES, CATALOG, TEST_RUNS, IDENTITY = "episodes", "catalog", "test-runs", "workspace.json"
ROOT_VARIABLE, DEFAULT_ROOT = "TRAILMARK_DATA_ROOT", "./data"


def data_root(given: str | None = None) -> str:
    """The data root: what is given, else the environment's, else a folder here."""
    return root_uri(given or os.environ.get(ROOT_VARIABLE) or DEFAULT_ROOT)


def source_uri(spark: SparkSession, named: str, root: str) -> str:
    """Where a source is: a whole URI as it is, a path that exists, or a key below the data root; else an error."""
    if "://" in named:
        return root_uri(named)
    if Path(named).is_file():
        return f"file://{Path(named).resolve()}"
    if not named.startswith("/") and Folder(spark, root).exists(named):
        return f"{root_uri(root).rstrip('/')}/{valid_key(named)}"
    raise FileNotFoundError(f"{named!r} is no file here and no key below {root}")


def fetched(spark: SparkSession, uri: str, path: str) -> str:
    """Copies one file from anywhere that Spark reaches to a local path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root_uri(uri))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyToLocalFile(False, at, jvm.org.apache.hadoop.fs.Path(f"file://{Path(path).resolve()}"), True)
    return path


def workspace_identity(spark: SparkSession, root: str) -> dict[str, str]:
    """The workspace's id and when it was made. The first to ask makes it; of several at a time all get that of one."""
    folder = Folder(spark, root)
    made = {"identity_version": "1", "workspace_id": uuid.uuid4().hex, "created_at": dt.datetime.now(dt.timezone.utc).isoformat()}
    folder.create_text(IDENTITY, json.dumps(made, sort_keys=True))
    try:
        told = json.loads(folder.read_text(IDENTITY) or "")
    except ValueError as e:
        raise ValueError(f"{root}/{IDENTITY} isn't JSON: {e}") from None
    if not isinstance(told, dict) or told.get("identity_version") != "1" or not all(isinstance(told.get(k), str) and told[k] for k in ("workspace_id", "created_at")):
        raise ValueError(f"{root}/{IDENTITY} names no workspace of version 1")
    return told


def valid_key(key: str) -> str:
    """A relative path without parent steps; its last part isn't a name that the sinks use themselves."""
    if key.rpartition("/")[2].startswith(RESERVED[:3]):
        raise ValueError(f"{key!r} ends in a reserved name")
    if not key or key.startswith("/") or any(p in ("", ".", "..") for p in key.split("/")):
        raise ValueError(f"not a key: {key!r}")
    return key


class Folder:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root_uri(root).rstrip("/")
        self.gateway, self.conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, key: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{valid_key(key)}" if key else self.root)

    def exists(self, key: str) -> bool:
        return self.fs.exists(self._path(key))

    def names(self, key: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(key))) if not key or self.exists(key) else []

    def read_text(self, key: str) -> str | None:
        if not self.exists(key):
            return None
        stream = self.fs.open(self._path(key))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def uri(self, key: str) -> str:
        return f"{self.root}/{valid_key(key)}"

    def child(self, spark: SparkSession, key: str) -> Folder:
        return Folder(spark, self.uri(key))

    def size(self, key: str) -> int:
        """Bytes of a file; FileNotFoundError without one."""
        if not self.exists(key):
            raise FileNotFoundError(self.uri(key))
        return self.fs.getFileStatus(self._path(key)).getLen()

    def read_bytes(self, key: str) -> bytes | None:
        if not self.exists(key):
            return None
        stream = self.fs.open(self._path(key))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, key: str, data: bytes) -> None:
        """Writes a small file, in place of one that is there."""
        temporary = f"{key}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(temporary), False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self.replace(temporary, key)

    def create_text(self, key: str, text: str) -> bool:
        """Writes a file that isn't there yet; False if another was first.

        Of several writers at the same moment one succeeds: Hadoop's file systems create a
        file exclusively, but for the local one, where a finished file is linked to its name.
        """
        if self.exists(key):
            return False
        path = self._path(key)
        self.fs.mkdirs(path.getParent())
        try:
            if self.fs.getUri().getScheme() == "file":
                return self._linked(path.toUri().getPath(), text)
            stream = self.fs.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def _linked(self, path: str, text: str) -> bool:
        folder, _, name = path.rpartition("/")
        at = lambda p: self.jvm.java.io.File(p).toPath()
        temporary = at(f"{folder}/.{name}.{uuid.uuid4().hex}")
        files = self.jvm.java.nio.file.Files
        self.jvm.org.apache.commons.io.FileUtils.writeByteArrayToFile(temporary.toFile(), bytearray(text.encode()))
        try:
            files.createLink(at(path), temporary)
        finally:
            files.delete(temporary)
        return True

    def move(self, source: str, target: str) -> None:
        """Renames a file or folder; the target must not exist.

        Hadoop's own rename would put a folder into one of the target's name that another writer
        has made in between; this one refuses that, on HDFS in one step with the rename.
        """
        if self.exists(target):
            raise FileExistsError(target)
        self.fs.mkdirs(self._path(target).getParent())
        hadoop = self.jvm.org.apache.hadoop.fs
        try:
            context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
            context.rename(self._path(source), self._path(target), self.gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise FileExistsError(target) from None
            if "UnsupportedFileSystem" not in str(e):
                raise
            if not self.fs.rename(self._path(source), self._path(target)):
                raise OSError(f"couldn't move {source} to {target}") from None

    def replace(self, source: str, target: str) -> None:
        """Renames a file or folder to a name that may be taken: what was there is moved aside first, and deleted last."""
        aside = f"{target}.{uuid.uuid4().hex}"
        there = self.exists(target)
        if there:
            self.move(target, aside)
        try:
            self.move(source, target)
        except BaseException:
            if there:
                self.move(aside, target)
            raise
        if there:
            self.delete(aside)

    def delete(self, key: str) -> None:
        self.fs.delete(self._path(key), True)
