"""Folders of batches that readers see through numbered versions.

A writer adds a batch as a folder of its own, which counts once its job has left the
``_SUCCESS`` mark. Batches that were merged are replaced: the merged folder is written
first, and counts only once a version names it together with what it replaces. A version is a file
that is written aside and renamed to the next free number, so of two writers one wins, and one that dies
before the rename changes nothing. Folders that a version replaced stay until ``vacuum``: who
opened them before goes on reading. The file system must rename without replacing, as HDFS does.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_versions"
MERGED = "merged-"


@dataclass(frozen=True)
class Version:
    """``replaced`` names, for each folder that is out of use, the folder that holds its rows now."""

    number: int = 0
    replaced: dict[str, str] = field(default_factory=dict)


class Batches:
    """The batches ``batch=<name>`` under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = self.hadoop.Path(path)
        self.fs = self.root.getFileSystem(self.conf)

    def _at(self, *names: str):
        out = self.root
        for n in names:
            out = self.hadoop.Path(out, n)
        return out

    def _glob(self, pattern: str) -> list:
        return list(self.fs.globStatus(self._at(*pattern.split("/"))) or [])

    def folder(self, name: str) -> str:
        return f"{self.path}/batch={name}"

    def version(self) -> Version:
        """The latest version; 0 where nothing was ever replaced."""
        numbers = [int(s.getPath().getName().split(".")[0]) for s in self._glob(f"{FOLDER}/*.json")]
        if not numbers:
            return Version()
        stream = self.fs.open(self._at(FOLDER, f"{max(numbers):09d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version(max(numbers), json.loads(text)["replaced"])

    def _marked(self) -> list[str]:
        return sorted(s.getPath().getParent().getName().split("=", 1)[1] for s in self._glob("batch=*/_SUCCESS"))

    def live(self, version: Version | None = None) -> list[str]:
        """Finished batches that count under a version, the latest one if none is given.

        A merged folder that no version names yet holds rows of batches that still count.
        """
        v = version or self.version()
        named = set(v.replaced.values())
        return [b for b in self._marked() if b not in v.replaced and (not b.startswith(MERGED) or b in named)]

    def finished(self, name: str) -> bool:
        """Whether a batch of that name has been added, merged since or not."""
        v = self.version()
        return name in v.replaced or name in self.live(v)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._at(f"batch={name}")).getLength()

    def commit(self, base: Version, replaced: dict[str, str]) -> bool:
        """The version after ``base``; False, and no change, if another writer has been first."""
        text = json.dumps({"replaced": {**base.replaced, **replaced}}, sort_keys=True)
        aside = self._at(FOLDER, f".{uuid.uuid4().hex}")
        out = self.fs.create(aside)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        rename = getattr(self.hadoop, "Options$Rename")
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kinds = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:
            context.rename(context.makeQualified(aside), self.fs.makeQualified(
                self._at(FOLDER, f"{base.number + 1:09d}.json")), kinds)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self.fs.delete(aside, False)
            return False

    def vacuum(self, hours: float = 24.0) -> list[str]:
        """Deletes replaced folders, and merged ones that never counted, older than ``hours``; their names.

        Age is that of the version that replaced a folder, so a reader has at least ``hours`` to finish.
        """
        v = self.version()
        until = (time.time() - hours * 3600) * 1000
        old = set()
        for s in self._glob(f"{FOLDER}/*.json"):
            if s.getModificationTime() <= until:
                old.add(int(s.getPath().getName().split(".")[0]))
        out = []
        if old:
            stream = self.fs.open(self._at(FOLDER, f"{max(old):09d}.json"))
            try:
                out = list(json.loads(bytes(stream.readAllBytes()).decode())["replaced"])
            finally:
                stream.close()
        held = {*v.replaced, *v.replaced.values()}
        for s in self._glob(f"batch={MERGED}*"):
            name = s.getPath().getName().split("=", 1)[1]
            if name not in held and s.getModificationTime() <= until:
                out.append(name)
        return [name for name in out if self.fs.delete(self._at(f"batch={name}"), True)]
