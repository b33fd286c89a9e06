"""Versioned snapshots of a catalog: write aside, verify, then swap a pointer if nobody else did.

A revision is a folder ``revisions/<sequence>`` with the tables as parquet and a manifest. The pointer is swapped by renaming a
file in the same folder, which the file system does at once; a writer that expected another revision fails and changes
nothing. Files go through Hadoop's file system, so shared storage works as a local folder does.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from parvis.operators.dedupe import content_hash
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """The current revision isn't the expected one."""


@dataclass
class Manifest:
    sequence: int
    state: str
    tables: dict[str, dict]
    changed: bool = True


class Catalog:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim(self, path: str, text: str) -> bool:
        """Creates the file unless there is one; False where another writer was first."""
        try:
            self._write(path, text, overwrite=False)
        except Py4JJavaError:
            if self._fs.exists(self._path(path)):
                return False
            raise
        return True

    def _write(self, path: str, text: str, overwrite: bool = True) -> None:
        stream = self._fs.create(self._path(path), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def current(self) -> int | None:
        pointers = [int(s.getPath().getName().split("-")[1]) for s in self._fs.globStatus(self._path(f"{self.folder}/current-*")) or []]
        return max(pointers, default=None)

    def manifest(self, sequence: int) -> Manifest | None:
        text = self._read(f"{self.folder}/revisions/{sequence}/manifest.json")
        return Manifest(**json.loads(text)) if text else None

    def load(self, table: str, sequence: int | None = None) -> DataFrame:
        sequence = self.current() if sequence is None else sequence
        known = self.manifest(sequence) if sequence is not None else None
        if known is None or known.state != "COMMITTED":
            raise FileNotFoundError("no committed revision")
        return self.spark.read.parquet(f"{self.folder}/revisions/{sequence}/{table}")

    def commit(self, tables: dict[str, tuple[DataFrame, str]], expected: int | None = None, check: bool = True) -> Manifest:
        """Writes tables {name: (rows, key)} as the next revision. With ``check`` the current revision must be the expected one,
        before and after writing. An identical catalog still makes a revision, marked as not changed."""
        before = self.current()
        if check and before != expected:
            raise Conflict(f"expected {expected}, found {before}")
        sequence = (before or 0) + 1
        # the number is taken by creating its manifest, which one writer only can do; numbers of failed writers are passed over
        while not self._claim(f"{self.folder}/revisions/{sequence}/manifest.json", json.dumps(asdict(Manifest(sequence, "BUILDING", {})))):
            sequence += 1
        base = f"{self.folder}/revisions/{sequence}"
        try:
            known = {}
            for name, (rows, key) in tables.items():
                rows.write.parquet(f"{base}/{name}")
                written = self.spark.read.parquet(f"{base}/{name}")
                h = content_hash(written, [F.col(c) for c in sorted(written.columns)]).first()
                known[name] = {"hash": h["hash"], "rows": h["rows"], "key": key}
            old = self.manifest(before) if before is not None else None
            done = Manifest(sequence, "COMMITTED", known, old is None or old.tables != known)
            self._write(f"{base}/manifest.json", json.dumps(asdict(done)))
            self._write(f"{self.folder}/.next-{sequence}", str(sequence))
            if check and self.current() != before or not self._fs.rename(self._path(f"{self.folder}/.next-{sequence}"), self._path(f"{self.folder}/current-{sequence}")):
                raise Conflict("another writer committed first")
        except Exception:
            self._write(f"{base}/manifest.json", json.dumps(asdict(Manifest(sequence, "FAILED", {}))))
            raise
        if before is not None:
            self._fs.delete(self._path(f"{self.folder}/current-{before}"), False)
        return done

    def verify(self, sequence: int) -> bool:
        """Do the tables still have the hashes of the manifest?"""
        known = self.manifest(sequence)
        if known is None:
            return False
        for name, said in known.tables.items():
            rows = self.spark.read.parquet(f"{self.folder}/revisions/{sequence}/{name}")
            if content_hash(rows, [F.col(c) for c in sorted(rows.columns)]).first()["hash"] != said["hash"]:
                return False
        return True
