"""A pipeline of stages that can be resumed: finished stages are read back, the rest are run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Stages over a folder on shared storage; the state is a small JSON file beside the results."""

    def __init__(self, spark: SparkSession, folder: str, version: str) -> None:
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.timings: dict[str, float] = {}

    def _state(self) -> dict:
        p = self._path(f"{self.folder}/state.json")
        if not self._fs.exists(p):
            return {"version": self.version, "done": []}
        stream = self._fs.open(p)
        try:
            state = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return state if state["version"] == self.version else {"version": self.version, "done": []}

    def run(self, name: str, stage: Callable[[], DataFrame], *, again: bool = False) -> DataFrame:
        """The stage's rows: read back if it is done under this version, else worked out and written. Running a stage again
        forgets those after it."""
        state, where = self._state(), f"{self.folder}/{name}"
        if name in state["done"] and not again:
            return self.spark.read.parquet(where)
        start = time.time()
        stage().write.mode("overwrite").parquet(where)
        self.timings[name] = time.time() - start
        before = state["done"][: state["done"].index(name)] if name in state["done"] else state["done"]
        stream = self._fs.create(self._path(f"{self.folder}/state.json"), True)
        try:
            stream.write(bytearray(json.dumps({"version": self.version, "done": [*before, name]}).encode()))
        finally:
            stream.close()
        return self.spark.read.parquet(where)
