"""Reading tables and cutting lineage, the same way on a laptop and on a cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a local one where it is unset (single-machine runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="parvis-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they find it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="parvis-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/parvis_package.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(f"{folder}/parvis_package.zip")


def large(df: DataFrame) -> DataFrame:
    """The rows for a join that never broadcasts a side. Spark judges exploded and checkpointed rows by the files they once came
    from, far below their size, and would gather them in the driver."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder; the plan above reads files and survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
