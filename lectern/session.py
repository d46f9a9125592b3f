"""Reading the tables, and cutting lineage without losing fault tolerance."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one only where it is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lectern-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: lineage ends there and a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """The same by a compressed table in that folder: a checkpoint holds plain rows, several times as large. Removed when the session ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they may run elsewhere, or in another directory."""
    sc = spark.sparkContext
    if not getattr(sc, "_lectern_shipped", False):
        root = Path(__file__).resolve().parents[1]
        at = tempfile.mkdtemp(prefix="lectern-package-")
        shutil.copytree(root / "lectern", f"{at}/src/lectern", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{at}/lectern", "zip", f"{at}/src"))
        shutil.rmtree(f"{at}/src")
        sc._lectern_shipped = True
