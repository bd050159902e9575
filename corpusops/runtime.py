"""Session-level helpers: shared-folder checkpoints and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a temporary one is set in local mode; a cluster without one raises ValueError."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(given)
        return given
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "corpusops-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, **options: int) -> DataFrame:
    """Writes a table into the shared checkpoint folder and reads it again.

    Like a checkpoint it cuts the lineage and outlives executors; as compressed columns it is smaller, and later scans
    prune it. The files go when the application ends. Options are those of the writer.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusops-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers of every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corpusops"), "corpusops_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("corpusops", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
