"""Session settings, scratch tables and reading of inputs that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches (rows and bytes: texts may be very long) and make this package importable on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="sieveline-")) / "sieveline.zip"  # Spark serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "sieveline").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone: other columns, whatever their names, are left behind; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it if the table has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


class Scratch:
    """Tables of one run in the cluster's shared folder; they survive the loss of executors.

    The folder is ``spark.checkpoint.dir``. Without that setting a session whose driver and executors are one process (as in tests)
    gets a folder of its own; on a cluster that would be another folder on each machine, so there it is an error.
    ``drop`` removes what later steps of the run no longer read; what a returned DataFrame reads stays in the folder.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            base = tempfile.mkdtemp(prefix="sieveline-checkpoint-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/sieveline/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)
