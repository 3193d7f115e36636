"""Makes the package importable on executors that don't have it on their path, and saves tables for several uses."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="sieveline-")) / "sieveline.zip"  # Spark serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "sieveline").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``. Only a session in one process may lack it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="sieveline-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sieveline/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The table, computed once: written to the shared folder, by the values of some columns, and read from there, so that it survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A saved table, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def having(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is in another table; they aren't shuffled for it unless its keys are many."""
    return rows.join(small(saved(ids.select(key).distinct(), "ids")), key, "left_semi")
