"""Session settings, and making this package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def builder(app: str = "stratalite") -> SparkSession.Builder:
    """A session builder with the settings the library is tested with."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
    )


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, unless the workers' PYTHONPATH has it already."""
    package = Path(__file__).resolve().parent
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(package.parent) in on_path or app in _shipped:
        return
    name = os.path.join(tempfile.mkdtemp(prefix="stratalite-"), f"{package.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; in local tests without one, a folder made here."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stratalite-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settled(df):
    """``df`` as a written checkpoint in the shared folder, where its lineage ends."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df, name: str):
    """``df`` as Parquet in the shared folder, read back: its lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/stratalite/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
