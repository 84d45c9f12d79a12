"""Session helpers: where intermediate tables go, and a local session for tests and benchmarks."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Temporary folder of each local application that has no shared folder set.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder.

    Only a local session without that setting gets a temporary folder of this machine; on a
    cluster such a folder would be invisible to the other executors, so the setting is required.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="shelfmark-")
    return _local_dirs[context.applicationId]


def new_workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str, folder: str | None = None, by: str | None = None) -> DataFrame:
    """Write the rows to the shared folder, or a given one below it, and read them back.

    Ends the lineage: later jobs, and tasks that are run again, read the table and do not repeat
    the work behind it. With ``by`` the rows of each value of that column have a folder of their own.
    """
    path = os.path.join(folder, name) if folder else new_workspace(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with_counts(
    df: DataFrame, name: str, *counts: Column, folder: str | None = None
) -> tuple[DataFrame, Row]:
    """The same, with aggregates over the rows taken while they are written."""
    seen = Observation()
    rows = staged(df.observe(seen, *counts), name, folder)
    return rows, Row(**seen.get)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a form the optimizer recognises as such."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).select(*columns).where(F.lit(False))


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, for sessions started without --py-files."""
    context = spark.sparkContext
    if getattr(context, "_shelfmark_shipped", False):
        return
    source = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="shelfmark-"), "shelfmark")
    archive = shutil.make_archive(target, "zip", os.path.dirname(source), os.path.basename(source))
    context.addPyFile(archive)
    context._shelfmark_shipped = True


def local_session(cores: str = "8", memory: str = "8g", app: str = "shelfmark") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
