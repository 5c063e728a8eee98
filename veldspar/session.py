"""Spark session settings and the shared folder that long jobs cut their lineage in."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "veldspar", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    AQE re-plans joins, splits skewed shuffle partitions and coalesces small ones.  Timestamps are
    zone-free and the session zone is UTC, so Oracle DATE values keep their wall-clock reading.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a machine-local folder
    is invisible to the other executors, so the missing setting is an error there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="veldspar-")
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, *by: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and return the stored table.

    Used where two branches of a plan must see identical rows (row numbers, loop frontiers): the
    stored files survive lost executors and are read column by column.  With ``by``, the last columns, there is a folder per value,
    and filters on them read only those that they need.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path, partitionBy=list(by) or None, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the stored steps that ``df`` reads, or their folder ``part``, once nothing else will read them; other files stay."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folders = {found.group(1) for found in (re.match(r"(.*/[^/]+-[0-9a-f]{32})/", file) for file in df.inputFiles()) if found}
    for folder in folders:
        path = hadoop(f"{folder}/{part}" if part else folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
