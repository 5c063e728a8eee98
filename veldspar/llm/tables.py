"""Small helpers shared by the operators: row keys, stored steps, Python path of the workers."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import veldspar
from veldspar.session import materialize


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it isn't installed there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(veldspar.__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([p for p in (known, root) if p])


def stored(df: DataFrame, label: str, *by: str, compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: rows and their keys stay as they are if a task runs again; one folder per value of ``by``."""
    prepare_workers(df.sparkSession)
    return materialize(df, label, *by, compression=compression)


def keyed(df: DataFrame, key: str = "key") -> DataFrame:
    """Number the rows.  Repeated and null ids are common, so rows need a key of their own; store the result before using it twice."""
    return df.withColumn(key, F.monotonically_increasing_id())


def learnable(id_col: str, modulus: int, held_out: int):
    """(held out, learn from) conditions on crc32 of the id's text; a row without an id is not learnt from and not held out."""
    rest = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))
    return F.coalesce(rest == held_out, F.lit(False)), F.coalesce(rest != held_out, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a key that stays with its row however often it is read.

    Rows read from Parquet are known by their file and their place in it; other frames are stored first.
    """
    if "_metadata" not in df.columns:
        file = F.hex(F.xxhash64("_metadata.file_path"))
        try:
            return df.select("*", F.concat(file, F.lit(":"), F.col("_metadata.row_index").cast("string")).alias(name))
        except AnalysisException:
            pass  # no files behind this frame
    return stored(keyed(df, name).withColumn(name, F.col(name).cast("string")), "keyed-rows")
