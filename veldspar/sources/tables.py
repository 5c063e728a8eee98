"""Table access: files by name, the one-row relation, session-scoped tables, name aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def dual(spark: SparkSession) -> DataFrame:
    """FROM DUAL: one row, one column."""
    return spark.sql("SELECT 'X' AS dummy")


class TempTable:
    """GLOBAL TEMPORARY table: rows private to the session, kept or dropped at the end of the unit
    of work (ON COMMIT PRESERVE / DELETE ROWS).  Use as a context manager; leaving it commits."""

    def __init__(self, df: DataFrame, name: str, on_commit: str = "DELETE"):
        if on_commit.upper() not in ("PRESERVE", "DELETE"):
            raise ValueError("on_commit is PRESERVE or DELETE")
        self.name, self.on_commit, self.spark = name, on_commit.upper(), df.sparkSession
        self.df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.df.createOrReplaceTempView(name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def commit(self) -> None:
        if self.on_commit == "DELETE":
            self.drop()
            self.spark.createDataFrame([], self.df.schema).createOrReplaceTempView(self.name)

    def drop(self) -> None:
        self.spark.catalog.dropTempView(self.name)
        self.df.unpersist()

    def __enter__(self) -> "TempTable":
        return self

    def __exit__(self, *exc) -> None:
        self.commit()


def temp_table(df: DataFrame, name: str, on_commit: str = "DELETE") -> TempTable:
    return TempTable(df, name, on_commit)


def synonym(spark: SparkSession, name: str, target: str) -> DataFrame:
    """SYNONYM name FOR target."""
    spark.table(target).createOrReplaceTempView(name)
    return spark.table(name)


def run_sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Dynamic SQL and substitution variables: values are bound by name, never pasted in."""
    return spark.sql(text, args=args or {})
