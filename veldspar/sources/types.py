"""Oracle column types on Spark: the type map, and loading text columns under a declared schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions.scalar import to_date_ora

# Oracle types whose Spark type does not depend on precision or scale.
PLAIN_TYPES = {
    "VARCHAR2": T.StringType(), "NVARCHAR2": T.StringType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(),
    "NCHAR": T.StringType(), "CLOB": T.StringType(), "NCLOB": T.StringType(), "LONG": T.StringType(),
    "XMLTYPE": T.StringType(), "BFILE": T.StringType(),
    "BLOB": T.BinaryType(), "RAW": T.BinaryType(), "LONG RAW": T.BinaryType(),
    "BINARY_FLOAT": T.FloatType(), "BINARY_DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "DATE": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP WITH TIME ZONE": T.TimestampType(), "TIMESTAMP WITH LOCAL TIME ZONE": T.TimestampType(),
    "INTERVAL YEAR TO MONTH": T.YearMonthIntervalType(), "INTERVAL DAY TO SECOND": T.DayTimeIntervalType(),
}
INTEGER_TYPES = {"INTEGER": 38, "INT": 38, "SMALLINT": 38}
BOUNDED_TEXT = ("VARCHAR2", "NVARCHAR2", "VARCHAR", "CHAR", "NCHAR")
# NUMBER without precision: Spark has no unbounded decimal.
ANY_NUMBER = T.DecimalType(38, 10)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    data_type: str
    precision: int | None = None
    scale: int | None = None
    nullable: bool = True
    unit: str = "BYTE"  # what VARCHAR2(n) counts
    flag: bool = False  # NUMBER(1) read as a truth value
    date_model: str = "YYYY-MM-DD HH24:MI:SS"


def spark_type(data_type: str, precision: int | None = None, scale: int | None = None,
               flag: bool = False) -> T.DataType:
    name = " ".join(data_type.upper().split())
    if flag:
        return T.BooleanType()
    if name in ("NUMBER", "NUMERIC", "DECIMAL"):
        return ANY_NUMBER if precision is None else T.DecimalType(precision, scale or 0)
    if name in INTEGER_TYPES:
        return T.DecimalType(INTEGER_TYPES[name], 0)
    if name not in PLAIN_TYPES:
        raise ValueError(f"unknown Oracle type {data_type!r}")
    return PLAIN_TYPES[name]


def struct_type(defs: Sequence[ColumnDef]) -> T.StructType:
    return T.StructType([
        T.StructField(d.name, spark_type(d.data_type, d.precision, d.scale, d.flag), d.nullable) for d in defs])


def typed_value(raw: Column, d: ColumnDef) -> Column:
    """``raw`` text as a value of the declared type, NULL where it is none."""
    name = " ".join(d.data_type.upper().split())
    target = spark_type(d.data_type, d.precision, d.scale, d.flag)
    if d.flag:
        return F.trim(raw).try_cast(ANY_NUMBER) != 0
    if name == "DATE":
        return to_date_ora(raw, d.date_model)
    if isinstance(target, T.BinaryType):
        return F.try_to_binary(raw, F.lit("hex"))
    if name in ("CHAR", "NCHAR") and d.precision:
        return F.when(F.char_length(raw) <= d.precision, F.rpad(raw, d.precision, " "))
    if isinstance(target, T.StringType):
        return raw
    return F.trim(raw).try_cast(target)


def _problem(d: ColumnDef, value: Column) -> Column:
    """Reason to reject the row because of this column, NULL if there is none."""
    raw = F.col(d.name)
    name = " ".join(d.data_type.upper().split())
    reason = F.when(raw.isNotNull() & value.isNull(), f"{d.name}: not a {name}")
    if name in BOUNDED_TEXT and d.precision:
        size = F.octet_length(raw) if d.unit.upper() == "BYTE" else F.char_length(raw)
        reason = reason.when(size > d.precision, f"{d.name}: longer than {d.precision} {d.unit}")
    if not d.nullable:
        reason = reason.when(raw.isNull(), f"{d.name}: NULL")
    return reason


def load_typed(df: DataFrame, defs: Sequence[ColumnDef]) -> tuple[DataFrame, DataFrame]:
    """Apply a declared schema to text columns: (typed rows, rejected rows with their reasons).

    Both results are narrow projections of the input; a rejected row keeps its raw values.
    """
    values = {d.name: typed_value(F.col(d.name), d) for d in defs}
    problems = F.array_compact(F.array(*[_problem(d, values[d.name]) for d in defs]))
    bad = F.size("_problems") > 0
    checked = df.withColumn("_problems", problems)
    ok = checked.filter(~bad).select(*[values[d.name].alias(d.name) for d in defs])
    rejects = checked.filter(bad).withColumnRenamed("_problems", "reject_reasons")
    return ok, rejects


def defs_of(column_rows: Sequence) -> list[ColumnDef]:
    """Column inventory rows of one table as load definitions (rows: column_name, data_type, ...)."""
    def number(text):
        return int(text) if text not in (None, "", "*") else None

    return [ColumnDef(r["column_name"], r["data_type"], number(r["precision"]), number(r["scale"]), r["nullable"])
            for r in column_rows]


def varchar_limits_hold(df: DataFrame, defs: Sequence[ColumnDef]) -> Column:
    """Condition that every bounded text column fits its declared length."""
    checks = [F.coalesce((F.octet_length(d.name) if d.unit == "BYTE" else F.char_length(d.name)) <= d.precision, F.lit(True))
              for d in defs if d.precision and d.data_type.upper() in BOUNDED_TEXT]
    return reduce(lambda a, b: a & b, checks, F.lit(True))
